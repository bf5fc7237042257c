"""All queries by name, each over the tables of a directory, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forgepulse import schema as S
from forgepulse.operators import any_size, extract, features, limits, pairing
from forgepulse.operators.activities import event_fates
from forgepulse.operators.numbering import numbered
from forgepulse.operators.verdict import result_columns, verdicts
from forgepulse.plans import oracle as O
from forgepulse.plans import pipeline, testbed
from forgepulse.plans.report import report
from forgepulse.sources.events import combine_logins, read_accounts, read_events, read_logins
from forgepulse.sources.folders import shared_folder
from forgepulse.sources.results import with_date_text, write_results

Query = Callable[[SparkSession, str], DataFrame]

MIN_EVENTS = 70  # makes some derived accounts too quiet to judge
PAGE_SIZE = 30  # makes derived accounts span several pages
MIN_CONFIDENCE = 0.4
FEW = 40  # a limit most derived accounts exceed

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(name: str, query: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """Register a query over the flat events of a directory."""
    _QUERIES[name] = lambda spark, sf_dir: query(testbed.flat_events(spark, sf_dir))
    if sql is not None:
        _SQL[name] = sql


def _slug(activity: str) -> str:
    return "act_" + activity.lower().replace(" ", "_")


def _with_activities(select: str) -> str:
    return O.with_tables(select, *O.activity_parts())


def _with_features(select: str) -> str:
    return O.with_tables(select, *O.feature_parts())


# --- extraction -------------------------------------------------------------------------------

FLAT_COLUMNS = ", ".join(S.FLAT_EVENT.fieldNames())
_register("flatten_events", lambda flat: flat, O.with_tables(f"SELECT {FLAT_COLUMNS} FROM flat", O.FLAT))
_register(
    "flatten_issue_routing",
    lambda flat: flat.filter("event_type IN ('IssuesEvent', 'IssueCommentEvent')").select(
        "event_id", "PR_number", "PR_node_id", "PR_closed_at", "issue_number", "issue_node_id",
        "issue_closed_at", "num_comments",
    ),
    O.with_tables(
        "SELECT event_id, PR_number, PR_node_id, PR_closed_at, issue_number, issue_node_id, "
        "issue_closed_at, num_comments FROM flat "
        "WHERE event_type IN ('IssuesEvent', 'IssueCommentEvent')",
        O.FLAT,
    ),
)
_register(
    "event_type_counts",
    lambda flat: flat.groupBy("event_type").count().withColumnRenamed("count", "events"),
    O.with_tables("SELECT event_type, count(*) AS events FROM flat GROUP BY event_type", O.FLAT),
)
_register(
    "split_repository",
    lambda flat: extract.split_repository(flat)
    .groupBy("owner", "repo").count().withColumnRenamed("count", "events"),
    O.with_tables(
        "SELECT split_part(repository, '/', 1) AS owner, split_part(repository, '/', 2) AS repo, "
        "count(*) AS events FROM flat GROUP BY ALL",
        O.FLAT,
    ),
)

# --- limits -----------------------------------------------------------------------------------

_register(
    "latest_events",
    lambda flat: limits.latest_events(flat, FEW).selectExpr(
        "login", "event_id", "created_at", "CAST(event_rank AS bigint) AS event_rank"
    ),
    O.with_tables(
        "SELECT login, event_id, created_at, event_rank FROM ranked", O.FLAT, O.limited(FEW)
    ),
)
_register(
    "latest_events_guarded",
    lambda flat: limits.latest_events(
        limits.trim_hot_accounts(flat, FEW, min_rows=FEW), FEW
    ).selectExpr("login", "event_id", "created_at", "CAST(event_rank AS bigint) AS event_rank"),
    O.with_tables(
        "SELECT login, event_id, created_at, event_rank FROM ranked", O.FLAT, O.limited(FEW)
    ),
)
_register(
    "page_of_event",
    lambda flat: limits.page_of_event(limits.latest_events(flat), PAGE_SIZE).select(
        "login", "event_id", "page", "last_page"
    ),
    O.with_tables(
        f"SELECT login, event_id, CAST(ceil(event_rank / {PAGE_SIZE}) AS BIGINT) AS page, "
        f"count(*) OVER (PARTITION BY login) < ceil(event_rank / {PAGE_SIZE}) * {PAGE_SIZE} "
        "AS last_page FROM ranked",
        O.FLAT,
        O.limited(300),
    ),
)
_register(
    "dedup_events",
    lambda flat: limits.dedup_events(limits.latest_events(flat, None)).select("login", "event_id"),
    O.with_tables("SELECT login, event_id FROM ev", O.FLAT, O.limited(None)),
)
_register(
    "min_events_gate",
    lambda flat: limits.enough_events(limits.latest_events(flat), MIN_EVENTS),
    O.with_tables(
        f"SELECT login, count(*) AS events, count(*) >= {MIN_EVENTS} AS enough "
        "FROM ranked GROUP BY login",
        O.FLAT,
        O.limited(300),
    ),
)

# --- activities -------------------------------------------------------------------------------

_ACTIVITY_COLUMNS = ["contributor", "repository", "activity", "date", "event_id"]


def _register_activity(number: int, name: str) -> None:
    _register(
        _slug(name),
        lambda flat: pipeline.activities_of(flat, only=[number]).select(*_ACTIVITY_COLUMNS),
        _with_activities(
            f"SELECT {', '.join(_ACTIVITY_COLUMNS)} FROM activities WHERE activity_ord = {number}"
        ),
    )


for _number, _name in enumerate(S.ACTIVITY_NAMES, start=1):
    _register_activity(_number, _name)

_register(
    "activities_all",
    lambda flat: pipeline.activities_of(flat).select(*_ACTIVITY_COLUMNS),
    _with_activities(f"SELECT {', '.join(_ACTIVITY_COLUMNS)} FROM activities"),
)
_register(
    "activities_one_account",
    lambda flat: pipeline.activities_of_any_size(testbed.one_account(flat)).select(
        *_ACTIVITY_COLUMNS
    ),
    O.with_tables(
        f"SELECT {', '.join(_ACTIVITY_COLUMNS)} FROM activities",
        *O.activity_parts(flat=O.ONE_ACCOUNT),
    ),
)
_register(
    "activity_counts",
    lambda flat: pipeline.activities_of(flat)
    .groupBy("activity").count().withColumnRenamed("count", "activities"),
    _with_activities("SELECT activity, count(*) AS activities FROM activities GROUP BY activity"),
)

_CONSUMED_SQL = """consumed AS (
  SELECT login, companion_id, 3 AS ord FROM pair_release
  UNION SELECT login, companion_id, 14 FROM pair_close
  UNION SELECT login, companion_id, 15 FROM pair_reopen
  UNION SELECT login, companion_id, 18 FROM pair_pr_reopen
  UNION SELECT login, companion_id, 19 FROM pair_reject
  UNION SELECT login, companion_id, 19 FROM band
  UNION SELECT login, event_id, 21 FROM ev SEMI JOIN (
    SELECT login FROM ev WHERE event_type = 'PullRequestReviewCommentEvent') USING (login)
    WHERE event_type = 'PullRequestReviewEvent' AND review_state = 'commented')"""

_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in S.ACTIVITY_NAMES) + "]"
_register(
    "consumed_events",
    lambda flat: event_fates(pipeline.resolved_events(flat))
    .filter("fate = 'consumed'").select("event_id", "login", "event_type", "consumed_by"),
    O.with_tables(
        f"SELECT ev.event_id, ev.login, ev.event_type, ({_NAMES_SQL})[ord] AS consumed_by "
        "FROM ev JOIN consumed c ON c.login = ev.login AND c.companion_id = ev.event_id",
        *O.activity_parts(),
        _CONSUMED_SQL,
    ),
)
_register(
    "dropped_events",
    lambda flat: event_fates(pipeline.resolved_events(flat))
    .filter("fate = 'dropped'").select("event_id", "login", "event_type"),
    O.with_tables(
        "SELECT event_id, login, event_type FROM ev "
        "WHERE (login, event_id) NOT IN (SELECT (login, companion_id) FROM consumed) "
        "AND (login, event_id) NOT IN (SELECT (contributor, event_id) FROM activities)",
        *O.activity_parts(),
        _CONSUMED_SQL,
    ),
)

# --- pairing ----------------------------------------------------------------------------------


def _register_pairing(name: str, pairs: str, role: int, group: int) -> None:
    """The pairing, and the same with all events in one repository of one account."""
    turn = 1 if group <= 4 else 2

    def query(resolved: DataFrame) -> DataFrame:
        main = resolved.filter(f"role = {role} AND group_{turn} = {group}")
        sides = (
            f"array(CASE WHEN prev_{turn} THEN prev_{turn}_id END, "
            f"CASE WHEN next_{turn} THEN next_{turn}_id END)"
        )
        return main.selectExpr(
            "login", "event_id AS main_id", f"explode(array_compact({sides})) AS companion_id"
        )

    select = f"SELECT login, main_id, companion_id FROM {pairs}"
    _register(
        name,
        lambda flat: query(pipeline.resolved_events(flat)),
        O.with_tables(select, *O.activity_parts()),
    )
    _register(
        f"{name}_one_repository",
        lambda flat: query(pipeline.resolved_events_of_any_size(testbed.one_repository(flat))),
        O.with_tables(select, *O.activity_parts(flat=O.ONE_REPOSITORY)),
    )


_register_pairing("pair_release_tag", "pair_release", pairing.RELEASE, 1)
_register_pairing("pair_close_issue", "pair_close", pairing.ISSUE_CLOSED, 2)
_register_pairing("pair_reopen_issue", "pair_reopen", pairing.ISSUE_REOPENED, 5)
_register_pairing("pair_reopen_pr", "pair_pr_reopen", pairing.PR_REOPENED, 3)
_register_pairing("pair_reject_pr", "pair_reject", pairing.REJECT, 6)
_BAND_SQL = (
    "SELECT login, event_id, event_type FROM ev WHERE (login, event_id) IN "
    "(SELECT (login, main_id) FROM band UNION SELECT (login, companion_id) FROM band)"
)
_register(
    "band_merge_push",
    lambda flat: pipeline.resolved_events(flat)
    .filter("merge_push").select("login", "event_id", "event_type"),
    O.with_tables(_BAND_SQL, *O.activity_parts()),
)
_register(
    "band_merge_push_one_repository",
    lambda flat: pipeline.resolved_events_of_any_size(testbed.one_repository(flat))
    .filter("merge_push").select("login", "event_id", "event_type"),
    O.with_tables(_BAND_SQL, *O.activity_parts(flat=O.ONE_REPOSITORY)),
)

# --- series, runs, features -------------------------------------------------------------------


def _register_statistics(name: str, columns: list[str], series: list[str]) -> None:
    _register(
        name,
        lambda flat: features.all_statistics(pipeline.activities_of(flat), series=series).select(
            "contributor", *columns
        ),
        _with_features(f"SELECT contributor, {', '.join(columns)} FROM statistics"),
    )


_register_statistics("feat_basic", S.COUNT_FEATURES, [])
for _series in S.SERIES:
    _register_statistics(
        f"feat_{_series.lower()}", [f"{_series}_{s}" for s in S.STATISTICS], [_series]
    )
_register_statistics("gini", [f"{s}_gini" for s in S.SERIES], S.SERIES)


def _register_runs(
    name: str,
    query: Callable[[DataFrame], DataFrame],
    column: str,
    one_account: Callable[[DataFrame], DataFrame],
) -> None:
    spark_columns = [
        "contributor", "run_id", column, "activities", "first_time", "last_time",
        "time_spent", "time_to_switch",
    ]
    _register(
        name,
        lambda flat: query(pipeline.activities_of(flat)).selectExpr(*spark_columns),
        O.with_tables(
            f"SELECT {', '.join(spark_columns)} FROM {name}", *O.activity_parts(), O.RUNS
        ).replace("FROM repository_runs", "FROM repo_runs"),
    )
    _register(
        f"{name}_one_account",
        lambda flat: one_account(
            pipeline.activities_of_any_size(testbed.one_account(flat))
        ).selectExpr(*spark_columns),
        O.with_tables(
            f"SELECT {', '.join(spark_columns)} FROM {name}",
            *O.activity_parts(flat=O.ONE_ACCOUNT),
            O.RUNS,
        ),
    )


_register_runs("repo_runs", features.repository_runs, "repository", any_size.repository_runs)
_register_runs("type_runs", features.type_runs, "activity", any_size.type_runs)
_register(
    "features_all",
    pipeline.features_of,
    _with_features(
        f"SELECT contributor, {', '.join(S.FEATURES)}, events FROM statistics JOIN "
        "(SELECT login AS contributor, count(*) AS events FROM ranked GROUP BY login) "
        "USING (contributor)"
    ),
)

_register(
    "features_one_account",
    lambda flat: pipeline.features_of_any_size(testbed.one_account(flat)).select(
        "contributor", *S.FEATURES, "events"
    ),
    O.with_tables(
        f"SELECT contributor, {', '.join(S.FEATURES)}, events FROM statistics JOIN "
        "(SELECT login AS contributor, count(*) AS events FROM ranked GROUP BY login) "
        "USING (contributor)",
        *O.feature_parts(flat=O.ONE_ACCOUNT),
    ),
)

# --- verdicts ---------------------------------------------------------------------------------

_register(
    "verdict_fixed_score",
    lambda flat: verdicts(testbed.fixed_score(pipeline.features_of(flat))).select(
        "contributor", "type", "confidence"
    ),
    O.fixed_verdicts(),
)


def _classify_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.classify_accounts(
        testbed.accounts(spark, sf_dir),
        testbed.flat_events(spark, sf_dir),
        testbed.fixed_score,
        min_events=MIN_EVENTS,
    )


def _progressive_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = testbed.accounts(spark, sf_dir).filter("NOT lookup_failed AND declared_type = 'User'")
    return pipeline.progressive_classify(
        users,
        testbed.flat_events(spark, sf_dir),
        testbed.fixed_score,
        min_events=20,
        min_confidence=MIN_CONFIDENCE,
        page_size=PAGE_SIZE,
    ).selectExpr("contributor", "type", "confidence", "events", "CAST(pages AS bigint) AS pages")


_QUERIES["classify_accounts_fixed_score"] = _classify_fixed
_SQL["classify_accounts_fixed_score"] = O.fixed_classification(MIN_EVENTS)
_QUERIES["progressive_fixed_score"] = _progressive_fixed
_SQL["progressive_fixed_score"] = O.fixed_progressive(20, MIN_CONFIDENCE, PAGE_SIZE, S.MAX_PAGES)


BOT_FROM, HUMAN_TO = 72, 68  # activities; accounts in between have no label
CERTAIN = f"NA >= {BOT_FROM} OR NA <= {HUMAN_TO}"
HELD_OUT = "CAST(substr(contributor, 5) AS bigint) % 4 = 0"


def _train_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn a label that the activity count determines on three of four folds, and judge every account.

    Accounts near the border have no label: they aren't learned from, and their verdict, which hangs on
    the model, is shown as `uncertain`.
    """
    from forgepulse.plans import model

    folder = shared_folder(spark, "train-score")
    pipeline.features_of(testbed.flat_events(spark, sf_dir)).write.parquet(f"{folder}/features")
    features = spark.read.parquet(f"{folder}/features")
    labelled = features.filter(f"NOT ({HELD_OUT}) AND ({CERTAIN})")
    learned = model.train(labelled.selectExpr("*", f"NA >= {BOT_FROM} AS is_bot"), rounds=5, bins=256)
    model.save(learned, f"{folder}/model")
    score = model.scorer(model.load(f"{folder}/model"))
    return verdicts(score(features)).selectExpr(
        "contributor",
        f"{HELD_OUT} AS held_out",
        f"CASE WHEN {CERTAIN} OR type NOT IN ('Bot', 'Human') THEN type ELSE 'uncertain' END AS type",
    )


_SQL["train_score_gbt"] = _with_features(
    f"""SELECT contributor, {HELD_OUT} AS held_out,
               CASE WHEN NOT ({CERTAIN}) THEN 'uncertain'
                    WHEN NA >= {BOT_FROM} THEN 'Bot' ELSE 'Human' END AS type
        FROM statistics"""
)
_QUERIES["train_score_gbt"] = _train_score


def _classify_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the stream over the files there are, then read the verdicts it left."""
    from forgepulse.operators.extract import flatten_events
    from forgepulse.streaming import classify

    folder = shared_folder(spark, "classify-stream")
    stream = classify.classify_stream(
        flatten_events(testbed.stream_raw_events(spark, sf_dir)),
        testbed.accounts(spark, sf_dir),
        testbed.fixed_score,
        output=f"{folder}/verdicts",
        checkpoint=f"{folder}/checkpoint",
        min_events=MIN_EVENTS,
        availableNow=True,
    )
    stream.awaitTermination()
    return classify.current_verdicts(spark, f"{folder}/verdicts")


def _stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the newest events of each account over a stream, then read them back."""
    from forgepulse.operators.extract import flatten_events
    from forgepulse.streaming import latest
    folder = shared_folder(spark, "stream-latest")
    stream = latest.store_latest_events(
        flatten_events(testbed.stream_raw_events(spark, sf_dir)),
        output=f"{folder}/events",
        checkpoint=f"{folder}/checkpoint",
        max_events=FEW,
        availableNow=True,
    )
    stream.awaitTermination()
    return latest.current_events(spark, f"{folder}/events").select(
        "login", "event_id", "event_type", "repository", "created_at", "issue_closed_at", "merged"
    )


_QUERIES["stream_latest_events"] = _stream_latest
_SQL["stream_latest_events"] = O.with_tables(
    f"""SELECT login, event_id, event_type, repository, created_at, issue_closed_at, merged
        FROM flat
        QUALIFY row_number() OVER (PARTITION BY login
                                   ORDER BY created_at DESC, event_id DESC) <= {FEW}""",
    O.FLAT,
)
_QUERIES["classify_stream"] = _classify_stream
_SQL["classify_stream"] = O.fixed_classification(MIN_EVENTS)


# --- sources and sinks --------------------------------------------------------------------------


def _stored_json(spark: SparkSession, df: DataFrame, name: str) -> str:
    folder = shared_folder(spark, name)
    df.write.json(folder)
    return folder


def _events_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived archive as JSON lines, read and flattened."""
    folder = _stored_json(spark, testbed.raw_events(spark, sf_dir), "events-json")
    return extract.flatten_events(read_events(spark, folder))


def _accounts_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _stored_json(spark, testbed.accounts(spark, sf_dir), "accounts-json")
    return read_accounts(spark, folder)


def _login_lists(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a short list `a` and a long list `b` of logins, each sorted."""
    folder = shared_folder(spark, "logins")
    numbers = "CAST(substr(login, 5) AS bigint)"
    users = testbed.accounts(spark, sf_dir).selectExpr("login", f"{numbers} AS number")
    for name, part in (("a", "number % 10 = 0"), ("b", "number % 10 != 0")):
        lines = users.filter(part).orderBy("number").selectExpr("concat(login, ' note') AS value")
        lines.write.text(f"{folder}/{name}")  # the order of rows is that of files and lines
    return folder


def _combined_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named logins, then those of both lists, numbered in the order given."""
    folder = _login_lists(spark, sf_dir)
    listed = read_logins(spark, [f"{folder}/{name}" for name in ("b", "a")])
    combined = combine_logins(spark, ["user1", "user0"], listed)
    return numbered(combined, ["input_pos"]).select("login", "place")


_RESULT_COLUMNS = ["contributor", "type", "confidence"]


def _written(file_format: str) -> Query:
    """All verdicts written in a format and read again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = shared_folder(spark, f"results-{file_format}")
        results = result_columns(_classify_fixed(spark, sf_dir), verbose=False)
        write_results(results, folder, file_format)
        if file_format == "text":
            return spark.read.text(folder).selectExpr("value AS line")
        reader = spark.read.schema("contributor string, type string, confidence double")
        return reader.option("header", True).format(file_format).load(folder)

    return query


def _report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: archive, declarations and lists of logins to results in the order asked."""
    events = _stored_json(spark, testbed.raw_events(spark, sf_dir), "report-events")
    accounts = f"{events}-accounts"
    testbed.accounts(spark, sf_dir).write.parquet(accounts)
    return report(
        spark, events, accounts, testbed.fixed_score, logins=["user1", "nobody"],
        logins_file=_login_lists(spark, sf_dir) + "/*", min_events=MIN_EVENTS, max_queries=3,
        accounts_format="parquet",
    )


_QUERIES["events_from_json"] = _events_from_json
_SQL["events_from_json"] = _SQL["flatten_events"]
_QUERIES["accounts_from_json"] = _accounts_from_json
_SQL["accounts_from_json"] = O.with_tables("SELECT * FROM accounts", O.ACCOUNTS)
_QUERIES["combined_logins"] = _combined_logins
_SQL["combined_logins"] = O.with_tables(
    "SELECT login, row_number() OVER (ORDER BY list, number) AS place FROM asked",
    O.ACCOUNTS,
    """asked AS (
      SELECT 'user1' AS login, 0 AS list, 0 AS number UNION ALL SELECT 'user0', 0, 1
      UNION ALL
      SELECT login, CASE WHEN number % 10 = 0 THEN 1 ELSE 2 END, number
      FROM (SELECT login, CAST(substr(login, 5) AS BIGINT) AS number FROM accounts))""",
)
_FIXED = O.fixed_classification(MIN_EVENTS)
_SHORT = f"SELECT {', '.join(_RESULT_COLUMNS)} FROM ({_FIXED})"
for _format in ("csv", "json", "text"):
    _QUERIES[f"results_{_format}"] = _written(_format)
_SQL["results_csv"] = _SQL["results_json"] = _SHORT
_SQL["results_text"] = (
    "SELECT concat_ws(chr(9), contributor, type, coalesce(CAST(confidence AS VARCHAR), '-')) "
    f"AS line FROM ({_SHORT})"
)
_QUERIES["results_short"] = lambda spark, sf_dir: result_columns(
    _classify_fixed(spark, sf_dir), verbose=False
)
_SQL["results_short"] = _SHORT
_QUERIES["results_verbose"] = lambda spark, sf_dir: result_columns(
    _classify_fixed(spark, sf_dir), verbose=True
)
_SQL["results_verbose"] = _FIXED
_register(
    "activity_dates_iso",
    lambda flat: with_date_text(pipeline.activities_of(flat)).select(
        "contributor", "event_id", "activity", "date"
    ),
    _with_activities(
        "SELECT contributor, event_id, activity, strftime(date, '%Y-%m-%dT%H:%M:%S+00:00') AS date "
        "FROM activities"
    ),
)
_QUERIES["report_all"] = _report_all
_SQL["report_all"] = f"""
WITH asked AS (
  SELECT DISTINCT 'user' || user_id AS login FROM events
  UNION ALL SELECT 'user1' UNION ALL SELECT 'nobody')
SELECT login AS contributor, coalesce(type, 'Invalid') AS type, confidence
FROM asked LEFT JOIN ({_SHORT}) r ON r.contributor = asked.login"""


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
