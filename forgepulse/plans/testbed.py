"""Code-hosting events derived from the `events` table, to exercise every operator.

One deterministic mapping by event number: each source event becomes a primary event and, for
some kinds, a companion a few seconds away. The mapping is also written as SQL for the oracle in
`forgepulse.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forgepulse.operators.extract import flatten_events
from forgepulse.sources.folders import is_folder

# Kind of the primary event by event number modulo 40.
_PRIMARY_TYPE = """
CASE WHEN m IN (0, 1, 4) THEN 'CreateEvent'
     WHEN m IN (2, 3) THEN 'ReleaseEvent'
     WHEN m IN (5, 6) THEN 'DeleteEvent'
     WHEN m = 7 THEN 'PublicEvent'
     WHEN m = 8 THEN 'MemberEvent'
     WHEN m = 9 THEN 'ForkEvent'
     WHEN m = 10 THEN 'WatchEvent'
     WHEN m = 11 THEN 'GollumEvent'
     WHEN m BETWEEN 12 AND 19 OR m = 39 THEN 'IssuesEvent'
     WHEN m IN (20, 29) THEN 'IssueCommentEvent'
     WHEN m BETWEEN 21 AND 28 THEN 'PullRequestEvent'
     WHEN m = 30 THEN 'PullRequestReviewCommentEvent'
     WHEN m BETWEEN 31 AND 33 AND u % 10 != 0 THEN 'PullRequestReviewEvent'
     WHEN m = 34 THEN 'CommitCommentEvent'
     ELSE 'PushEvent' END
"""
_COMPANION_TYPE = (
    "CASE m WHEN 2 THEN 'CreateEvent' WHEN 24 THEN 'PushEvent' ELSE 'IssueCommentEvent' END"
)
_ISO = "\"yyyy-MM-dd'T'HH:mm:ss'Z'\""
_PR_FAMILY = (
    "type IN ('PullRequestEvent', 'PullRequestReviewEvent', 'PullRequestReviewCommentEvent')"
)
_ACTION = f"""
CASE WHEN type = 'IssuesEvent' THEN
       CASE WHEN m <= 14 THEN 'opened' WHEN m <= 17 THEN 'closed' WHEN m <= 19 THEN 'reopened'
            ELSE 'labeled' END
     WHEN type = 'PullRequestEvent' THEN
       CASE WHEN m = 21 THEN 'opened' WHEN m <= 23 THEN 'reopened' ELSE 'closed' END
     WHEN {_PR_FAMILY} OR type = 'IssueCommentEvent' THEN 'created' END
"""
_ON_PR = "m IN (22, 26, 29)"
_ITEM_CLOSED = "(m IN (15, 17, 26) OR m = 16 AND companion = 0)"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested events in the shape of the archive."""
    return derive(spark.read.parquet(f"{sf_dir}/events.parquet"))


def stream_raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream over the table's files: the file itself, or the parts in its folder."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    if is_folder(spark, path):
        return derive(files.parquet(path))
    return derive(files.option("pathGlobFilter", "events*.parquet").parquet(sf_dir))


def derive(source: DataFrame) -> DataFrame:
    typed = (
        source.selectExpr(
            "event_id AS i",
            "user_id AS u",
            # Every fiftieth user has only events of no known kind.
            "CASE WHEN user_id % 50 = 7 THEN 39 ELSE event_id % 40 END AS m",
            "event_id DIV 40 % 7 - 3 AS d",
            "CAST(date_trunc('second', ts) AS timestamp_ntz) AS t",
        )
        .selectExpr(
            "*",
            "explode(CASE WHEN m IN (2, 15, 16, 18, 22, 24, 26) THEN array(0, 1) ELSE array(0) END)"
            " AS companion",
        )
        .selectExpr(
            "*", "explode(CASE WHEN i % 97 = 0 THEN array(0, 1) ELSE array(0) END) AS copy"
        )
        .selectExpr(
            "i",
            "u",
            "m",
            "companion",
            "i * 2 + companion AS number",
            f"CASE WHEN companion = 1 THEN {_COMPANION_TYPE} ELSE {_PRIMARY_TYPE} END AS type",
            "t + make_dt_interval(0, 0, 0, companion * d * CASE m WHEN 26 THEN 1000 ELSE 1 END)"
            " AS at",
            "t",
            "concat('org', (u + i) % 5, '/repo', i % 3) AS repository",
        )
    )
    payload = f"""struct(
        CASE WHEN type = 'PushEvent' THEN number END AS push_id,
        {_ACTION} AS action,
        CASE WHEN companion = 1 OR m IN (4, 5) THEN concat('v', i)
             WHEN m IN (1, 6) THEN concat('b', i) END AS ref,
        CASE WHEN companion = 1 OR m IN (4, 5) THEN 'tag' WHEN m IN (1, 6) THEN 'branch'
             WHEN m = 0 THEN 'repository' END AS ref_type,
        CASE WHEN {_PR_FAMILY} THEN struct(
            i AS number,
            CASE WHEN m BETWEEN 24 AND 28 THEN 'closed' ELSE 'open' END AS state,
            concat('PR_', i) AS node_id,
            CASE WHEN m IN (24, 25) THEN true WHEN m != 28 THEN false END AS merged)
        END AS pull_request,
        CASE WHEN type IN ('IssuesEvent', 'IssueCommentEvent') THEN struct(
            i AS number,
            CASE WHEN {_ITEM_CLOSED} THEN 'closed' ELSE 'open' END AS state,
            concat(CASE WHEN {_ON_PR} THEN 'PR_' ELSE 'I_' END, i) AS node_id,
            concat('https://host/', repository,
                   CASE WHEN {_ON_PR} THEN '/pull/' ELSE '/issues/' END, i) AS html_url,
            CASE WHEN {_ITEM_CLOSED} OR m = 13 THEN date_format(t, {_ISO}) END AS closed_at,
            CASE WHEN m = 12 THEN 2L WHEN m IN (13, 14) THEN 0L ELSE 1L END AS comments)
        END AS issue,
        struct(concat('C_', number) AS node_id) AS comment,
        struct(CASE m WHEN 31 THEN 'commented' WHEN 32 THEN 'approved'
                      ELSE 'changes_requested' END AS state,
               concat('R_', i) AS node_id) AS review,
        struct(concat('v', i) AS tag_name, concat('REL_', i) AS node_id) AS release
    )"""
    return typed.selectExpr(
        "CAST(number AS string) AS id",
        "type",
        f"date_format(at, {_ISO}) AS created_at",
        "struct(concat('user', u) AS login) AS actor",
        "struct(repository AS name) AS repo",
        f"{payload} AS payload",
    )


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_events(raw_events(spark, sf_dir))


def one_account(flat: DataFrame) -> DataFrame:
    """All events under one login."""
    return flat.selectExpr("* EXCEPT (login)", "'everyone' AS login").select(flat.columns)


def one_repository(flat: DataFrame) -> DataFrame:
    """All events in one repository of one login."""
    own = one_account(flat).selectExpr("* EXCEPT (repository)", "'all/together' AS repository")
    return own.select(flat.columns)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One declaration per account of the derived events."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return users.selectExpr(
        "concat('user', user_id) AS login",
        "CASE user_id % 15 WHEN 1 THEN 'Bot' WHEN 2 THEN 'Organization' WHEN 3 THEN NULL "
        "ELSE 'User' END AS declared_type",
        "user_id % 15 = 3 AS lookup_failed",
    )


# A fixed logistic formula in place of a trained model, so that SQL can reproduce the verdicts.
FIXED_SCORE_SQL = (
    "1.0 / (1.0 + exp(-(3.0 * coalesce(NAR_gini, 0.0) - 0.15 * NT + 0.02 * NA"
    " + 0.08 * coalesce(DCA_median, 0.0))))"
)


def fixed_score(features: DataFrame) -> DataFrame:
    return features.selectExpr("*", f"{FIXED_SCORE_SQL} AS p_bot")
