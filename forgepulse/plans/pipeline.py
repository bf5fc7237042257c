"""End-to-end plans over the events of all accounts at once.

One shuffle by account carries the whole chain: limiting, pairing, activities and features all
work inside the partitioning the limit produced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from forgepulse import schema as S
from forgepulse.operators import any_size
from forgepulse.operators.activities import emit_activities
from forgepulse.operators.features import extract_features
from forgepulse.operators.limits import count_events, dedup_any_size, dedup_events, latest_events
from forgepulse.operators.looks import InRanges
from forgepulse.operators.pairing import resolve_pairs
from forgepulse.operators.verdict import declared_verdicts, gated_verdicts

MAX_EVENTS = S.PAGE_SIZE * S.MAX_PAGES

# A scorer adds the column `p_bot` to a feature table.
Scorer = Callable[[DataFrame], DataFrame]


def resolved_events(flat: DataFrame, max_events: int | None = None) -> DataFrame:
    """Deduplicated events with their pairings; all of them unless `max_events` is given."""
    return resolve_pairs(dedup_events(latest_events(flat, max_events)))


def activities_of(
    flat: DataFrame, max_events: int | None = None, only: Sequence[int] | None = None
) -> DataFrame:
    return emit_activities(resolved_events(flat, max_events), only=only)


def resolved_events_of_any_size(flat: DataFrame) -> DataFrame:
    """What `resolved_events` gives without a limit, with the work on one account split over tasks.

    Ranges of events are stored below `spark.checkpoint.dir`; only the columns that activities and
    fates of events need remain.
    """
    return resolve_pairs(dedup_any_size(latest_events(flat, None)), look=InRanges())


def activities_of_any_size(flat: DataFrame, only: Sequence[int] | None = None) -> DataFrame:
    return emit_activities(resolved_events_of_any_size(flat), only=only)


def features_of_latest(latest: DataFrame, keys: Sequence[str] = ("login",)) -> DataFrame:
    """Features and `events` of limited events that already carry their `events` count."""
    activities = emit_activities(
        resolve_pairs(dedup_events(latest), keys), keys, carry=["events"]
    )
    return extract_features(activities, ["contributor", *[k for k in keys if k != "login"]], ["events"])


def features_of(flat: DataFrame, max_events: int | None = None) -> DataFrame:
    """Features of every account from all its events, or the newest `max_events`."""
    return features_of_latest(count_events(latest_events(flat, max_events)))


def features_of_any_size(flat: DataFrame) -> DataFrame:
    """What `features_of` gives without a limit, with the features of one account split over tasks.

    For archives in which an account outgrows a task. Ranges of activities and of values are stored
    below `spark.checkpoint.dir`.
    """
    counts = flat.groupBy(F.col("login").alias("__login")).agg(F.count(F.lit(1)).alias("events"))
    features = any_size.extract_features(activities_of_any_size(flat))
    return features.join(counts, F.col("contributor").eqNullSafe(F.col("__login"))).drop("__login")


def accounts_for(logins: DataFrame, accounts: DataFrame) -> DataFrame:
    """Declarations of the asked logins, order column and repeats kept; unknown logins failed.

    A login that is declared more than once counts once.
    """
    once = accounts.dropDuplicates(["login"])
    return logins.join(once, "login", "left").withColumn(
        "lookup_failed", F.coalesce("lookup_failed", F.lit(True))
    )


def users_among(accounts: DataFrame) -> DataFrame:
    """Logins whose type only a model can tell."""
    return accounts.filter("NOT lookup_failed AND declared_type = 'User'").select("login").distinct()


def _latest_of_users(accounts: DataFrame, flat: DataFrame, max_events: int) -> DataFrame:
    """Newest events of the accounts that need a model, that is, those declared `User`.

    The join comes after the limit, where the events already lie partitioned by login and no
    account has more than `max_events` rows; Spark decides from measured sizes how to run it.
    """
    latest = latest_events(flat, max_events).join(users_among(accounts), "login", "left_semi")
    return count_events(latest)


def with_event_counts(flat: DataFrame, max_events: int, judged: DataFrame) -> DataFrame:
    """`judged` with a row for every account in `flat` and the true count in `events`.

    An account whose events are of no known kind has no features, but it has events. The counts
    read the login column only and are combined before their shuffle.
    """
    counts = (
        flat.filter("login IS NOT NULL")
        .groupBy(F.col("login").alias("contributor"))
        .agg(F.least(F.count(F.lit(1)), F.lit(max_events).cast("bigint")).alias("counted"))
    )
    return counts.join(judged, "contributor", "left").selectExpr(
        "* EXCEPT (counted, events)", "coalesce(events, counted) AS events"
    )


def classify_accounts(
    accounts: DataFrame,
    flat: DataFrame,
    score: Scorer,
    min_events: int = 5,
    max_queries: int = S.MAX_PAGES,
    page_size: int = S.PAGE_SIZE,
) -> DataFrame:
    """Verdict of every account row from the newest `max_queries` pages of its events.

    Columns of `accounts` beyond the declaration (an order, say) are kept.
    """
    latest = _latest_of_users(accounts, flat, max_queries * page_size)
    judged = gated_verdicts(score(features_of_latest(latest)), min_events)
    judged = with_event_counts(flat, max_queries * page_size, judged)
    extra = tuple(c for c in accounts.columns if c not in S.ACCOUNT.fieldNames())
    return declared_verdicts(accounts, judged, extra)


def progressive_verdicts(
    latest: DataFrame,
    score: Scorer,
    min_events: int,
    min_confidence: float,
    max_queries: int,
    page_size: int,
) -> DataFrame:
    """Verdict at the first prefix of pages that settles the account.

    `latest` carries `event_rank` and `events`. Every prefix of pages is judged in one go, as a
    second account key; the smallest prefix that stops wins. A prefix stops when its confidence
    exceeds `min_confidence`, when it has fewer than `min_events` events, or when no further
    page exists or may be asked for.
    """
    deduplicated = dedup_events(latest).withColumnRenamed("events", "total")
    prefixed = deduplicated.selectExpr(
        "*",
        f"""explode(sequence(
              CAST(ceil(event_rank / {page_size}) AS int),
              least({max_queries}, CAST(ceil(total / {page_size}) AS int)))) AS pages""",
    ).selectExpr("*", f"least(total, pages * {page_size}L) AS events")
    keys = ("login", "pages")
    activities = emit_activities(resolve_pairs(prefixed, keys), keys, carry=["events", "total"])
    features = extract_features(activities, ["contributor", "pages"], ["events", "total"])
    judged = gated_verdicts(score(features), min_events).selectExpr(
        "*",
        f"""events < {min_events} OR confidence > {min_confidence} OR pages = {max_queries}
            OR pages * {page_size} >= total AS stops""",
    )
    return (
        judged.selectExpr(
            "*",
            "row_number() OVER (PARTITION BY contributor ORDER BY stops DESC, pages) AS choice",
        )
        .filter("choice = 1")
        .drop("choice", "stops", "total")
    )


def progressive_classify(
    accounts: DataFrame,
    flat: DataFrame,
    score: Scorer,
    min_events: int = 5,
    min_confidence: float = 1.0,
    max_queries: int = S.MAX_PAGES,
    page_size: int = S.PAGE_SIZE,
) -> DataFrame:
    """Like `classify_accounts`, reading only as many pages per account as its verdict needs."""
    latest = _latest_of_users(accounts, flat, max_queries * page_size)
    judged = progressive_verdicts(
        latest, score, min_events, min_confidence, max_queries, page_size
    )
    judged = with_event_counts(flat, max_queries * page_size, judged)
    extra = tuple(c for c in accounts.columns if c not in S.ACCOUNT.fieldNames())
    return declared_verdicts(accounts, judged, ("pages", *extra))
