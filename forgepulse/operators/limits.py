"""Newest events per account, pages, and removal of repeated events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from forgepulse import schema as S

# Rows from which an account is trimmed by `trim_hot_accounts`.
HOT_ACCOUNT_ROWS = 1_000_000
SALTS = 256


def newest_first() -> list[Column]:
    return [F.col("created_at").desc_nulls_last(), F.col("event_id").desc_nulls_last()]


def hot_accounts(flat: DataFrame, min_rows: int = HOT_ACCOUNT_ROWS) -> DataFrame:
    """The logins with `min_rows` events or more; at most rows / `min_rows` of them.

    Counts read the login column only and are combined before their narrow shuffle.
    """
    counted = flat.groupBy("login").count().filter(F.col("count") >= min_rows)
    return counted.select("login")


def trim_hot_accounts(
    flat: DataFrame,
    max_events: int,
    min_rows: int = HOT_ACCOUNT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Drop events of hot accounts that cannot be among their newest `max_events`.

    The cut-off (the `max_events`-th newest event) is found over three narrow columns, first per
    salt and then per account, so no task ever sees more than `salts * max_events` rows of an
    account or its share of one salt. Whether the list of hot accounts is broadcast is left to
    Spark, which measures it.
    """
    hot = hot_accounts(flat, min_rows)
    per_salt = Window.partitionBy("login", "salt").orderBy(*newest_first())
    per_login = Window.partitionBy("login").orderBy(*newest_first())
    cutoffs = (
        flat.select("login", "created_at", "event_id")
        .join(hot, "login")
        .withColumn("salt", F.spark_partition_id() % salts)
        .withColumn("place", F.row_number().over(per_salt))
        .filter(F.col("place") <= max_events)
        .withColumn("place", F.row_number().over(per_login))
        .filter(F.col("place") == max_events)
        .select("login", F.struct("created_at", "event_id").alias("cutoff"))
    )
    at, number = F.col("cutoff.created_at"), F.col("cutoff.event_id")
    keep = (
        at.isNull()
        | (F.col("created_at") > at)
        | ((F.col("created_at") == at) & (number.isNull() | (F.col("event_id") >= number)))
    )
    return flat.join(cutoffs, "login", "left").filter(keep).drop("cutoff")


def latest_events(
    flat: DataFrame, max_events: int | None = S.PAGE_SIZE * S.MAX_PAGES
) -> DataFrame:
    """The newest `max_events` events of each account, ranked by `event_rank` (1 = newest).

    One plan at every size. Ranking filters before the shuffle (window group limit) as well as
    after it, so an account sends at most `max_events` rows per input split. Callers whose input
    has so many splits that this is still too much for one task apply `trim_hot_accounts` first.
    Without a limit (None) all events of known accounts come back, unranked.
    """
    known = flat.filter(F.col("login").isNotNull())
    if max_events is None:
        return known
    newest = Window.partitionBy("login").orderBy(*newest_first())
    return known.withColumn("event_rank", F.row_number().over(newest)).filter(
        F.col("event_rank") <= max_events
    )


def count_events(latest: DataFrame) -> DataFrame:
    """Add `events`, the number of events kept for the account, repeated ones included."""
    return latest.withColumn("events", F.count(F.lit(1)).over(Window.partitionBy("login")))


def page_of_event(latest: DataFrame, page_size: int = S.PAGE_SIZE) -> DataFrame:
    """Add `page` (1 = newest) and `last_page`: whether no fuller page can follow."""
    rows = F.count(F.lit(1)).over(Window.partitionBy("login"))
    page = F.ceil(F.col("event_rank") / F.lit(page_size)).cast("bigint")
    return latest.withColumns({"page": page, "last_page": rows < page * page_size})


def dedup_events(latest: DataFrame) -> DataFrame:
    """Keep one of each repeated event.

    Copies of an event carry the same time and id, so they are neighbours in the order in which
    `latest_events` already sorted the partition: no shuffle and no further sort. Events without
    a readable id are never taken for copies.
    """
    newest = Window.partitionBy("login").orderBy(*newest_first())
    repeated = (F.col("event_id") == F.lag("event_id").over(newest)) & F.col(
        "created_at"
    ).eqNullSafe(F.lag("created_at").over(newest))
    return (
        latest.withColumn("repeated", F.coalesce(repeated, F.lit(False)))
        .filter(~F.col("repeated"))
        .drop("repeated")
    )


def dedup_any_size(events: DataFrame) -> DataFrame:
    """What `dedup_events` gives, for accounts of any size and events repeated any number of times.

    Copies are combined before the shuffle, which deals events, not accounts, to tasks. Spark sorts them
    for that; ids differ most, so they come first in the order.
    """
    named = events.filter("event_id IS NOT NULL").dropDuplicates(["event_id", "created_at", "login"])
    return named.unionByName(events.filter("event_id IS NULL"))


def enough_events(counted: DataFrame, min_events: int) -> DataFrame:
    """One row per account: its event count and whether it reaches `min_events`."""
    return counted.groupBy("login").agg(F.count(F.lit(1)).alias("events")).withColumn(
        "enough", F.col("events") >= min_events
    )
