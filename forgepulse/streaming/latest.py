"""Keep the newest events of each account while a stream of events comes in.

Each batch is reduced to the newest events per account before its shuffle, joined by the stored
events of the accounts it touches, reduced again and stored in a folder of its own, by buckets of accounts; it opens the files of the buckets it touches and
no others. The folder is
overwritten when the batch is repeated after a failure, and a batch reads only what earlier ones
stored. Now and then a batch stores the events of all accounts; readers start at the last such
snapshot, so what a batch reads does not grow with the age of the stream.

Repeated events are rows like any others, as in `latest_events`: they take places among the newest
and count. Events without id are never taken for repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from forgepulse import schema as S
from forgepulse.operators.limits import latest_events
from forgepulse.sources.folders import exists

_FIELDS = S.FLAT_EVENT.fieldNames()
SNAPSHOT_EVERY = 50
BUCKETS = 64
"""Buckets of accounts; a log has to be read with the number it was written with."""

_LOG = StructType(
    [
        *S.FLAT_EVENT,
        StructField("snapshot", IntegerType()),
        StructField("batch_id", LongType()),
        StructField("bucket", IntegerType()),
    ]
)


def arriving(flat: DataFrame, late_by: str | None = None) -> DataFrame:
    """The events of known accounts. With `late_by`, events later than that watermark are ignored
    and repeats of an id within it dropped; events without id or time pass."""
    known = flat.filter("login IS NOT NULL")
    if late_by is None:
        return known
    named = "event_id IS NOT NULL AND created_at IS NOT NULL"
    once = (
        known.filter(named)
        .selectExpr("*", "CAST(created_at AS timestamp) AS event_time")
        .withWatermark("event_time", late_by)
        .dropDuplicatesWithinWatermark(["login", "event_id"])
    )
    return once.select(_FIELDS).union(known.filter(f"NOT ({named})").select(_FIELDS))


def _bucket_of(login: str = "login", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(login), F.lit(buckets)).cast("int")


def _stored(
    spark: SparkSession, folder: str, before: int | None = None, buckets: list[int] | None = None
) -> DataFrame | None:
    """The log of batches since the last snapshot, all or some buckets of it; None if there is none.

    Batch and bucket are folders, so what isn't asked for isn't opened.
    """
    if not exists(spark, folder):
        return None
    log = spark.read.schema(_LOG).parquet(folder)
    if before is not None:
        log = log.filter(F.col("batch_id") < before)
    last = log.filter("snapshot = 1").agg(F.max("batch_id")).first()[0]
    if last is not None:
        log = log.filter(F.col("batch_id") >= last)
    return log if buckets is None else log.filter(F.col("bucket").isin(buckets))


def _current(log: DataFrame) -> DataFrame:
    last = log.groupBy("login").agg(F.max("batch_id").alias("batch_id"))
    return log.join(last, ["login", "batch_id"]).select(_FIELDS)


def _write(rows: DataFrame, path: str) -> None:
    """Rows by bucket; AQE splits buckets of many rows over tasks and joins small ones."""
    bucketed = rows.withColumn("bucket", _bucket_of()).hint("rebalance", "bucket")
    bucketed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def keep_latest(
    batch: DataFrame, batch_id: int, folder: str, max_events: int, snapshot_every: int
) -> DataFrame:
    """Store a batch's accounts with their newest events, and return those of the accounts the
    batch touches."""
    spark = batch.sparkSession
    snapshot = int(batch_id > 0 and batch_id % snapshot_every == 0)
    touched = batch.filter("login IS NOT NULL").select("login").distinct()
    # BUCKETS numbers at most.
    opened = None
    if not snapshot:
        opened = [r[0] for r in touched.select(_bucket_of()).distinct().collect()]
    log = _stored(spark, folder, batch_id, opened)
    rows = latest_events(batch, max_events).select(_FIELDS)
    if log is not None:
        known = log if snapshot else log.join(touched, "login", "left_semi")
        rows = latest_events(rows.unionByName(_current(known)), max_events).select(_FIELDS)
    path = f"{folder}/snapshot={snapshot}/batch_id={batch_id}"
    _write(rows, path)
    kept = spark.read.schema(S.FLAT_EVENT).parquet(path).select(_FIELDS)
    return kept.join(touched, "login", "left_semi") if snapshot else kept


def store_latest_events(
    flat: DataFrame,
    output: str,
    checkpoint: str,
    max_events: int = S.PAGE_SIZE * S.MAX_PAGES,
    late_by: str | None = None,
    snapshot_every: int = SNAPSHOT_EVERY,
    **trigger,
) -> StreamingQuery:
    """Start keeping the newest events of each account below `output`."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        keep_latest(batch, batch_id, output, max_events, snapshot_every)

    return start(arriving(flat, late_by), checkpoint, publish, trigger)


def start(stream: DataFrame, checkpoint: str, publish, trigger: dict) -> StreamingQuery:
    return (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .foreachBatch(publish)
        .start()
    )


def current_events(spark: SparkSession, output: str) -> DataFrame:
    """The kept events of each account as of the last batch that touched it."""
    return _current(_stored(spark, output))


def compact_events(spark: SparkSession, output: str, target: str) -> None:
    """Write the current events as one snapshot, to replace a long log of batches."""
    _write(current_events(spark, output), f"{target}/snapshot=1/batch_id=0")
