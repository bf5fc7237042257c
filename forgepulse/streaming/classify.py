"""Verdicts that follow a stream of events.

The companions of an event may arrive in a later batch, so nothing is patched: the accounts a
batch touches are judged anew from their newest events. Each batch writes its verdicts to a
folder of its own, overwritten when the batch is repeated after a failure; readers take the last
verdict of each account.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from forgepulse import schema as S
from forgepulse.operators.limits import count_events, latest_events
from forgepulse.operators.verdict import declared_verdicts, gated_verdicts
from forgepulse.plans.pipeline import (
    MAX_EVENTS,
    Scorer,
    accounts_for,
    features_of_latest,
    users_among,
    with_event_counts,
)
from forgepulse.sources.folders import shared_folder  # noqa: F401  (also known by this module)
from forgepulse.sources.results import write_results
from forgepulse.streaming.latest import SNAPSHOT_EVERY, arriving, keep_latest, start

VERDICT = (
    "contributor string, type string, confidence double, events bigint, "
    + ", ".join(f"`{f}` {'bigint' if f in ('NA', 'NT', 'NOR') else 'double'}" for f in S.FEATURES)
)


def judge_batch(
    flat: DataFrame, accounts: DataFrame, score: Scorer, min_events: int, max_events: int
) -> DataFrame:
    """Verdicts of the accounts in `flat`, which holds all kept events of each."""
    latest = latest_events(flat, max_events)
    # Accounts without any activity have no features but are part of the batch nevertheless.
    declared = accounts_for(latest.filter("event_rank = 1").select("login"), accounts)
    judged_by_model = latest.join(users_among(declared), "login", "left_semi")
    counted = count_events(judged_by_model)
    judged = gated_verdicts(score(features_of_latest(counted)), min_events)
    return declared_verdicts(declared, with_event_counts(flat, max_events, judged))


def classify_stream(
    flat_stream: DataFrame,
    accounts: DataFrame,
    score: Scorer,
    output: str,
    checkpoint: str,
    min_events: int = 5,
    max_events: int = MAX_EVENTS,
    late_by: str | None = None,
    file_format: str = "parquet",
    kept: str | None = None,
    snapshot_every: int = SNAPSHOT_EVERY,
    **trigger,
) -> StreamingQuery:
    """Start the stream; `trigger` goes to the writer, e.g. `availableNow=True`.

    Verdicts are written as parquet, csv, json or text. The newest events of each account are
    stored in the folder `kept`, beside the checkpoint unless given.
    """
    state = kept or f"{checkpoint.rstrip('/')}-events"

    def publish(batch: DataFrame, batch_id: int) -> None:
        events = keep_latest(batch, batch_id, state, max_events, snapshot_every)
        verdicts = judge_batch(events, accounts, score, min_events, max_events)
        write_results(verdicts, f"{output}/batch_id={batch_id}", file_format)

    return start(arriving(flat_stream, late_by), checkpoint, publish, trigger)


def current_verdicts(
    spark: SparkSession, output: str, file_format: str = "parquet"
) -> DataFrame:
    """The last verdict of each account; combined before the shuffle, so hot accounts are cheap."""
    columns = ["contributor", "type", "confidence", "events", *S.FEATURES]
    reader = spark.read.schema(f"{VERDICT}, batch_id bigint").option("header", True)
    log = reader.format(file_format).load(output)
    return (
        log.groupBy("contributor")
        .agg(F.max_by(F.struct(*columns), "batch_id").alias("last"))
        .select("last.*")
    )


def compact_verdicts(spark: SparkSession, output: str, target: str) -> None:
    """Write the current verdicts as one table, to replace a long log of batches."""
    current_verdicts(spark, output).write.mode("overwrite").parquet(f"{target}/batch_id=0")
