"""Streams in several batches end where one batch over everything ends."""

import json
from types import SimpleNamespace

import pytest

from forgepulse.operators.extract import flatten_events
from forgepulse.plans import pipeline, testbed
from forgepulse.sources.events import read_events, stream_events
from forgepulse.sources.folders import shared_folder
from forgepulse.streaming import classify, latest
from helpers import event, flat

SF = "/root/testdata/sf0.001"
COLUMNS = ["contributor", "type", "confidence", "events", "NA", "NT", "DCA_mean", "NAT_gini", "DAAR_IQR"]


@pytest.fixture(scope="module")
def slices(spark, tmp_path_factory):
    """The derived events in three files; companions and repeats fall into different ones."""
    folder = tmp_path_factory.mktemp("slices")
    raw = testbed.raw_events(spark, SF).selectExpr("*", "CAST(id AS bigint) % 3 AS part").cache()
    for part in range(3):
        raw.filter(f"part = {part}").drop("part").coalesce(1).write.mode("append").json(str(folder))
    repeated = raw.filter("CAST(id AS bigint) % 10 = 0").drop("part")
    repeated.coalesce(1).write.mode("append").json(str(folder))
    return str(folder)


@pytest.mark.parametrize("max_events, late_by", [(300, None), (300, "3650 days"), (20, None)])
def test_stream_equals_batch(spark, slices, tmp_path, max_events, late_by):
    flat = flatten_events(stream_events(spark, slices, max_files_per_trigger=1))
    accounts = testbed.accounts(spark, SF)
    query = classify.classify_stream(
        flat, accounts, testbed.fixed_score, str(tmp_path / "out"), str(tmp_path / "checkpoint"),
        max_events=max_events, late_by=late_by, snapshot_every=2, availableNow=True,
    )
    query.awaitTermination()
    assert len(list((tmp_path / "out").iterdir())) >= 4
    # Repeats count as in batch, unless a watermark removes them.
    whole = flatten_events(read_events(spark, slices))
    if late_by:
        whole = whole.dropDuplicates(["event_id"])
    expected = pipeline.classify_accounts(
        accounts, whole, testbed.fixed_score, max_queries=1, page_size=max_events
    )
    found = classify.current_verdicts(spark, str(tmp_path / "out"))
    assert sorted(map(str, found.select(COLUMNS).collect())) == sorted(
        map(str, expected.select(COLUMNS).collect())
    )


def test_compaction_keeps_the_last_verdicts(spark, tmp_path):
    rows = [("a", "Human"), ("b", "Bot")]
    wide = pipeline.features_of(testbed.flat_events(spark, SF)).limit(0)
    blank = ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in wide.dtypes if c not in ("contributor", "events"))
    for batch, (name, kind) in enumerate([*rows, ("a", "Bot")]):
        spark.sql(
            f"SELECT '{name}' AS contributor, '{kind}' AS type, 0.5D AS confidence, 7L AS events, {blank}"
        ).write.parquet(str(tmp_path / "log" / f"batch_id={batch}"))
    classify.compact_verdicts(spark, str(tmp_path / "log"), str(tmp_path / "small"))
    found = classify.current_verdicts(spark, str(tmp_path / "small")).collect()
    assert sorted((r.contributor, r.type) for r in found) == [("a", "Bot"), ("b", "Bot")]


def test_shared_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert classify.shared_folder(spark, "x").startswith(f"{base}/x-")


@pytest.mark.parametrize("late_by", [None, "3650 days"])
def test_events_without_id_are_all_kept(spark, tmp_path, late_by):
    raw = [
        {"type": kind, "actor": {"login": "ann"}, "created_at": "2024-02-03T04:05:06Z"}
        for kind in ("WatchEvent", "ForkEvent", "PublicEvent")
    ]
    (tmp_path / "in").mkdir()
    for i, row in enumerate(raw):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(row))
    flat = flatten_events(stream_events(spark, str(tmp_path / "in"), max_files_per_trigger=1))
    out = str(tmp_path / "out")
    query = latest.store_latest_events(
        flat, out, str(tmp_path / "checkpoint"), late_by=late_by, availableNow=True
    )
    query.awaitTermination()
    kinds = [r.event_type for r in latest.current_events(spark, out).collect()]
    assert sorted(kinds) == ["ForkEvent", "PublicEvent", "WatchEvent"]
    latest.compact_events(spark, out, str(tmp_path / "small"))
    assert latest.current_events(spark, str(tmp_path / "small")).count() == 3


@pytest.mark.parametrize("file_format", ["csv", "json", "text"])
def test_verdicts_in_the_format_asked_for(spark, slices, tmp_path, file_format):
    out = str(tmp_path / "out")
    classify.classify_stream(
        flatten_events(stream_events(spark, slices)), testbed.accounts(spark, SF),
        testbed.fixed_score, out, str(tmp_path / "checkpoint"), file_format=file_format,
        availableNow=True,
    ).awaitTermination()
    if file_format == "text":
        assert spark.read.text(out).count() == 15
    else:
        found = classify.current_verdicts(spark, out, file_format)
        assert found.count() == 15 and found.filter("NA > 0").count() > 5


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master}

        def get(self, key, default):
            return self.values.get(key, default)

    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(conf=Conf("spark://host:7077")), "x")
    assert "/x-" in shared_folder(SimpleNamespace(conf=Conf("local[2]")), "x")


@pytest.mark.parametrize("parts", [0, 3])
def test_derived_events_are_streamed_whole(spark, tmp_path, parts):
    """`events.parquet` may be a file or a folder of part files."""
    table = spark.range(90).selectExpr(
        "id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' AS ts", "id % 4 AS user_id"
    )
    table.repartition(parts or 1).write.parquet(str(tmp_path / "events.parquet"))
    if not parts:
        part = next((tmp_path / "events.parquet").glob("part-*"))
        (tmp_path / "one").mkdir()
        (tmp_path / "one" / "events.parquet").write_bytes(part.read_bytes())
    sf_dir = str(tmp_path if parts else tmp_path / "one")
    stream = testbed.stream_raw_events(spark, sf_dir).writeStream.trigger(availableNow=True)
    out = str(tmp_path / "out")
    stream.option("checkpointLocation", str(tmp_path / "marks")).format("parquet").start(out).awaitTermination()
    assert spark.read.parquet(out).count() == testbed.raw_events(spark, sf_dir).count() > 90


def _ids(df):
    return sorted((r["login"], r["event_id"]) for r in df.collect())


def test_a_folder_that_a_killed_driver_left_empty(spark, tmp_path):
    folder = str(tmp_path / "events")
    (tmp_path / "events" / "snapshot=0" / "batch_id=0").mkdir(parents=True)
    first = flat(spark, [event(1, "ForkEvent", 1), event(2, "ForkEvent", 2, login="bob")])
    for _ in range(2):  # the repeated batch ends as it should, however often
        assert _ids(latest.keep_latest(first, 0, folder, 5, 50)) == [("ann", 1), ("bob", 2)]
    # A later batch dies with part of its files written, and is repeated.
    second = flat(spark, [event(3, "ForkEvent", 3)])
    latest.keep_latest(flat(spark, [event(9, "ForkEvent", 9)]), 1, folder, 5, 50)
    (tmp_path / "events" / "snapshot=0" / "batch_id=1" / "_SUCCESS").unlink()
    assert _ids(latest.keep_latest(second, 1, folder, 5, 50)) == [("ann", 1), ("ann", 3)]
    assert _ids(latest.current_events(spark, folder)) == [("ann", 1), ("ann", 3), ("bob", 2)]


def test_a_small_batch_opens_the_buckets_it_touches_only(spark, tmp_path):
    folder = str(tmp_path / "events")
    many = [event(i, "ForkEvent", 1, login=f"user{i}") for i in range(300)]
    latest.keep_latest(flat(spark, many), 0, folder, 5, 50)
    stored = spark.read.parquet(folder)
    (own,) = [r["bucket"] for r in stored.filter("login = 'user7'").collect()]
    files = list((tmp_path / "events").rglob("*.parquet"))
    assert len({f.parent.name for f in files}) > 50
    for file in files:
        if file.parent.name != f"bucket={own}":
            file.write_bytes(b"not to be opened")
    kept = latest.keep_latest(flat(spark, [event(999, "ForkEvent", 5, login="user7")]), 1, folder, 5, 50)
    assert _ids(kept) == [("user7", 7), ("user7", 999)]
