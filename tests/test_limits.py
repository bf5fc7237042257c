"""Newest events, early trimming of hot accounts, pages and repeats."""

import random

import pytest
from helpers import event, flat
from pyspark.sql import functions as F

from forgepulse import schema as S
from forgepulse.operators import limits


@pytest.fixture(scope="module")
def skewed(spark):
    """One account holds a third of all rows; times tie and some are missing."""
    rng = random.Random(11)
    rows = []
    for number in range(3000):
        login = "hot" if number % 3 == 0 else f"u{rng.randrange(120)}"
        second = None if rng.random() < 0.02 else rng.randrange(800)
        rows.append(event(number, S.PUSH, second, login=login))
        if rng.random() < 0.05:
            rows.append(dict(rows[-1]))
    return rows, flat(spark, rows).repartition(6).cache()


def newest(rows, limit):
    by_login = {}
    for r in rows:
        by_login.setdefault(r["login"], []).append(r)
    kept = []
    for login, own in by_login.items():
        own.sort(
            key=lambda r: (r["created_at"] is not None, r["created_at"] or 0, r["event_id"])
            if r["created_at"] is not None else (False, 0, r["event_id"]),
            reverse=True,
        )
        kept += [(login, r["event_id"]) for r in own[:limit]]
    return sorted(kept)


@pytest.mark.parametrize("guard", [False, True])
@pytest.mark.parametrize("limit", [5, 60])
def test_latest_events(skewed, guard, limit):
    rows, table = skewed
    if guard:
        table = limits.trim_hot_accounts(table, limit, min_rows=limit, salts=3)
    found = limits.latest_events(table, limit).select("login", "event_id")
    assert sorted(map(tuple, found.collect())) == newest(rows, limit)


def test_trimming_drops_only_old_events_of_hot_accounts(skewed):
    rows, table = skewed
    trimmed = limits.trim_hot_accounts(table, 40, min_rows=500)
    counts = {r["login"]: r["count"] for r in trimmed.groupBy("login").count().collect()}
    whole = {}
    for r in rows:
        whole[r["login"]] = whole.get(r["login"], 0) + 1
    assert 40 <= counts["hot"] <= 45
    assert all(counts[login] == n for login, n in whole.items() if login != "hot")


def test_all_times_missing_in_a_hot_account(spark):
    rows = [event(n, S.PUSH, None, login="hot") for n in range(50)]
    trimmed = limits.trim_hot_accounts(flat(spark, rows), 10, min_rows=10)
    kept = limits.latest_events(trimmed, 10).select("event_id").collect()
    assert sorted(r.event_id for r in kept) == list(range(40, 50))


def test_limit_prunes_before_the_only_shuffle(skewed):
    _, table = skewed
    plan = limits.latest_events(table, 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.count("Exchange hashpartitioning(login") == 1


def test_events_without_account_are_left_out(spark):
    rows = [event(1, S.PUSH, 0, login=None), event(2, S.PUSH, 0)]
    assert [r.event_id for r in limits.latest_events(flat(spark, rows)).collect()] == [2]


def test_pages(spark):
    rows = [event(n, S.PUSH, n) for n in range(5)] + [event(9, S.PUSH, 0, login="bob")]
    paged = limits.page_of_event(limits.latest_events(flat(spark, rows)), 2)
    found = {r.event_id: (r.page, r.last_page) for r in paged.collect()}
    assert found == {4: (1, False), 3: (1, False), 2: (2, False), 1: (2, False), 0: (3, True), 9: (1, True)}


def test_dedup_needs_no_shuffle_beyond_the_limit(skewed):
    rows, table = skewed
    deduplicated = limits.dedup_events(limits.latest_events(table, 10_000))
    assert deduplicated.count() == len({(r["login"], r["event_id"]) for r in rows})
    plan = deduplicated._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_events_without_id_are_no_copies(spark):
    rows = [event(None, S.PUSH, 0), event(None, S.FORK, 0)]
    assert limits.dedup_events(limits.latest_events(flat(spark, rows))).count() == 2


def test_count_includes_repeats(spark):
    rows = [event(1, S.PUSH, 0), event(1, S.PUSH, 0), event(2, S.PUSH, 1)]
    counted = limits.count_events(limits.latest_events(flat(spark, rows)))
    assert counted.select(F.max("events")).first()[0] == 3


def test_partitions_by_account_stay_small(spark):
    """What a task holds is bounded by the size of a partition, however few are asked for."""
    rows = spark.range(300_000).selectExpr(
        "concat('user', id % 5000) AS login", "unhex(sha2(string(id), 512)) AS a", "unhex(sha2(string(-id), 512)) AS b"
    )
    shuffled = 300_000 * 128  # bytes at least, as digests don't compress
    assert limits.count_events(rows).rdd.getNumPartitions() > shuffled // (16 << 20) + 2
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_splits_do_not_grow_with_the_input(spark, tmp_path):
    """A task sorts its split by account before the shuffle; 64 MB on 4 cores were splits of 16 MB."""
    (tmp_path / "events.txt").write_text("x" * 1023 + "\n")
    with open(tmp_path / "events.txt", "a") as file:
        for _ in range(64):
            file.write(("x" * 1023 + "\n") * 1024)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 8
