"""Features and runs from stitched ranges: against the plans that hold an account in one task."""

import random
import re

import pytest
from helpers import event, flat, issue, issue_comment, pr_comment, pull, push, release, tag
from test_dense_random import crowd as colliding, sql_rows

from forgepulse import schema as S
from forgepulse.operators import any_size, features, looks
from forgepulse.operators.numbering import PART
from forgepulse.plans import oracle, pipeline

COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"


@pytest.fixture
def many_ranges(spark):
    """Ranges of a few rows each."""
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(COALESCE, "false")
    spark.conf.set(PARTITIONS, "7")
    yield
    spark.conf.unset(COALESCE)
    spark.conf.set(PARTITIONS, before)


def crowd(seed, accounts, size, repositories):
    """Long runs, gaps of zero, missing repositories and times, one account with most rows."""
    rng = random.Random(seed)
    rows, second, repository = [], 0, None
    for n in range(size):
        second += rng.choice([0, 0, 5, 600, 600, rng.randrange(90_000)])
        if rng.random() < 0.15:
            repository = rng.choice([None, *repositories])
        login = "hot" if rng.random() < 0.6 else f"u{rng.randrange(accounts)}"
        time = None if rng.random() < 0.03 else second
        if rng.random() < 0.7:
            rows.append(push(n, time, login=login, repository=repository))
        else:
            rows.append(event(n, S.FORK, time, login=login, repository=repository))
    rng.shuffle(rows)
    return rows


def close(left, right):
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert a == pytest.approx(b, abs=0.00101, nan_ok=True) if isinstance(b, float) else a == b


@pytest.mark.parametrize("seed, size", [(1, 300), (2, 90), (3, 12), (4, 1)])
def test_features_as_by_one_task(spark, many_ranges, seed, size):
    rows = crowd(seed, 5, size, ["a/x", "a/y", "b/x", "odd"])
    table = flat(spark, rows).cache()
    columns = ["contributor", *S.FEATURES, "events"]
    got = pipeline.features_of_any_size(table).select(columns).orderBy("contributor").collect()
    expected = pipeline.features_of(table).select(columns).orderBy("contributor").collect()
    assert len(got) == len(expected) > 0
    for a, b in zip(got, expected):
        close(a, b)


@pytest.mark.parametrize("of", ["repository_runs", "type_runs"])
@pytest.mark.parametrize("repositories", [["a/x"], ["a/x", "a/y", "b/x"]])
def test_runs_reach_over_ranges(spark, many_ranges, of, repositories):
    activities = pipeline.activities_of(flat(spark, crowd(9, 3, 200, repositories))).cache()
    got = getattr(any_size, of)(activities)
    expected = getattr(features, of)(activities).select(got.columns)
    order = ["contributor", "run_id"]
    assert got.orderBy(order).collect() == expected.orderBy(order).collect()


def test_one_run_over_all_ranges(spark, many_ranges):
    rows = [push(n, 60 * n, repository="a/x") for n in range(200)]
    activities = pipeline.activities_of(flat(spark, rows)).cache()
    ranges = any_size.time_ranges(activities)
    assert ranges.selectExpr(f"{PART} AS part").distinct().count() > 5
    (run,) = any_size.repository_runs(activities).collect()
    assert (run.activities, run.run_id) == (200, 1)
    row = any_size.extract_features(activities).first()
    assert row.NCAR_mean == 200.0 and row.DCAR_mean == pytest.approx(199 / 60, abs=0.001)


def test_no_window_is_by_account_alone(spark, many_ranges):
    """Except over the one row per account and range."""
    activities = pipeline.activities_of(flat(spark, crowd(5, 3, 60, ["a/x", "b/x"]))).cache()
    activities.count()
    plan = any_size.extract_features(activities)._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "Window" in line and "__at" in line]
    assert over_rows and all("part#" in line for line in over_rows)
    assert "collect_" not in plan


def test_no_events(spark):
    assert pipeline.features_of_any_size(flat(spark, [])).collect() == []
    assert any_size.repository_runs(pipeline.activities_of(flat(spark, []))).collect() == []


def test_account_without_a_name(spark, many_ranges):
    rows = [push(n, 60 * n, login=None, repository=f"a/{n % 2}") for n in range(30)]
    table = flat(spark, rows)
    columns = ["contributor", *S.FEATURES]
    got = pipeline.features_of_any_size(table).select(columns).collect()
    expected = pipeline.features_of(table).select(columns).collect()
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        close(a, b)


FATE = ["event_id", "login", "prev_1", "next_1", "prev_2", "next_2", "merge_push", "taken_1", "taken_2"]
GATES = [
    "transfer_open", "close_open", "pr_reopen_open", "reviews_known", "review_comments_known",
    "reopen_open", "pr_close_open",
]


def one_login(rows):
    return [row | {"login": "hot", "event_id": n} for n, row in enumerate(rows)]


@pytest.mark.parametrize("alone", [True, False])
def test_pairs_reach_over_ranges(spark, many_ranges, alone):
    rows = colliding(12, accounts=30, events=60)
    rows = one_login(rows) if alone else rows
    table = flat(spark, rows).cache()
    columns = [*FATE, *GATES, "prev_1_id", "next_1_id", "prev_2_node", "next_2_node"]
    got, expected = (
        resolved(table)
        .selectExpr(*[
            # a neighbour is named only where it is the other half
            f"CASE WHEN {c[:6]} THEN {c} END AS {c}" if c[6:] in ("_id", "_node") else c
            for c in columns
        ])
        .orderBy("event_id", "login")
        .collect()
        for resolved in (pipeline.resolved_events_of_any_size, pipeline.resolved_events)
    )
    assert got == expected
    assert sum(r.taken_1 for r in got) > 5 and any(r.taken_2 for r in got)
    assert any(r.merge_push for r in got)


def test_activities_of_any_size_match_sql(spark, many_ranges):
    rows = colliding(13, accounts=12, events=60)
    columns = ["contributor", "repository", "activity", "date", "event_id"]
    expected = sql_rows(rows, f"SELECT {', '.join(columns)} FROM activities", oracle.activity_parts())
    found = pipeline.activities_of_any_size(flat(spark, rows)).select(*columns).collect()
    assert sorted(map(tuple, found)) == sorted(expected) != []


def test_pairs_of_one_per_range(spark, many_ranges):
    """Main event, companion and rival each in a range of their own; a tag far from its release."""
    rows = [
        release(1, 0), tag(2, 500_000), tag(3, 500_001),
        issue(4, 10, "closed"), issue_comment(5, 11, state="closed"),
        pull(6, 20, "closed", merged=True), push(7, 22), push(8, 25), push(9, 18),
        pull(10, 40, "closed", pr=3), pr_comment(11, 900_000, pr=3, state="closed"),
    ]
    table = flat(spark, rows)
    columns = ["event_id", "taken_1", "taken_2", "merge_push"]
    got = pipeline.resolved_events_of_any_size(table).select(columns).orderBy("event_id").collect()
    assert got == pipeline.resolved_events(table).select(columns).orderBy("event_id").collect()
    assert {r.event_id for r in got if r.merge_push} == {6, 7, 9}


def test_events_without_id_or_time_all_stay(spark, many_ranges):
    rows = [push(None, None) for _ in range(40)] + [push(7, None)] * 5 + [push(8, 3)] * 5
    got = pipeline.resolved_events_of_any_size(flat(spark, rows))
    assert got.count() == pipeline.resolved_events(flat(spark, rows)).count() == 42


def test_no_window_over_events_is_by_account(spark, many_ranges):
    """Windows by account or group hold the one row per range; those over events name the range or
    the second, and no task needs all events of an account."""
    table = flat(spark, one_login(colliding(15, accounts=5, events=40)))
    plan = pipeline.activities_of_any_size(table)._jdf.queryExecution().optimizedPlan().toString()
    over_events = [w for w in plan.splitlines() if "Window" in w and ("__at" in w or "event_id" in w)]
    assert over_events and all("part#" in w or "sort_time#" in w for w in over_events)
    assert "collect_" not in plan


def test_no_frame_shrinks_towards_the_end_of_its_group(spark, many_ranges):
    """Such a frame is computed anew for every row: quadratic in the events of a range."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    resolved = pipeline.resolved_events_of_any_size(flat(spark, crowd(6, 2, 40, ["a/x"])))
    plan = resolved._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    frames = re.findall(r"specifiedwindowframe\(RowFrame, ([\w-]+)\S*, ([\w-]+)", plan)
    assert ("unboundedpreceding", "currentrow") in frames
    assert not [f for f in frames if f[0] != "unboundedpreceding" and f[1] == "unboundedfollowing"]


def test_events_are_ranged_once_and_round_1_is_not_found_again(spark, many_ranges, monkeypatch):
    """Both rounds use the same ranges, and what follows reads what round 1 stored."""
    made, ranged = [], looks.ranged

    def counted(df, order, name):
        made.append(name)
        return ranged(df, order, name)

    monkeypatch.setattr(looks, "ranged", counted)
    got = pipeline.resolved_events_of_any_size(flat(spark, colliding(16, accounts=5, events=40)))
    assert made == ["resolving"]
    assert all("/paired-" in file for file in got.inputFiles())
    assert got.count() > 0
