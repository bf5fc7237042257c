"""Series, statistics and rounding on cases worked out by hand, and the shape of the plan."""

import random

import numpy as np
import pytest
from helpers import event, flat, push

from forgepulse import schema as S
from forgepulse.operators import features
from forgepulse.plans import pipeline


def test_feature_list():
    assert len(S.FEATURES) == 38
    assert S.FEATURES[:5] == ["NA", "NT", "NOR", "ORR", "DCA_mean"]
    assert S.FEATURES[-1] == "NAT_IQR"


def test_one_activity(spark):
    row = pipeline.features_of(flat(spark, [event(1, S.FORK)])).first()
    assert (row.NA, row.NT, row.NOR, row.ORR) == (1, 1, 1, 1.0)
    assert row.DCA_mean is None and row.DCA_median is None
    assert row.DCA_std == 0.0 and row.DCA_gini == 0.0
    assert row.DAAR_IQR is None and row.DCAT_std == 0.0
    assert row.DCAR_mean == 0.0 and row.NCAR_mean == 1.0 and row.NAR_gini == 0.0


def test_runs_and_series(spark):
    hour = 3600
    rows = [
        push(1, 0, repository="a/x"),
        push(2, hour, repository="a/x"),
        event(3, S.FORK, 3 * hour, repository="a/x"),
        push(4, 6 * hour, repository="b/y"),
        push(5, 10 * hour, repository="a/x"),
    ]
    activities = pipeline.activities_of(flat(spark, rows))
    row = features.all_statistics(activities).first()
    assert (row.NA, row.NT, row.NOR, row.ORR) == (5, 2, 2, 1.0)
    assert (row.DCA_mean, row.DCA_median) == (2.5, 2.5)  # 1 2 3 4
    assert row.DCA_std == 1.291 and row.DCA_gini == 0.25 and row.DCA_IQR == 1.5
    assert (row.NAR_mean, row.NAR_IQR) == (2.5, 1.5)  # 4 1
    assert row.NTR_mean == 1.5  # 2 1
    assert row.NCAR_mean == pytest.approx(5 / 3, abs=0.001)  # 3 1 1
    assert row.DCAR_mean == 1.0  # 3 0 0
    assert row.DAAR_mean == 3.5  # 3 4
    assert row.DCAT_mean == 2.5  # 2 3
    assert row.NAT_mean == 2.5  # 4 1
    runs = features.repository_runs(activities).orderBy("run_id").collect()
    assert [(r.repository, r.activities, r.time_spent, r.time_to_switch) for r in runs] == [
        ("a/x", 3, 3.0, 3.0), ("b/y", 1, 0.0, 4.0), ("a/x", 1, 0.0, None),
    ]


def test_missing_repository_and_time(spark):
    rows = [
        push(1, 0, repository=None),
        push(2, 60, repository=None),
        push(3, None, repository="a/x"),
        event(4, S.FORK, 120, repository="odd"),
    ]
    row = features.all_statistics(pipeline.activities_of(flat(spark, rows))).first()
    assert row.NA == 4 and row.NT == 2 and row.NOR == 2
    assert row.NAR_mean == 1.0 and row.NCAR_mean == 1.0  # missing repositories never join a run
    assert row.NAT_mean == 1.0  # one push and one fork have a repository
    assert row.DCA_mean == pytest.approx(1 / 60, abs=0.001)


def test_ties_round_to_even(spark):
    rows = [push(1, 0), push(2, 1809)]  # 0.5025 hours
    assert pipeline.features_of(flat(spark, rows)).first().DCA_mean == 0.502


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Flat events in a file: the size is known, so no early trimming is planned."""
    path = str(tmp_path_factory.mktemp("flat"))
    rows = [push(1, 0), push(2, 9), event(3, S.FORK, 30)]
    flat(spark, rows).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_chain_has_one_shuffle(stored):
    plan = plan_of(pipeline.features_of(stored))
    assert plan.count("Exchange") == 1
    assert "Join" not in plan and "Python" not in plan


def test_no_series_is_collected_into_a_row(stored):
    plan = plan_of(pipeline.features_of(stored))
    assert "collect_" not in plan and "sort_array(DCA" not in plan


def test_ranked_statistics_match_numpy(spark):
    rng = random.Random(4)
    seconds, rows = 0, []
    for n in range(700):
        seconds += rng.choice([0, 0, 600, 600, rng.randrange(90_000)])
        rows.append(push(n, seconds, repository=f"o{n % 3}/r{rng.randrange(9)}"))
    row = features.all_statistics(pipeline.activities_of(flat(spark, rows))).first()
    gaps = np.diff([r["created_at"].timestamp() for r in rows]) / 3600
    first, median, third = np.quantile(gaps, [0.25, 0.5, 0.75])
    some = np.sort(gaps[gaps != 0])
    n, ranks = len(some), np.arange(1, len(some) + 1)
    gini = ((2 * ranks - n - 1) * some).sum() / (n * some.sum())
    expected = [gaps.mean(), median, gaps.std(ddof=1), gini, third - first]
    assert [row[f"DCA_{s}"] for s in S.STATISTICS] == pytest.approx(expected, abs=0.00051)
    assert row.NOR == 3 and row.NA == 700


def test_a_plain_activity_needs_no_pairing(stored):
    plan = plan_of(pipeline.activities_of(stored, only=[9]))
    assert "lead(" not in plan and "collect_list" not in plan


def test_only_needed_columns_are_read(stored):
    plan = plan_of(pipeline.activities_of(stored, only=[9]).select("contributor", "date"))
    schema = plan[plan.index("ReadSchema") :]
    assert "PR_number" not in schema and "push_id" not in schema and "login" in schema
