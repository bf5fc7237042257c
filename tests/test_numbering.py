"""Places in a total order, against a sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from forgepulse.operators.numbering import numbered
from forgepulse.sources.events import combine_logins, read_logins


@pytest.mark.parametrize("rows, parts", [(0, 1), (1, 1), (999, 7)])
def test_places_follow_the_order(spark, rows, parts):
    rng = random.Random(rows)
    values = [(rng.choice([None, *range(40)]), rng.random(), i) for i in range(rows)]
    df = spark.createDataFrame(values, "a int, b double, place long").repartition(parts)
    got = numbered(df.withColumnRenamed("place", "own"), ["a", "b"]).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, rows + 1))
    expected = sorted(values, key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
    assert [(r["a"], r["b"]) for r in got] == [v[:2] for v in expected]


def test_rows_of_equal_order_are_numbered_once_each_and_spread(spark):
    df = spark.range(2000).selectExpr("1 AS key", "id AS place", "id AS own")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        got = numbered(df, ["key"])
    finally:
        spark.conf.unset(setting)
    assert sorted(r["place"] for r in got.collect()) == list(range(1, 2001))
    assert got.select("own").distinct().count() == 2000
    tasks = got.select(F.input_file_name().alias("file")).distinct().count()
    assert tasks > 1


def test_long_lists_keep_the_order_of_lines_over_files(spark, tmp_path):
    spark.range(5000).orderBy("id").selectExpr("concat('user', id, ' x') AS value").repartitionByRange(
        6, F.expr("CAST(substr(value, 5, length(value) - 6) AS long)")
    ).sortWithinPartitions(F.expr("CAST(substr(value, 5, length(value) - 6) AS long)")).write.text(
        str(tmp_path / "list")
    )
    listed = read_logins(spark, str(tmp_path / "list"))
    got = numbered(combine_logins(spark, ["first", "first"], listed), ["input_pos"]).orderBy("place")
    assert [r["login"] for r in got.collect()] == ["first", "first", *[f"user{i}" for i in range(5000)]]
