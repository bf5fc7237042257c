"""Number rows in a total order without passing them through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from forgepulse.sources.folders import shared_folder

_PART_BITS = 33  # `monotonically_increasing_id` has the partition above them, the row below
PART = f"shiftright(__at, {_PART_BITS})"  # the range of a row of `ranged`


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` stored as it is and read back."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ranged(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """`df` stored in sorted ranges of `order` (ascending, NULL first), read back with `__at`.

    `__at` ascends with the order through all ranges, so it stands for the order of rows equal in
    `order` as well. Rows equal in `order` lie in one range: give an order with few of them.
    """
    folder = shared_folder(df.sparkSession, name)
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
        .write.parquet(folder)
    )
    schema = StructType([*df.schema.fields, StructField("__at", LongType())])
    return df.sparkSession.read.schema(schema).parquet(folder)


def numbered(df: DataFrame, order: Sequence[str], place: str = "place") -> DataFrame:
    """`df` with its gapless place from 1 in the order of `order` (ascending, NULL first).

    Rows are range-partitioned, sorted within the ranges and stored with their number there; the sizes
    of the ranges, one number each on the driver, are added up to where a range starts. Rows equal in
    `order` are spread over ranges like others and are numbered in any order. A column named as `place`
    is replaced.
    """
    spark = df.sparkSession
    held = df.drop(place).withColumn("__tie", F.rand(11))
    stored = ranged(held, [*order, "__tie"], "numbered").drop("__tie")
    part = F.expr(PART)
    sizes = stored.groupBy(part.alias("part")).count().collect()
    starts, before = [], 0
    for row in sorted(sizes):
        starts.append((row["part"], before))
        before += row["count"]
    offsets = spark.createDataFrame(starts, "__part bigint, __start bigint")  # one row per range
    in_range = F.col("__at").bitwiseAND((1 << _PART_BITS) - 1)
    return (
        stored.join(F.broadcast(offsets), part == F.col("__part"))
        .withColumn(place, F.col("__start") + in_range + 1)
        .drop("__at", "__part", "__start")
    )
