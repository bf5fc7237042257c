"""Readers for archived events, account declarations and login lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from forgepulse import schema as S


def read_events(spark: SparkSession, path: str | list[str], file_format: str = "json") -> DataFrame:
    """Nested events with the fixed schema: no inference pass, only the needed paths parsed."""
    return spark.read.schema(S.RAW_EVENT).format(file_format).load(path)


def stream_events(
    spark: SparkSession, path: str, file_format: str = "json", max_files_per_trigger: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(S.RAW_EVENT)
        .format(file_format)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(path)
    )


def read_accounts(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    """Declared type of each account, and whether looking it up failed."""
    return spark.read.schema(S.ACCOUNT).format(file_format).load(path)


def read_logins(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """First space-separated token of each line, with its place in the order of lines.

    Logins stay text. `input_pos` orders by file path, then by block and line within the file;
    how Spark packs files into tasks does not matter.
    """
    paths = [path] if isinstance(path, str) else path
    lines = spark.read.text(paths).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("input_pos"),
    )
    first = F.split("value", " ").getItem(0)
    return lines.filter(F.length(first) > 0).select(first.alias("login"), "input_pos")


def combine_logins(
    spark: SparkSession, named: Sequence[str] = (), listed: DataFrame | None = None
) -> DataFrame:
    """Logins given by name first, those of a list after them; order and repeats are kept."""
    rows = [(login, ("", 0, position)) for position, login in enumerate(named)]
    given = spark.createDataFrame(
        rows, "login string, input_pos struct<file: string, block: bigint, line: bigint>"
    )
    return given if listed is None else given.unionByName(listed)
