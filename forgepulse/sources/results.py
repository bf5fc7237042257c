"""Writers and text rendering of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from forgepulse.functions.times import time_text


def write_results(results: DataFrame, path: str, file_format: str = "csv") -> None:
    """CSV with header, one JSON object per line, parquet, or text as `text_lines`.

    All rows are written; each task writes its own part file.
    """
    writer = results.write.mode("overwrite")
    if file_format == "csv":
        writer.option("header", True).csv(path)
    elif file_format == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif file_format == "parquet":
        writer.parquet(path)
    elif file_format == "text":
        text_lines(results).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown result format: {file_format}")


def as_text(results: DataFrame) -> DataFrame:
    """All columns as text, `-` for absent values."""
    return results.selectExpr(
        *[f"coalesce(CAST(`{c}` AS string), '-') AS `{c}`" for c in results.columns]
    )


def text_lines(results: DataFrame) -> DataFrame:
    """Every row as one line of tab-separated text."""
    columns = ", ".join(f"`{c}`" for c in results.columns)
    return as_text(results).selectExpr(f"concat_ws('\t', {columns}) AS value")


def preview_results(results: DataFrame, rows: int) -> None:
    """Print the first `rows` rows as a text table."""
    as_text(results).show(rows, truncate=False)


def with_date_text(activities: DataFrame) -> DataFrame:
    """Activities with `date` as ISO text with UTC offset, for text sinks."""
    return activities.selectExpr("* EXCEPT (date)", f"{time_text('date')} AS date")


def in_input_order(results: DataFrame) -> DataFrame:
    """Results in the order in which the logins were given, repeats included."""
    return results.orderBy("input_pos").drop("input_pos")
