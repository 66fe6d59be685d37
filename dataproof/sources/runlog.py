"""A log of the checks that ran, as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY_LENGTH = 200
RUN_LOG_SCHEMA = "timestamp STRING, tool STRING, outcome STRING, durationMs BIGINT, summary STRING, text STRING"


def summary_line(text: Column, length: int = SUMMARY_LENGTH) -> Column:
    """The first line of a text, cut to the length of a summary."""
    line = F.trim(F.element_at(F.split(text, "\n", 2), 1))
    cut = F.concat(F.substring(line, 1, length - 3), F.lit("..."))
    return F.when(F.length(line) > length, cut).otherwise(line)


def run_log_rows(runs: DataFrame, length: int = SUMMARY_LENGTH) -> DataFrame:
    """Log entries for ``finished_at, name, failed, duration_ms, text``: a summary and the whole text."""
    return runs.select(
        F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.col("name").alias("tool"),
        F.when(F.col("failed"), "error").otherwise("ok").alias("outcome"),
        F.col("duration_ms").cast("bigint").alias("durationMs"),
        summary_line(F.col("text"), length).alias("summary"),
        "text",
    )


def append_run_log(runs: DataFrame, path: str) -> None:
    """Appends one JSON record per run."""
    run_log_rows(runs).write.mode("append").json(path)


def read_run_log(spark, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG_SCHEMA).json(path)
