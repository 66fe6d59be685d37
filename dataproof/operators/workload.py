"""Which query shapes dominate a query log?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataproof.functions.keys import qualified_name
from dataproof.functions.sqltext import clean_sql, normalize_query

DEFAULT_DAYS = 7
DEFAULT_SHAPES = 20

# Databases of the server itself.
SYSTEM_DATABASES = ["system", "INFORMATION_SCHEMA", "information_schema"]
TABLE_FUNCTION_PREFIX = "_table_function"


def log_filter(log: DataFrame, as_of: Column, days: int = DEFAULT_DAYS) -> DataFrame:
    """Finished top-level SELECTs of the last days before ``as_of``."""
    if days < 1:
        raise ValueError(f"a log filter needs at least one day, not {days}")
    since = as_of - F.make_dt_interval(F.lit(days))
    return log.filter(
        (F.col("type") == "QueryFinish")
        & (F.col("query_kind") == "Select")
        & F.col("is_initial_query")
        & (F.col("event_time") > since)
    )


def user_table_filter(log: DataFrame) -> DataFrame:
    """Queries that touch at least one table of a user."""

    def is_user_table(table: Column) -> Column:
        database = F.element_at(F.split(table, r"\."), 1)
        return ~database.isin(SYSTEM_DATABASES) & ~table.startswith(TABLE_FUNCTION_PREFIX)

    return log.filter(F.exists("tables", is_user_table))


def with_shape(log: DataFrame) -> DataFrame:
    """The log with the normalized text of each query and its hash; comments are no part of a shape."""
    return log.withColumn("shape", normalize_query(clean_sql(F.col("query")))).withColumn(
        "hash", F.sha2("shape", 256)
    )


def rank_workload(shaped: DataFrame, limit: int | None = DEFAULT_SHAPES) -> DataFrame:
    """The shapes that read most, with runs, totals and the tables they touch; all shapes without a limit.

    Runs without a table count as well; their shape then has an empty list.

    Every log row is spread over its tables and only the first of them carries the
    row's numbers. Counts then combine per (shape, table) before they meet per
    shape, so a shape with a third of the log never gathers its rows anywhere.
    """
    spread = shaped.select(
        "hash", "shape", "read_bytes", "query_duration_ms", F.posexplode_outer("tables").alias("pos", "table")
    )
    if limit is not None and limit < 1:
        raise ValueError(f"a ranking needs at least one shape, not {limit}")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    per_table = spread.groupBy("hash", "table").agg(
        F.min("shape").alias("shape"),
        F.sum(F.when(first, 1).otherwise(0)).alias("runs"),
        F.sum(F.when(first, F.col("read_bytes")).otherwise(0)).alias("read_bytes"),
        F.sum(F.when(first, F.col("query_duration_ms")).otherwise(0)).alias("duration_ms"),
    )
    ranked = (
        per_table.groupBy("hash")
        .agg(
            F.min("shape").alias("sample_query"),
            F.sum("runs").alias("runs"),
            F.sum("read_bytes").alias("total_read_bytes"),
            F.sum("duration_ms").alias("total_duration_ms"),
            F.array_sort(F.collect_set("table")).alias("tables"),
        )
        .orderBy(F.desc("total_read_bytes"), "hash")
    )
    return ranked if limit is None else ranked.limit(limit)


def flag_versioned_tables(
    ranked: DataFrame, versioned: DataFrame, default_database: str = "default"
) -> DataFrame:
    """Adds the tables of each shape that need collapsing on read.

    ``versioned`` has one qualified ``table`` per row; names without a database are
    taken to be in the default one.
    """
    known = versioned.select(
        qualified_name(F.col("table"), default_database).alias("qualified"), F.lit(True).alias("known")
    ).distinct()
    spread = ranked.withColumn("table", F.explode_outer("tables")).withColumn(
        "qualified", qualified_name(F.col("table"), default_database)
    )
    numbers = ["sample_query", "runs", "total_read_bytes", "total_duration_ms"]
    return (
        spread.join(known, "qualified", "left")
        .groupBy("hash")
        .agg(
            *[F.min(name).alias(name) for name in numbers],
            F.array_sort(F.collect_set("table")).alias("tables"),
            F.array_sort(F.collect_set(F.when(F.col("known"), F.col("table")))).alias("replacing_tables"),
        )
    )


def workload_summary(flagged: DataFrame) -> DataFrame:
    """One row: shapes, and how many of them read versioned tables; for all shapes rank without a limit."""
    return flagged.agg(
        F.count("*").alias("shapes"),
        F.count_if(F.size("replacing_tables") > 0).alias("reads_versioned"),
    )


def discover_workload(
    log: DataFrame,
    versioned: DataFrame,
    as_of: Column,
    days: int = DEFAULT_DAYS,
    limit: int | None = DEFAULT_SHAPES,
    default_database: str = "default",
) -> DataFrame:
    """The whole discovery: filter, normalize, rank, flag."""
    recent = user_table_filter(log_filter(log, as_of, days))
    ranked = rank_workload(with_shape(recent), limit)
    return flag_versioned_tables(ranked, versioned, default_database)
