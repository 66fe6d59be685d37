"""Duplicate keys, within partitions and across the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataproof.functions.canonical import canonical
from dataproof.functions.display import format_bytes, format_count
from dataproof.functions.literal import literal_rows
from dataproof.spec import TableSpec, as_column

DEFAULT_SAMPLE = 5


def key_copies(df: DataFrame, key: Sequence[str], partition: Column | str | None = None) -> DataFrame:
    """Copies per (partition, key). NULL keys equal each other.

    Counting combines on the map side: a key with a third of all rows leaves each
    task as one record.
    """
    copies = F.count("*").alias("copies")
    if partition is None:
        return df.groupBy(*key).agg(copies).select(F.lit("all").alias("partition"), *key, "copies")
    return (
        df.select(as_column(partition).alias("partition"), *key)
        .groupBy("partition", *key)
        .agg(copies)
    )


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("bigint")


def dup_within_partition(
    df: DataFrame, key: Sequence[str], partition: Column | str | None = None
) -> DataFrame:
    """One row: duplicated (partition, key) groups, surplus rows, most copies."""
    return (
        key_copies(df, key, partition)
        .filter("copies > 1")
        .agg(
            F.count("*").alias("duplicate_groups"),
            _zero(F.sum(F.col("copies") - 1)).alias("duplicate_rows"),
            _zero(F.max("copies")).alias("max_copies"),
        )
    )


def dup_global(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows that a latest-per-key read over the whole table would drop."""
    copies = df.groupBy(*key).agg(F.count("*").alias("copies"))
    return copies.agg(_zero(F.sum(F.col("copies") - 1)).alias("final_collapsible_rows"))


def duplicate_proof(
    df: DataFrame, key: Sequence[str], partition: Column | str | None = None
) -> DataFrame:
    """One row: within-partition, global and cross-partition duplicates, one scan.

    Copies are counted per (partition, key) and those counts summed per key, so the
    data is read once and only combined counts are shuffled again.
    """
    copies = key_copies(df, key, partition)
    per_key = _per_key(copies, key) if partition is not None else copies.select(
        F.col("copies").alias("rows"),
        (F.col("copies") - 1).alias("within"),
        F.when(F.col("copies") > 1, 1).otherwise(0).alias("groups"),
        F.when(F.col("copies") > 1, F.col("copies")).alias("most"),
    )
    return _proof_totals(per_key)


def _per_key(copies: DataFrame, key: Sequence[str]) -> DataFrame:
    repeated = F.col("copies") > 1
    return copies.groupBy(*key).agg(
        F.sum("copies").alias("rows"),
        F.sum(F.col("copies") - 1).alias("within"),
        F.sum(F.when(repeated, 1).otherwise(0)).alias("groups"),
        F.max(F.when(repeated, F.col("copies"))).alias("most"),
    )


def _proof_totals(per_key: DataFrame) -> DataFrame:
    totals = per_key.agg(
        _zero(F.sum("rows")).alias("total_rows"),
        _zero(F.sum("groups")).alias("duplicate_groups"),
        _zero(F.sum("within")).alias("duplicate_rows"),
        _zero(F.sum(F.col("rows") - 1)).alias("final_collapsible_rows"),
        _zero(F.max("most")).alias("max_copies"),
    )
    return totals.select(
        "total_rows",
        "duplicate_groups",
        "duplicate_rows",
        "final_collapsible_rows",
        (F.col("final_collapsible_rows") - F.col("duplicate_rows")).alias("cross_partition_rows"),
        "max_copies",
    )


def dup_cross_partition(df: DataFrame, key: Sequence[str], partition: Column | str) -> DataFrame:
    """One row: duplicates that no per-partition compaction ever removes."""
    rows = F.col("cross_partition_rows")
    return duplicate_proof(df, key, partition).select(
        rows,
        F.when(
            rows != 0,
            F.concat(format_count(rows), F.lit(" duplicate row(s) lie in different partitions; "
                                               "compaction within partitions keeps them.")),
        ).alias("warning"),
    )


def dup_sample(
    df: DataFrame,
    key: Sequence[str],
    partition: Column | str | None = None,
    limit: int = DEFAULT_SAMPLE,
) -> DataFrame:
    """The ``limit`` keys with the most copies within a partition."""
    if limit < 1:
        raise ValueError(f"a sample needs at least one key, not {limit}")
    return (
        key_copies(df, key, partition)
        .filter("copies > 1")
        .orderBy(F.desc("copies"), "partition", *key)
        .limit(limit)
    )


def scope_partition(df: DataFrame, partition: Column | str, value: object) -> DataFrame:
    """The rows of one partition; Spark prunes the files where the layout allows."""
    return df.filter(as_column(partition) == F.lit(value))


def scan_guard(
    stats: DataFrame,
    max_rows: int = 0,
    max_bytes: int = 0,
    scoped: bool = False,
) -> DataFrame:
    """One row: would an unscoped proof exceed a budget the caller sets? Zero, the default, means no limit.

    ``stats`` is a ``parts_summary`` row: sizes, not data.
    """
    over = F.lit(False)
    if max_rows > 0:
        over = over | (F.col("rows") > max_rows)
    if max_bytes > 0:
        over = over | (F.coalesce("bytes", F.lit(0)) > max_bytes)
    skipped = over & F.lit(not scoped)
    reason = F.concat(
        F.lit("The table has "), format_count(F.col("rows")), F.lit(" rows"),
        F.coalesce(F.concat(F.lit(" in "), format_bytes(F.col("bytes"))), F.lit("")),
        F.lit(", above the budget for a whole-table proof; name one partition or raise the budget."),
    )
    return stats.select(skipped.alias("scan_skipped"), F.when(skipped, reason).alias("reason"))


def ineligible_reason(spec: TableSpec, columns: Sequence[str]) -> str | None:
    if spec.fan_out:
        return "The table fans out to others; prove the table underneath."
    if not spec.versioned:
        return "The table does not deduplicate by key."
    if not spec.dedup_key:
        return "The table declares no dedup key."
    missing = [name for name in spec.dedup_key if name not in columns]
    if missing:
        return "The dedup key names missing columns: " + ", ".join(missing) + "."
    return None


def dedup_eligibility(spec: TableSpec, df: DataFrame) -> DataFrame:
    """One row: can a duplicate proof say anything about this table?"""
    reason = ineligible_reason(spec, df.columns)
    return literal_rows(
        df.sparkSession,
        [("table", "string"), ("eligible", "boolean"), ("reason", "string")],
        [(spec.name, reason is None, reason)],
    )


def latest_per_key(
    df: DataFrame, key: Sequence[str], version: str, deleted: str | None = None
) -> DataFrame:
    """One row per key: the highest version; keys whose latest row is deleted vanish.

    Equal versions are settled by the remaining columns, largest first, maps and
    variants by their canonical form, so the result does not depend on row order. Spark keeps the best row per key before
    the shuffle already (``WindowGroupLimit``), so hot keys stay small.
    """
    ties = [
        canonical(F.col(f"`{field.name}`"), field.dataType).desc()
        for field in df.schema.fields
        if field.name not in {*key, version}
    ]
    newest = Window.partitionBy(*key).orderBy(F.desc(version), *ties)
    latest = df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
    if deleted is not None:
        latest = latest.filter(~F.coalesce(F.col(deleted).cast("boolean"), F.lit(False)))
    return latest
