"""Schema and storage facts of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataproof.functions.literal import literal_rows
from dataproof.sources.footers import column_chunks, file_units, scan_units
from dataproof.spec import TableSpec, as_column


def column_profile(df: DataFrame, spec: TableSpec | None = None) -> DataFrame:
    """Columns in order with type, nullability, declared default expressions, codec and bytes.

    Codec, stored and plain bytes come from the footers of the table's Parquet files; they are NULL for frames that
    are no such table and for columns that no file has.
    """
    generated = dict(spec.generated) if spec else {}
    rows = [
        (position, field.name, field.dataType.simpleString(), field.nullable,
         *generated.get(field.name, (None, None)))
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    fields = [
        ("pos", "int"), ("name", "string"), ("type", "string"), ("nullable", "boolean"),
        ("default_kind", "string"), ("default_expr", "string"),
    ]
    columns, chunks = literal_rows(df.sparkSession, fields, rows), column_chunks(df)
    if chunks is None:
        return columns.withColumns(
            {"codec": F.lit(None).cast("string"), "stored_bytes": F.lit(None).cast("bigint"), "plain_bytes": F.lit(None).cast("bigint")}
        )
    return columns.join(chunks, "name", "left").select(*[name for name, _ in fields], "codec", "stored_bytes", "plain_bytes")


def storage_columns(part: Column | str | None, size: Column | str | None) -> tuple[Column, Column]:
    """The part a row is stored in, and that part's bytes.

    By default a part is a data file. A logical part has the size the caller states
    or an unknown (NULL) one.
    """
    if part is None:
        return F.col("_metadata.file_path"), F.col("_metadata.file_size")
    return as_column(part), as_column(size) if size is not None else F.lit(None).cast("bigint")


def part_units(
    df: DataFrame,
    partition: Column | str | None = None,
    part: Column | str | None = None,
    size: Column | str | None = None,
) -> DataFrame:
    """Rows and bytes per stored part and partition.

    Where parts are data files, from their footers, and only files of several partitions are scanned; else from one
    scan of few columns.
    """
    return storage_units(df, (), partition, part, size)


def storage_units(
    df: DataFrame,
    columns: Sequence[str],
    partition: Column | str | None,
    part: Column | str | None,
    size: Column | str | None,
) -> DataFrame:
    """``part_units`` with the least and greatest value of each column."""
    if part is None and size is None:
        units = file_units(df, partition, columns)
        if units is not None:
            return units
    value = as_column(partition) if partition is not None else F.lit("all")
    return scan_units(df, value, columns, *storage_columns(part, size))


def parts_summary(
    df: DataFrame,
    partition: Column | str | None = None,
    part: Column | str | None = None,
    size: Column | str | None = None,
) -> DataFrame:
    """One row: active parts, rows, bytes and distinct partitions."""
    return summarize_units(part_units(df, partition, part, size))


def summarize_units(units: DataFrame) -> DataFrame:
    """Totals over ``part_units``: each unit counts once as a part and once as a partition.

    Both counts come from one grouping of the few units; grouping them separately
    would read the table once for each.
    """
    as_part = F.struct(
        F.lit("part").alias("kind"), F.col("part").cast("string").alias("value"), "rows", "bytes"
    )
    as_partition = F.struct(
        F.lit("partition").alias("kind"), F.col("partition").cast("string").alias("value"),
        F.lit(0).cast("bigint").alias("rows"), F.lit(None).cast("bigint").alias("bytes"),
    )
    distinct = (
        units.select(F.inline(F.array(as_part, as_partition)))
        .groupBy("kind", "value")
        .agg(F.sum("rows").alias("rows"), F.max("bytes").alias("bytes"))
    )
    return distinct.agg(
        F.count_if(F.col("kind") == "part").alias("active_parts"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.sum("bytes").alias("bytes"),
        F.count_if(F.col("kind") == "partition").alias("partitions"),
    )


def partition_stats(
    df: DataFrame,
    partition: Column | str | None = None,
    part: Column | str | None = None,
    size: Column | str | None = None,
) -> DataFrame:
    """Rows and bytes per partition.

    A file that holds rows of several logical partitions counts in full for each of
    them: reading or rewriting one of them touches the whole file.
    """
    return (
        part_units(df, partition, part, size)
        .groupBy("partition")
        .agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    )


def largest_partitions(stats: DataFrame, limit: int = 10) -> DataFrame:
    """The partitions with the most rows, as advice where to scope a proof."""
    return stats.orderBy(F.desc("rows"), "partition").limit(limit)


def table_profile(
    df: DataFrame, spec: TableSpec, size: Column | str | None = None
) -> DataFrame:
    """One nested row: layout, totals, columns, eligible checks and warnings."""
    deduplicates = spec.versioned and not spec.fan_out
    warnings = []
    if spec.versioned:
        warnings.append("Reads that do not collapse versions may return duplicate rows.")
    if spec.fan_out:
        warnings.append("Fan-out table: checks on one shard are advisory.")
    summary = parts_summary(df, spec.partition, spec.part, size)
    columns = [
        F.struct(
            F.lit(position).alias("pos"),
            F.lit(field.name).alias("name"),
            F.lit(field.dataType.simpleString()).alias("type"),
        )
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    layout = layout_keys(spec)
    return summary.select(
        F.lit(spec.name).alias("table"),
        F.lit(layout["sort_key"]).alias("sort_key"),
        F.lit(layout["dedup_key"]).alias("dedup_key"),
        F.lit(layout["partition_by"]).alias("partition_by"),
        F.lit(spec.version).cast("string").alias("version_column"),
        F.lit(spec.deleted).cast("string").alias("deleted_column"),
        F.lit(spec.versioned).alias("is_versioned"),
        F.lit(spec.fan_out).alias("is_fan_out"),
        "rows",
        "bytes",
        "active_parts",
        "partitions",
        F.array(*columns).alias("columns"),
        F.struct(
            F.lit(deduplicates).alias("duplicate_proof"),
            F.lit(deduplicates).alias("extract_slice"),
            F.lit(True).alias("dry_run_change"),
            F.lit(True).alias("scan_ratio"),
        ).alias("eligible_checks"),
        F.array(*[F.lit(text) for text in warnings]).cast("array<string>").alias("warnings"),
    )


def layout_keys(spec: TableSpec) -> dict[str, str | None]:
    """The declared keys as text, None where not declared."""
    partition = spec.partition if isinstance(spec.partition, (str, type(None))) else str(spec.partition)
    return {
        "sort_key": ", ".join(spec.sort_key or spec.dedup_key) or None,
        "dedup_key": ", ".join(spec.dedup_key) or None,
        "partition_by": partition,
    }


def catalog_spec(spark, table: str, dedup_key: tuple[str, ...] = ()) -> TableSpec:
    """A spec from the session catalog: partition and bucket-sort columns, properties.

    Table properties ``dataproof.version`` and ``dataproof.deleted`` name the version
    and deletion columns. An unknown table raises.
    """
    columns = spark.catalog.listColumns(table)
    partitions = [column.name for column in columns if column.isPartition]
    described = {
        row["col_name"].strip(): (row["data_type"] or "").strip()
        for row in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
    }
    sort_columns = described.get("Sort Columns", "").strip("[]").replace("`", "")
    properties = {
        row["key"]: row["value"] for row in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()
    }
    sort_key = tuple(name.strip() for name in sort_columns.split(",") if name.strip())
    version = properties.get("dataproof.version")
    return TableSpec(
        name=table,
        dedup_key=tuple(dedup_key) or sort_key,
        partition=f"concat_ws('/', {', '.join(partitions)})" if partitions else None,
        sort_key=sort_key,
        version=version,
        deleted=properties.get("dataproof.deleted"),
        versioned=version is not None,
    )
