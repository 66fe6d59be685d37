"""How well does a filter prune the parts of a table?"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataproof.functions.literal import literal_rows
from dataproof.operators.profile import layout_keys, storage_units
from dataproof.spec import TableSpec, as_column

FULL_SCAN_ROWS = 10_000_000
FULL_SCAN_BYTES = 1024 * 1024 * 1024


@dataclass(frozen=True)
class Range:
    """What a filter asks of one sort column: low <= column <= high, either end open."""

    column: str
    low: object = None
    high: object = None


def part_stats(
    df: DataFrame,
    sort_columns: Sequence[str],
    partition: Column | str | None = None,
    part: Column | str | None = None,
    size: Column | str | None = None,
) -> DataFrame:
    """Rows, bytes and value ranges per stored part, from the footers of data files where they state them.

    Logical parts, partitions that a file mixes, and columns without exact bounds in the footers take a scan of the sort columns.
    """
    return storage_units(df, sort_columns, partition, part, size)


def _overlaps(wanted: Range) -> Column:
    """May the part hold a value of the range? A part of NULLs only holds none."""
    overlap = F.col(f"max_{wanted.column}").isNotNull()
    if wanted.low is not None:
        overlap = overlap & (F.col(f"max_{wanted.column}") >= F.lit(wanted.low))
    if wanted.high is not None:
        overlap = overlap & (F.col(f"min_{wanted.column}") <= F.lit(wanted.high))
    return overlap


@dataclass(frozen=True)
class ScanFilter:
    """What a query asks of a table: a condition on the partition and ranges of sort columns."""

    partition_predicate: Column | str | None = None
    ranges: Sequence[Range] = ()


def scan_ratio(
    stats: DataFrame,
    table: str,
    partition_predicate: Column | str | None = None,
    ranges: Sequence[Range] = (),
) -> DataFrame:
    """Selected of total parts and rows, per pruning level.

    The key level starts from the parts that the partition level left over.
    """
    return scan_ratios(stats, {table: ScanFilter(partition_predicate, ranges)})


def scan_ratios(stats: DataFrame, filters: Mapping[str, ScanFilter]) -> DataFrame:
    """``scan_ratio`` of many filters of one table, by name, from one pass over its statistics."""
    columns = sorted({wanted.column for f in filters.values() for wanted in f.ranges})
    bounds = [f(f"{short}_{name}").alias(f"{short}_{name}") for name in columns for f, short in ((F.min, "min"), (F.max, "max"))]
    selected = [as_column(f.partition_predicate) if f.partition_predicate is not None else F.lit(True) for f in filters.values()]
    # A file may hold several logical partitions; it is read once any of them is wanted.
    parts = stats.groupBy("part").agg(
        F.sum("rows").alias("rows"),
        *[F.bool_or(F.coalesce(wanted, F.lit(False))).alias(f"in_{number}") for number, wanted in enumerate(selected)],
        *bounds,
    )
    measures = [F.count("*").alias("parts"), _sum_or_zero(F.col("rows")).alias("rows")]
    for number, wanted in enumerate(filters.values()):
        in_partition = F.col(f"in_{number}")
        in_key = reduce(and_, [_overlaps(one) for one in wanted.ranges], in_partition)
        for name, condition in ((f"partition_{number}_", in_partition), (f"key_{number}_", in_key)):
            measures += [F.count_if(condition).alias(f"{name}parts"), _sum_or_zero(F.when(condition, F.col("rows"))).alias(f"{name}rows")]

    def level(table: str, name: str, conditional: bool, selected: str, total: str) -> Column:
        return F.struct(
            F.lit(table).alias("table"),
            F.lit(name).alias("level"),
            F.lit(conditional).alias("has_condition"),
            F.col(f"{selected}parts").alias("selected"),
            F.col(f"{total}parts").alias("total"),
            F.col(f"{selected}rows").alias("selected_rows"),
            F.col(f"{total}rows").alias("total_rows"),
        )

    levels = []
    for number, (table, wanted) in enumerate(filters.items()):
        levels.append(level(table, "partition", wanted.partition_predicate is not None, f"partition_{number}_", ""))
        levels.append(level(table, "key", bool(wanted.ranges), f"key_{number}_", f"partition_{number}_"))
    return parts.agg(*measures).select(F.inline(F.array(*levels)))


def _sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def _pruning_per_table(ratios: DataFrame) -> DataFrame:
    """What each level selects, one row per table."""
    everything = (F.col("total") > 0) & (F.col("selected") == F.col("total"))
    unpruned = ~F.col("has_condition") & (F.col("total") > 1) & everything

    def at(level: str, value: Column) -> Column:
        return F.max(F.when(F.col("level") == level, value))

    return ratios.groupBy("table").agg(
        F.bool_and(everything).alias("everything"),
        at("partition", F.col("total")).alias("partition_total"),
        at("key", F.col("total")).alias("key_total"),
        at("partition", unpruned).alias("partition_unpruned"),
        at("key", unpruned).alias("key_unpruned"),
    )


def _note(code: str, severity: Column | str, text: str, parts: str) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        F.lit("proven").alias("confidence"),
        F.concat("table", F.lit(text)).alias("message"),
        F.concat(F.lit("parts "), parts, F.lit("/"), parts).alias("evidence"),
    )


def _full_scan_note() -> Column:
    small = (F.col("rows") < FULL_SCAN_ROWS) & (F.coalesce("bytes", F.lit(0)) < FULL_SCAN_BYTES)
    severity = F.when(F.coalesce(small, F.lit(False)), "medium").otherwise("high")
    return F.when(
        F.col("everything"), _note("full-scan", severity, " is read in full.", "partition_total")
    )


def _missing_partition_note() -> Column:
    text = " is filtered by no partition condition."
    note = _note("missing-partition-pruning", "medium", text, "partition_total")
    return F.when(F.col("partition_unpruned"), note)


def _missing_key_note() -> Column:
    text = " is filtered by no sort-key condition."
    note = _note("missing-primary-key-pruning", "medium", text, "key_total")
    return F.when(F.col("key_unpruned"), note)


def _notes(tables: DataFrame, *candidates: Column) -> DataFrame:
    found = F.filter(F.array(*candidates), lambda note: note.isNotNull())
    return tables.select("table", F.inline(found))


def _with_sizes(tables: DataFrame, sizes: DataFrame) -> DataFrame:
    return tables.join(sizes.select("table", "rows", "bytes"), "table", "left")


def full_scan(ratios: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tables whose filter selects every part, high from 10M rows or 1 GiB or unknown size.

    ``sizes`` has ``table, rows, bytes``; a table without a row there counts as large.
    """
    return _notes(_with_sizes(_pruning_per_table(ratios), sizes), _full_scan_note())


def missing_partition_pruning(ratios: DataFrame) -> DataFrame:
    """Tables of several parts read without a condition on the partition."""
    return _notes(_pruning_per_table(ratios), _missing_partition_note())


def missing_key_pruning(ratios: DataFrame) -> DataFrame:
    """Tables of several parts read without a condition on the sort key."""
    return _notes(_pruning_per_table(ratios), _missing_key_note())


def scan_findings(ratios: DataFrame, sizes: DataFrame) -> DataFrame:
    """All findings of the three rules above, from one pass over the ratios."""
    tables = _with_sizes(_pruning_per_table(ratios), sizes)
    return _notes(tables, _full_scan_note(), _missing_partition_note(), _missing_key_note())


def layout_table(spark, specs: Sequence[TableSpec]) -> DataFrame:
    rows = [
        (spec.name, layout_keys(spec)["sort_key"], layout_keys(spec)["partition_by"]) for spec in specs
    ]
    return literal_rows(
        spark, [("table", "string"), ("sort_key", "string"), ("partition_by", "string")], rows
    )


def layout_hint(findings: DataFrame, layouts: DataFrame) -> DataFrame:
    """Findings with the keys of their table spelled out; unknown layouts add nothing."""
    partition_hint = F.coalesce(
        F.concat(F.lit(" Partitioned by ("), "partition_by", F.lit(").")), F.lit("")
    )
    key_hint = F.coalesce(F.concat(F.lit(" Sorted by ("), "sort_key", F.lit(").")), F.lit(""))
    advice = (
        F.when(
            F.col("code") == "full-scan",
            F.concat(F.lit("Filter on the partition or the leading sort columns."), partition_hint, key_hint),
        )
        .when(
            F.col("code") == "missing-partition-pruning",
            F.concat(F.lit("Filter on a range of the partition expression."), partition_hint),
        )
        .when(
            F.col("code") == "missing-primary-key-pruning",
            F.concat(F.lit("Filter on leading sort columns, unwrapped."), key_hint),
        )
    )
    return (
        findings.join(layouts, "table", "left")
        .withColumn("recommendation", advice)
        .drop("sort_key", "partition_by")
    )


def no_scan_evidence(queries: DataFrame, ratios: DataFrame) -> DataFrame:
    """Queries (``path, table``) on tables without any scan statistics."""
    return queries.join(ratios.select("table").distinct(), "table", "left_anti").select(
        "path",
        "table",
        F.lit("no-scan-evidence").alias("code"),
        F.lit("low").alias("severity"),
        F.lit("advisory").alias("confidence"),
        F.lit("No scan statistics are known for this query.").alias("message"),
    )
