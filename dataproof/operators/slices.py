"""Choosing one partition to copy, and proving that the copy behaves like the source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataproof.functions.display import format_bytes, format_count
from dataproof.operators.uniqueness import duplicate_proof

# Fixed value: a slice and its reading are expected to take twice the source bytes.
GROWTH = 2


def choose_partition(stats: DataFrame, requested: str | None = None) -> str:
    """The partition to slice: the requested one, or the only one there is.

    At most eleven partition names reach the driver, and none where one is asked for.
    """
    names = stats.select(F.col("partition").cast("string").alias("partition"))
    if requested is not None:
        if names.filter(F.col("partition") == requested).isEmpty():
            raise ValueError(f"partition not found: {requested}")
        return requested
    shown = [row["partition"] for row in names.orderBy("partition").limit(11).collect()]
    if not shown:
        raise ValueError("the table has no partitions with data")
    if len(shown) > 1:
        raise ValueError(
            f"the table has {names.count()} partitions; choose one, such as " + ", ".join(map(str, shown[:10]))
        )
    return shown[0]


def slice_budget(
    stats: DataFrame,
    partition: str,
    stored_bytes: int | Column = 0,
    max_rows: int | None = None,
    max_bytes: int | None = None,
    max_total_bytes: int | None = None,
) -> DataFrame:
    """One row: may this partition be copied? A refused slice is never copied in part.

    Only limits that the caller sets refuse anything.
    """
    stored = stored_bytes if isinstance(stored_bytes, Column) else F.lit(stored_bytes)
    size = F.coalesce("bytes", F.lit(0))
    projected = stored + size * GROWTH
    reason = (
        F.when(
            _above(F.col("rows"), max_rows),
            F.concat(format_count(F.col("rows")), F.lit(f" rows exceed the slice limit of {max_rows}.")),
        )
        .when(
            _above(size, max_bytes),
            F.concat(format_bytes(size), F.lit(f" exceed the slice limit of {max_bytes} bytes.")),
        )
        .when(
            _above(projected, max_total_bytes),
            F.concat(format_bytes(projected), F.lit(f" of slices would exceed {max_total_bytes} bytes.")),
        )
    )
    return stats.filter(F.col("partition").cast("string") == partition).select(
        "partition", "rows", "bytes", reason.isNull().alias("allowed"), reason.alias("reason")
    )


def _above(value: Column, limit: int | None) -> Column:
    return F.lit(False) if limit is None else value > limit


def slice_proof(
    source: DataFrame, copy: DataFrame, key: Sequence[str], source_partition: Column | str | None = None
) -> DataFrame:
    """One row: the duplicate proof of both sides, and whether they agree.

    ``source`` is the sliced partition only, so both proofs have one scope.
    """
    measures = ["total_rows", "duplicate_groups", "duplicate_rows", "max_copies"]
    sides = [
        duplicate_proof(df, key, source_partition).select(
            *[F.col(name).alias(f"{side}_{name}") if side == kept else F.lit(None).cast("bigint").alias(f"{kept}_{name}")
              for kept in ("source", "slice") for name in measures]
        )
        for side, df in (("source", source), ("slice", copy))
    ]
    both = sides[0].unionByName(sides[1])
    merged = both.agg(*[F.max(name).alias(name) for name in both.columns])
    matched = F.lit(True)
    for name in ("duplicate_groups", "duplicate_rows", "max_copies"):
        matched = matched & (F.col(f"source_{name}") == F.col(f"slice_{name}"))
    return merged.withColumn("matched", matched)
