"""Do two DataFrames hold the same multiset of rows?"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataproof.functions.canonical import DIGEST, digested, positional
from dataproof.functions.literal import literal_rows
from dataproof.operators.stability import stability_gate
from dataproof.sources.shared import keep_table

DEFAULT_SAMPLE = 10

CORRECT = "correct"
INCORRECT = "incorrect"
INDETERMINATE = "indeterminate"


def _sample_size(limit: int | None) -> int:
    if limit is None:
        return DEFAULT_SAMPLE
    if limit < 1:
        raise ValueError(f"a sample needs at least one row, not {limit}")
    return int(limit)


def compare_shape(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns side by side, by position; a missing column shows as NULL."""
    pairs = list(_column_pairs(left, right))
    fields = [
        ("pos", "int"), ("left_name", "string"), ("right_name", "string"),
        ("left_type", "string"), ("right_type", "string"),
        ("type_match", "boolean"), ("name_match", "boolean"),
    ]
    return literal_rows(left.sparkSession, fields, pairs)


def _column_pairs(left: DataFrame, right: DataFrame) -> Iterator[tuple]:
    ours, theirs = left.schema.fields, right.schema.fields
    for position in range(max(len(ours), len(theirs))):
        a = ours[position] if position < len(ours) else None
        b = theirs[position] if position < len(theirs) else None
        left_type = a.dataType.simpleString() if a else None
        right_type = b.dataType.simpleString() if b else None
        yield (
            position + 1,
            a.name if a else None,
            b.name if b else None,
            left_type,
            right_type,
            left_type == right_type,
            bool(a and b and a.name == b.name),
        )


def same_types(left: DataFrame, right: DataFrame) -> bool:
    return all(pair[5] for pair in _column_pairs(left, right))


def renamed_columns(left: DataFrame, right: DataFrame) -> bool:
    """Comparable by type, but at least one output name differs."""
    return same_types(left, right) and not all(pair[6] for pair in _column_pairs(left, right))


def surplus_digests(left: DataFrame, right: DataFrame, round_to: int | None = None) -> DataFrame:
    """Digests of rows that one side holds more often than the other, with the surplus.

    Left rows count +1 and right rows -1; one aggregation over both sides nets them
    out. Only digests are shuffled, and equal ones merge on the map side already, so a row that makes up a third
    of the data travels as one record of 40 bytes per task.
    """
    if not same_types(left, right):
        raise ValueError("the two sides differ in column count or types; see compare_shape")
    sides = []
    for side, sign in ((left, 1), (right, -1)):
        rows, identity = digested(positional(side, round_to))
        sides.append(rows.select(*identity, F.lit(sign).alias("surplus")))
    return (
        sides[0].union(sides[1]).groupBy(*identity)
        .agg(F.sum("surplus").alias("surplus"))
        .filter(F.col("surplus") != 0)
    )


def surplus_rows(left: DataFrame, right: DataFrame, surplus: DataFrame, round_to: int | None = None) -> DataFrame:
    """The whole rows of ``surplus_digests``: fetched from the side that has too many, each once."""
    found = []
    for side, wanted in ((left, F.col("surplus") > 0), (right, F.col("surplus") < 0)):
        rows, identity = digested(positional(side, round_to))
        chosen = surplus.where(wanted).select(*[F.col(name).alias(f"of_{name}") for name in identity], "surplus")
        matched = rows.join(chosen, [F.col(name).eqNullSafe(F.col(f"of_{name}")) for name in identity])
        columns = [name for name in rows.columns if name not in identity]
        # Rows of one digest are equal, so any of them stands for all.
        once = matched.groupBy(*identity).agg(F.first("surplus").alias("surplus"), *[F.first(name).alias(name) for name in columns])
        found.append(once.select(*[name for name in rows.columns if name not in DIGEST], "surplus"))
    return found[0].union(found[1])


def _count_surplus(surplus: DataFrame) -> DataFrame:
    left_only = F.coalesce(F.sum(F.greatest("surplus", F.lit(0))), F.lit(0)).cast("bigint")
    right_only = F.coalesce(F.sum(F.greatest(-F.col("surplus"), F.lit(0))), F.lit(0)).cast("bigint")
    return surplus.agg(left_only.alias("left_only"), right_only.alias("right_only")).withColumn(
        "differing_rows", F.col("left_only") + F.col("right_only")
    )


def diff_counts(left: DataFrame, right: DataFrame, round_to: int | None = None) -> DataFrame:
    """One row: how many rows only one side has, duplicates counted."""
    return _count_surplus(surplus_digests(left, right, round_to))


def _sample_side(surplus: DataFrame, side: str, copies: Column, size: int, names: list[str]) -> DataFrame:
    columns = [name for name in surplus.columns if name != "surplus"]
    # A sample of `size` rows needs at most `size` copies of any one row.
    repeated = surplus.filter(copies > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.least(copies, F.lit(size)).cast("int")))
    )
    chosen = repeated.orderBy(*columns).limit(size)
    return chosen.select(F.lit(side).alias("_side"), *columns).toDF("_side", *names)


def _sample_surplus(surplus: DataFrame, size: int, names: list[str]) -> DataFrame:
    left = _sample_side(surplus, "left", F.col("surplus"), size, names)
    right = _sample_side(surplus, "right", -F.col("surplus"), size, names)
    return left.union(right)


def diff_sample(
    left: DataFrame, right: DataFrame, limit: int | None = None, round_to: int | None = None
) -> DataFrame:
    """The first rows of each side, in row order, that the other side lacks."""
    surplus = surplus_rows(left, right, surplus_digests(left, right, round_to), round_to)
    return _sample_surplus(surplus, _sample_size(limit), left.columns)


_RESULT = [
    ("verdict", "string"), ("left_only", "bigint"), ("right_only", "bigint"),
    ("differing_rows", "bigint"), ("renamed", "boolean"), ("shape_mismatch", "boolean"),
    ("reason", "string"),
]


def _settled(left: DataFrame, right: DataFrame, max_rows: int | None) -> DataFrame | None:
    """The verdict, where plans, schemas or the row budget already decide it."""
    spark = left.sparkSession
    reason = stability_gate(left, right)
    if reason is None and same_types(left, right) and max_rows is not None:
        if left.count() + right.count() > max_rows:
            reason = f"both sides together exceed the budget of {max_rows} rows"
    if reason is not None:
        return literal_rows(spark, _RESULT, [(INDETERMINATE, 0, 0, 0, False, False, reason)])
    if not same_types(left, right):
        return literal_rows(spark, _RESULT, [(INCORRECT, 0, 0, 0, False, True, None)])
    return None


def _verdict(counts: DataFrame, renamed: bool) -> DataFrame:
    equal = (F.col("differing_rows") == 0) & ~F.lit(renamed)
    return counts.select(
        F.when(equal, CORRECT).otherwise(INCORRECT).alias("verdict"),
        "left_only",
        "right_only",
        "differing_rows",
        F.lit(renamed).alias("renamed"),
        F.lit(False).alias("shape_mismatch"),
        F.lit(None).cast("string").alias("reason"),
    )


def verify_equivalent(
    left: DataFrame,
    right: DataFrame,
    round_to: int | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """One row: ``correct``, ``incorrect`` or ``indeterminate``, with the counts.

    Unstable inputs and differing types are settled without reading data.
    ``max_rows`` is a budget over both sides, checked by counting them first.
    """
    settled = _settled(left, right, max_rows)
    if settled is not None:
        return settled
    return _verdict(diff_counts(left, right, round_to), renamed_columns(left, right))


def compare(
    left: DataFrame,
    right: DataFrame,
    limit: int | None = None,
    round_to: int | None = None,
    max_rows: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Verdict and sample: the digests that differ are computed and stored once, and only their rows are fetched again."""
    settled = _settled(left, right, max_rows)
    if settled is not None:
        return settled, None
    surplus, _ = keep_table(surplus_digests(left, right, round_to), "surplus")
    verdict = _verdict(_count_surplus(surplus), renamed_columns(left, right))
    rows = surplus_rows(left, right, surplus, round_to)
    return verdict, _sample_surplus(rows, _sample_size(limit), left.columns)
