"""Small constant tables that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_literal(value: object, sql_type: str) -> Column:
    if isinstance(value, Column):
        return value.cast(sql_type)
    if isinstance(value, (list, tuple)):
        if not value:
            return F.array().cast(sql_type)
        return F.array(*[F.lit(item) for item in value]).cast(sql_type)
    return F.lit(value).cast(sql_type)


def literal_rows(
    spark: SparkSession, fields: Sequence[tuple[str, str]], rows: Iterable[Sequence[object]]
) -> DataFrame:
    """Rows written out in code (rules, declarations, schema facts) as a DataFrame.

    Spark knows the size of such a table, so joins against it are planned as
    broadcasts without a hint.
    """
    structs = [
        F.struct(*[as_literal(value, kind).alias(name) for value, (name, kind) in zip(row, fields)])
        for row in rows
    ]
    if not structs:
        return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in fields])
    return spark.range(1).select(F.inline(F.array(*structs)))
