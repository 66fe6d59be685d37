"""Forms of columns under which equal values group together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructType, VariantType

#: Columns of a digest, 64 bits each.
DIGEST = ("d0", "d1", "d2", "d3")


def needs_canonical(kind: DataType) -> bool:
    if isinstance(kind, (MapType, VariantType)):
        return True
    if isinstance(kind, ArrayType):
        return needs_canonical(kind.elementType)
    if isinstance(kind, StructType):
        return any(needs_canonical(field.dataType) for field in kind.fields)
    return False


def canonical(value: Column, kind: DataType) -> Column:
    """A groupable and sortable stand-in for maps and variants, at any depth.

    A map becomes its entries in key order, a variant its JSON text; everything
    else stays itself.
    """
    if not needs_canonical(kind):
        return value
    if isinstance(kind, VariantType):
        return F.to_json(value)
    if isinstance(kind, MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda entry: F.struct(
                entry["key"].alias("key"), canonical(entry["value"], kind.valueType).alias("value")
            ),
        )
        return F.array_sort(entries)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda item: canonical(item, kind.elementType))
    inner = F.struct(
        *[canonical(value[field.name], field.dataType).alias(field.name) for field in kind.fields]
    )
    return F.when(value.isNotNull(), inner)


def positional(df: DataFrame, round_to: int | None = None) -> DataFrame:
    """Columns named by position (``c0``, ``c1`` ...) and in canonical form.

    ``round_to`` rounds floating columns: sums of floats depend on the order of
    addition, so two right plans may differ in the last bits.
    """
    renamed = df.toDF(*[f"c{position}" for position in range(len(df.columns))])
    columns = []
    for field in renamed.schema.fields:
        form = canonical(renamed[field.name], field.dataType)
        if round_to is not None and isinstance(field.dataType, (FloatType, DoubleType)):
            form = F.round(form, round_to)
        columns.append(form.alias(field.name))
    return renamed.select(*columns)


def is_flat(kind: DataType) -> bool:
    """Does a 64-bit hash of Spark's tell values of the type apart as grouping does? Nested ones and collations it does not."""
    return not isinstance(kind, (ArrayType, MapType, StructType)) and (not isinstance(kind, StringType) or kind == StringType())


def digested(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows of ``positional`` with a 256-bit digest of their flat columns, and the columns that identify a row.

    A hash passes over NULLs, so where they are is hashed as well. Columns that are not flat identify a row as they are.
    """
    flat = [rows[field.name] for field in rows.schema.fields if is_flat(field.dataType)]
    nested = [field.name for field in rows.schema.fields if not is_flat(field.dataType)]
    nulls = [column.isNull() for column in flat]
    digest = {name: F.xxhash64(F.lit(seed), *nulls, *flat) for seed, name in enumerate(DIGEST)}
    return rows.withColumns(digest), [*DIGEST, *nested]
