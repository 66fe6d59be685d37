"""Exact conversion: does a value survive a type change without losing information?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    CharType,
    DataType,
    DateType,
    DoubleType,
    FloatType,
    FractionalType,
    IntegralType,
    LongType,
    MapType,
    NullType,
    NumericType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
    VarcharType,
    VariantType,
)

_NESTED = (ArrayType, StructType, MapType, VariantType)
_ROUND_TRIPPED = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)


def as_type(target: DataType | str) -> DataType:
    return DataType.fromDDL(target) if isinstance(target, str) else target


def is_unprobeable(target: DataType | str) -> bool:
    """Nested and semistructured targets cannot be judged value by value."""
    return isinstance(as_type(target), _NESTED)


def cast_fails(value: Column, source: DataType, target: DataType | str) -> Column:
    """True where a non-null value has no exact counterpart in the target type.

    A cast that yields NULL failed. For numbers, booleans, dates and timestamps a
    cast that cannot be undone failed too: Spark truncates 1.5 to 1 and rounds
    1.25 to 1.3, which changes the data. Text is judged by the cast alone, bounded text
    by its length.
    """
    wanted = as_type(target)
    if isinstance(wanted, (CharType, VarcharType)):
        # Spark's cast forgets the bound, so the text itself is measured.
        return value.isNotNull() & (F.length(value.cast("string")) > wanted.length)
    if source == wanted or isinstance(source, NullType):
        return F.lit(False)
    converted = value.try_cast(wanted)
    lost = converted.isNull()
    if isinstance(source, IntegralType) and isinstance(wanted, FractionalType):
        # Casting back to the source type would clip 2^31 or 2^63 to its largest value.
        lost = lost | ~converted.try_cast("bigint").eqNullSafe(value.cast("bigint"))
        if isinstance(wanted, (FloatType, DoubleType)):
            lost = lost | (converted >= F.lit(2.0**63))
    elif isinstance(source, _ROUND_TRIPPED) and not isinstance(wanted, (StringType, BinaryType)):
        lost = lost | ~converted.try_cast(source).eqNullSafe(value)
        if isinstance(source, (FloatType, DoubleType)) and isinstance(wanted, LongType):
            lost = lost | (value >= F.lit(2.0**63))
    return value.isNotNull() & lost
