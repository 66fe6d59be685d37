"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Binary units, smallest first.
_UNITS = ["KiB", "MiB", "GiB", "TiB", "PiB"]


def format_count(value: Column) -> Column:
    """Thousands separators: 184203991 becomes 184,203,991."""
    return F.format_number(value.cast("bigint"), 0)


def format_bytes(value: Column) -> Column:
    """Binary units: two decimals below ten, one above; plain bytes below 1024; NULL for an unknown size."""
    text = F.when(value.isNotNull(), F.format_string("%d B", value.cast("bigint")))
    for power, unit in enumerate(_UNITS, start=1):
        scaled = value / F.lit(float(1024**power))
        shown = F.when(scaled >= 10, F.format_string(f"%.1f {unit}", scaled)).otherwise(
            F.format_string(f"%.2f {unit}", scaled)
        )
        text = F.when(value >= F.lit(1024**power), shown).otherwise(text)
    return text
