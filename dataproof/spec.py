"""Declarations a caller makes about tables and about proposed changes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def as_column(value: Column | str) -> Column:
    """A ``Column`` as it is; a string is read as a Spark SQL expression."""
    return F.expr(value) if isinstance(value, str) else value


@dataclass(frozen=True)
class TableSpec:
    """What is known about a table beyond its schema.

    ``partition`` and ``part`` are SQL expressions (or columns). ``part`` names the
    unit a rewrite touches; without it the unit is the data file.
    """

    name: str
    dedup_key: tuple[str, ...] = ()
    partition: Column | str | None = None
    part: Column | str | None = None
    sort_key: tuple[str, ...] = ()
    version: str | None = None
    deleted: str | None = None
    versioned: bool = True
    fan_out: bool = False
    generated: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def bare_name(self) -> str:
        return self.name.rsplit(".", 1)[-1]


# The operations a change may name.
UPDATE = "update"
DELETE = "delete"
ADD_COLUMN = "add_column"
MODIFY_COLUMN = "modify_column"


@dataclass(frozen=True)
class ChangeSpec:
    """One proposed change, as data.

    ``assignments`` belongs to updates, ``column``/``target_type`` to type changes,
    ``expression``/``kind`` (``default`` or ``materialized``) to computed columns.
    """

    table: str
    op: str
    column: str | None = None
    target_type: DataType | str | None = None
    nullable: bool = False
    expression: str | None = None
    kind: str | None = None
    predicate: str | None = None
    assignments: Mapping[str, str] = field(default_factory=dict)
