"""Comparing table names and key declarations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_name(table: Column) -> Column:
    """The table without its database: ``db.events`` becomes ``events``."""
    return F.substring_index(table, ".", -1)


def qualified_name(table: Column, default_database: str) -> Column:
    return F.when(F.instr(table, ".") > 0, table).otherwise(
        F.concat(F.lit(default_database + "."), table)
    )


def normalized_key(columns: Column) -> Column:
    """Column names compared without case, backticks, blanks or empty entries."""
    plain = F.transform(
        columns, lambda name: F.lower(F.regexp_replace(F.trim(name), "^`(.*)`$", "$1"))
    )
    return F.filter(plain, lambda name: name != "")


def same_key(declared: Column, key: Column) -> Column:
    """Do both lists name the same set of columns, in any order?"""
    wanted = F.array_distinct(normalized_key(declared))
    actual = normalized_key(key)
    return (F.size(actual) == F.size(wanted)) & (F.size(F.array_except(actual, wanted)) == 0)
