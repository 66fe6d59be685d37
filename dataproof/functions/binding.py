"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often it is used.

    Writing a long expression into another one several times doubles the plan with
    every level; a lambda variable keeps it as large as it reads.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def rows_of(value: Column, body: Callable[[Column], Column]) -> Column:
    """As ``let`` for a struct, as a generator of its fields.

    Filters on the fields stay above it, so the texts are scanned once and not again
    inside each pushed-down condition.
    """
    return F.inline(F.transform(F.array(value), body))
