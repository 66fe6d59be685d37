"""Is a DataFrame's row set the same each time it is computed?"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

# Catalyst counts these as deterministic because they are constant
# within one query, yet two queries see different values.
_CLOCK_EXPRESSIONS = {
    "CurrentDate", "CurrentTime", "CurrentTimestamp", "LocalTimestamp", "Now",
}
SUBQUERIES = {"Exists", "LateralSubquery", "ListQuery", "ScalarSubquery"}
_LIMITS = {"GlobalLimit", "Offset", "Tail"}
_KEEPS_ORDER = {"LocalLimit", "Project", "SubqueryAlias", "View"}


def _items(seq) -> Iterator:
    return (seq.apply(position) for position in range(seq.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def expressions_of(expression) -> Iterator:
    """A Catalyst expression and all below it."""
    yield expression
    for child in _items(expression.children()):
        yield from expressions_of(child)


def _nodes(plan) -> Iterator:
    """All nodes of a plan, those of its subqueries included."""
    yield plan
    for top in _items(plan.expressions()):
        for expression in expressions_of(top):
            if _kind(expression) in SUBQUERIES:
                yield from _nodes(expression.plan())
    for child in _items(plan.children()):
        yield from _nodes(child)


def _clock_function(plan) -> str | None:
    for node in _nodes(plan):
        for top in _items(node.expressions()):
            for expression in expressions_of(top):
                if _kind(expression) in _CLOCK_EXPRESSIONS:
                    return expression.prettyName()
    return None


def _random_function(plan) -> str | None:
    for node in _nodes(plan):
        if _kind(node) == "Sample":
            continue
        for top in _items(node.expressions()):
            for expression in expressions_of(top):
                children = list(_items(expression.children()))
                if not expression.deterministic() and all(c.deterministic() for c in children):
                    return expression.prettyName()
    return None


def _ordered(plan) -> bool:
    """Do the rows of a plan come in an order, so that the first of them are always the same?"""
    kind = _kind(plan)
    if kind == "Sort":
        return True
    return (kind in _KEEPS_ORDER or kind in _LIMITS) and _ordered(plan.children().apply(0))


def _arbitrary_rows(plan) -> bool:
    """Does a limit anywhere pick rows without an order below it? A sort above it settles nothing."""
    return any(_kind(node) in _LIMITS and not _ordered(node.children().apply(0)) for node in _nodes(plan))


def stability_gate(*frames: DataFrame) -> str | None:
    """The first reason why a comparison would prove nothing, or None.

    Reads the analyzed plan only; no job runs. A frame whose plan cannot be read (outside a classic
    session) may hold anything and is a reason too. ``first``, ``collect_list`` and ties in an
    ordering count as stable: no plan tells those apart.
    """
    if not all(hasattr(frame, "_jdf") for frame in frames):
        return "has a plan that this session does not show"
    plans = [frame._jdf.queryExecution().analyzed() for frame in frames]
    for plan in plans:
        unstable = _random_function(plan) or _clock_function(plan)
        if unstable:
            return f"uses the non-deterministic function {unstable}"
    for plan in plans:
        if _arbitrary_rows(plan):
            return "uses LIMIT without an ordering"
        if any(_kind(node) == "Sample" for node in _nodes(plan)):
            return "reads a sample"
    return None
