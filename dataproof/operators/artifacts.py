"""Triage of a table of SQL texts: ``artifacts(path, sql, prev_sql)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataproof.functions.binding import let, rows_of
from dataproof.functions.changetext import alter_class
from dataproof.functions.sqltext import (
    artifact_kind,
    clean_sql,
    fingerprint,
    glob_to_regex,
    query_shape,
    reject_reasons,
    skeleton,
    top_level,
    unstable_reason,
    word_line,
)


def match_globs(artifacts: DataFrame, globs: Sequence[str] = (), path: str = "path") -> DataFrame:
    """Artifacts whose path matches a glob; without globs, those ending in ``.sql``."""
    normalized = F.translate(F.col(path), "\\", "/")
    if not globs:
        return artifacts.filter(normalized.endswith(".sql"))
    return artifacts.filter(normalized.rlike("|".join(glob_to_regex(glob) for glob in globs)))


def classify(artifacts: DataFrame) -> DataFrame:
    """Clean statements with kind and fingerprint. ``prev_sql`` may be NULL."""
    cleaned = F.struct(
        clean_sql(F.col("sql")).alias("statement"), clean_sql(F.col("prev_sql")).alias("previous")
    )

    def described(texts: Column) -> Column:
        statement, previous = texts["statement"], texts["previous"]
        kind = artifact_kind(statement, previous)
        mark = F.when(kind == "query_pair", fingerprint(statement, previous)).otherwise(
            fingerprint(statement)
        )
        return F.struct(
            statement.alias("statement"),
            previous.alias("previous"),
            kind.alias("kind"),
            mark.alias("fingerprint"),
        )

    return artifacts.select("path", rows_of(cleaned, described))


def _reasons(statement: Column) -> Column:
    """Shape, reason it is unstable and reasons to reject it, for a clean statement."""

    def judged(text: Column, layers: Column) -> Column:
        rejected = reject_reasons(text, layers["line"], word_line(layers["top"]))
        return F.struct(
            query_shape(layers["line"]).alias("shape"),
            unstable_reason(statement, text, layers["top"]).alias("unstable_reason"),
            F.nullif(F.array_join(rejected, "; "), F.lit("")).alias("reject_reason"),
        )

    return let(
        skeleton(statement),
        lambda text: let(F.struct(word_line(text).alias("line"), top_level(text).alias("top")), lambda layers: judged(text, layers)),
    )


def query_shape_flags(classified: DataFrame) -> DataFrame:
    """Per query text: shape flags, the reason it is unstable, all reasons to reject it."""
    queries = classified.filter(F.col("kind").isin("query", "query_pair"))
    return queries.select("path", "statement", F.inline(F.array(_reasons(F.col("statement"))))).select(
        "path", "statement", "shape.*", "unstable_reason", "reject_reason"
    )


def alter_classes(classified: DataFrame) -> DataFrame:
    """Per ALTER text: class, rewrite scope and the reason for either."""
    changes = classified.filter(F.col("kind") == "migration")
    return changes.select("path", "statement", F.inline(F.array(alter_class(F.col("statement")))))


def triage(artifacts: DataFrame) -> DataFrame:
    """Everything the texts tell, one row per artifact and one pass over them.

    ``type`` is the kind, or ``error`` for a text that must not be checked further;
    ``limit_type`` and ``limit_message`` say what keeps it from being proven.
    """
    is_query = F.col("kind").isin("query", "query_pair")
    seen = classify(artifacts).select(
        "path",
        "statement",
        "fingerprint",
        "kind",
        rows_of(
            F.struct(
                F.when(is_query, _reasons(F.col("statement"))).alias("now"),
                F.when(F.col("kind") == "query_pair", _reasons(F.col("previous"))).alias("before"),
                F.when(F.col("kind") == "migration", alter_class(F.col("statement"))).alias("change"),
            ),
            lambda row: row,
        ),
    )
    kind, classification = F.col("kind"), F.col("change.classification")
    rejected = F.coalesce(
        "before.reject_reason", "now.reject_reason",
        F.when(classification == "invalid", F.col("change.reason")),
    )
    unsupported = F.when(classification == "unsupported", F.col("change.reason"))
    unknown = F.when(kind == "unknown", "neither a query nor an ALTER statement")
    unproven = F.when(
        kind == "query_pair", F.coalesce("before.unstable_reason", "now.unstable_reason")
    )
    unreadable = F.coalesce(rejected, unsupported, unknown)
    return seen.select(
        "path",
        "statement",
        "fingerprint",
        "kind",
        F.when(rejected.isNotNull(), "error").otherwise(kind).alias("type"),
        F.when(unreadable.isNotNull(), "unsupported_syntax")
        .when(unproven.isNotNull(), "budget")
        .alias("limit_type"),
        F.coalesce(unreadable, unproven).alias("limit_message"),
        F.when((kind == "query") & rejected.isNull(), F.col("now.shape")).alias("shape"),
        "change",
    )


def advisories(has_scan_evidence: Column | None = None) -> Column:
    """The advisories of one flagged query, as an array of structs."""
    joins = F.col("has_cross_join") | (F.col("join_count") > 1)
    no_evidence = ~has_scan_evidence if has_scan_evidence is not None else F.lit(False)
    notes = [
        (F.col("has_final"), "final-cost", "medium",
         "The query collapses versions while reading."),
        (F.col("has_function_wrapped_predicate"), "function-wrapped-predicate", "medium",
         "A predicate wraps a value in a function."),
        (F.col("has_leading_wildcard"), "leading-wildcard", "medium",
         "A LIKE pattern starts with a wildcard."),
        (joins, "join-shape", F.when(F.col("has_cross_join"), "high").otherwise("medium"),
         "The query has a cross join or several joins."),
        (F.col("selects_all_columns"), "select-star", "low", "The query reads all columns."),
        (no_evidence, "no-scan-evidence", "low", "No scan statistics are known for this query."),
    ]
    found = [
        F.when(
            condition,
            F.struct(
                F.lit(code).alias("code"),
                (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
                F.lit("advisory").alias("confidence"),
                F.lit(message).alias("message"),
            ),
        )
        for condition, code, severity, message in notes
    ]
    return F.filter(F.array(*found), lambda note: note.isNotNull())


def query_advisories(flags: DataFrame) -> DataFrame:
    """One row per advisory of each query."""
    return flags.select("path", F.inline(advisories()))
