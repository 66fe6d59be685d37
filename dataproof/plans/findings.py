"""Evidence of every check as rows of one schema.

A *finding* says what is wrong; a *limit* says what could not be shown. Both name
the artifact they belong to. A *run* is one artifact with its verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataproof.functions.display import format_bytes, format_count
from dataproof.functions.literal import literal_rows

FINDING_SCHEMA = (
    "artifact STRING, id STRING, title STRING, severity STRING, verdict STRING, category STRING, "
    "evidence_level STRING, strategy STRING, message STRING, "
    "evidence ARRAY<STRUCT<label: STRING, value: STRING>>, recommendation STRING, blocking BOOLEAN"
)
LIMIT_SCHEMA = "artifact STRING, type STRING, message STRING"

PASS, FAIL, WARN, INDETERMINATE = "pass", "fail", "warn", "indeterminate"


def _text(value: Column | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def _evidence(**values: Column) -> Column:
    return F.array(
        *[
            F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"))
            for label, value in values.items()
        ]
    )


def _finding(
    artifact: Column | str,
    id: Column | str,
    title: Column | str,
    severity: Column | str,
    verdict: Column | str,
    category: Column | str,
    evidence_level: Column | str,
    strategy: Column | str,
    message: Column | str,
    evidence: Column,
    recommendation: Column | str | None,
    blocking: Column | bool,
) -> list[Column]:
    texts = {
        "artifact": artifact, "id": id, "title": title, "severity": severity, "verdict": verdict,
        "category": category, "evidence_level": evidence_level, "strategy": strategy,
        "message": message,
    }
    return [
        *[_text(value).alias(name) for name, value in texts.items()],
        evidence.alias("evidence"),
        _text(recommendation).alias("recommendation"),
        (blocking if isinstance(blocking, Column) else F.lit(blocking)).alias("blocking"),
    ]


def _present(*candidates: Column) -> Column:
    """The candidates that are not NULL, as an array."""
    return F.filter(F.array(*candidates), lambda candidate: candidate.isNotNull())


def no_findings(spark) -> DataFrame:
    return spark.createDataFrame([], FINDING_SCHEMA)


def no_limits(spark) -> DataFrame:
    return spark.createDataFrame([], LIMIT_SCHEMA)


def equivalence_finding(result: DataFrame, artifact: Column | str) -> DataFrame:
    """Findings of a ``verify_equivalent`` row: none if the sides are equal."""
    shape, named = F.col("shape_mismatch"), F.col("renamed") & (F.col("differing_rows") == 0)
    return result.filter(F.col("verdict") == "incorrect").select(
        *_finding(
            artifact,
            F.when(shape, "query_shape_mismatch").when(named, "query_column_names_changed")
            .otherwise("query_not_equivalent"),
            F.when(shape, "Result shape changed").when(named, "Column names changed")
            .otherwise("Result rows changed"),
            "error", FAIL, "correctness", "exact", "production_exact",
            F.when(shape, "The two sides return different columns or types.")
            .when(named, "The rows agree, but the output names differ.")
            .otherwise(F.concat(format_count(F.col("differing_rows")), F.lit(" row(s) differ."))),
            _evidence(
                leftOnly=F.col("left_only"), rightOnly=F.col("right_only"),
                differingRows=F.col("differing_rows"),
            ),
            F.when(shape, "Align columns and types first.").otherwise("Look at the sample of differing rows."),
            True,
        )
    )


def equivalence_limit(result: DataFrame, artifact: Column | str) -> DataFrame:
    return result.filter(F.col("verdict") == INDETERMINATE).select(
        _text(artifact).alias("artifact"), F.lit("budget").alias("type"), F.col("reason").alias("message")
    )


def dedup_finding(proof: DataFrame, artifact: Column | str) -> DataFrame:
    """Error for duplicates within partitions; warning if only the scopes differ.

    Cross-partition duplicates alone do not fail the table: compaction never
    promised to remove them. A read that trusts uniqueness fails on them
    (``read_path_finding``).
    """
    rows, crossing = F.col("duplicate_rows"), F.col("cross_partition_rows")
    present = F.struct(
        *_finding(
            artifact, "dedup_duplicates_present", "Duplicate keys are present",
            "error", FAIL, "correctness", "exact", "production_exact",
            F.concat(
                format_count(rows), F.lit(" duplicate row(s) in "),
                format_count(F.col("duplicate_groups")), F.lit(" key group(s)."),
            ),
            _evidence(
                duplicateGroups=F.col("duplicate_groups"), duplicateRows=rows,
                finalCollapsibleRows=F.col("final_collapsible_rows"), maxCopies=F.col("max_copies"),
            ),
            "Collapse versions when reading, or deduplicate when loading.",
            True,
        )
    )
    differs = F.struct(
        *_finding(
            artifact, "dedup_scope_warning", "Duplicates cross partitions",
            "warn", WARN, "correctness", "exact", "production_exact",
            F.concat(format_count(crossing), F.lit(" duplicate row(s) lie in different partitions.")),
            _evidence(duplicateRows=rows, finalCollapsibleRows=F.col("final_collapsible_rows")),
            "Compaction within partitions keeps these rows.",
            False,
        )
    )
    return proof.select(
        F.inline(_present(F.when(rows > 0, present), F.when(crossing != 0, differs)))
    )


def dedup_limit(gate: DataFrame, artifact: Column | str) -> DataFrame:
    """A limit for a skipped (``scan_skipped``) or ineligible (``eligible``) proof."""
    if "scan_skipped" in gate.columns:
        stopped, kind = F.col("scan_skipped"), "budget"
    else:
        stopped, kind = ~F.col("eligible"), "advisory_only"
    return gate.filter(stopped).select(
        _text(artifact).alias("artifact"), F.lit(kind).alias("type"), F.col("reason").alias("message")
    )


def read_path_finding(outcomes: DataFrame) -> DataFrame:
    """Blocking findings for violated trust; ``query_id`` is the artifact."""
    return outcomes.filter(F.col("status") == "violated").select(
        *_finding(
            F.col("query_id"), "read_path_uniqueness_violated", "A trusted uniqueness does not hold",
            "error", FAIL, "correctness", "exact", "production_exact", F.col("message"),
            _evidence(
                table=F.col("table"), uniqueBy=F.array_join("unique_by", ", "),
                duplicateRows=F.col("duplicate_rows"),
            ),
            "Collapse versions when reading, deduplicate when loading, or drop the assumption.",
            True,
        )
    )


def read_path_limit(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("status") == "unknown").select(
        F.col("query_id").alias("artifact"), F.lit("budget").alias("type"), "message"
    )


def migration_finding(dry_run: DataFrame, artifact: Column | str) -> DataFrame:
    """Findings of ``dry_run_change`` rows: every probe, and the rewrite footprint."""
    def judged(probe: Column) -> Column:
        status = probe["status"]
        return F.struct(
            *_finding(
                artifact, F.concat(F.lit("migration_"), probe["check"]), probe["check"],
                F.when(status == "error", "error").when(status == "ok", "info").otherwise("warn"),
                F.when(status == "error", FAIL).otherwise(PASS), "migration",
                F.when(status == "unknown", "advisory").otherwise("bounded"),
                "production_bounded_probe", probe["message"],
                _evidence(check=probe["check"]), None, status == "error",
            )
        )

    parts, size = F.col("affected_parts"), F.col("affected_bytes")
    touched = (F.col("classification") != "unsupported") & (F.col("evidence") != "none") & (parts > 0)
    footprint = F.struct(
        *_finding(
            artifact, "migration_rewrite_footprint", "The change may rewrite stored data",
            "warn", WARN, "migration", "metadata", "metadata_only",
            F.concat(
                format_count(parts), F.lit(" part(s) with "), format_count(F.col("affected_part_rows")),
                F.lit(" row(s)"), F.coalesce(F.concat(F.lit(" and "), format_bytes(size)), F.lit("")),
                F.lit(" may be rewritten."),
            ),
            _evidence(
                affectedParts=parts, affectedPartRows=F.col("affected_part_rows"), affectedBytes=size,
                rewriteEvidence=F.col("evidence"),
            ),
            "Schedule the rewrite by its size.",
            False,
        )
    )
    return dry_run.select(
        F.inline(F.concat(F.transform("correctness", judged), _present(F.when(touched, footprint))))
    )


def migration_limit(dry_run: DataFrame, artifact: Column | str) -> DataFrame:
    return dry_run.filter(F.col("classification") == "unsupported").select(
        _text(artifact).alias("artifact"), F.lit("unsupported_syntax").alias("type"),
        F.col("unsupported_reason").alias("message"),
    )


def diagnosis_finding(notes: DataFrame, artifact: Column | str | None = None) -> DataFrame:
    """Findings from pruning results and advisories: ``code, severity, confidence, message``.

    Only a proven finding of high severity blocks; all else warns. The artifact is
    the ``path`` column unless another is given.
    """
    artifact = F.col("path") if artifact is None else artifact
    proven, high = F.col("confidence") == "proven", F.col("severity") == "high"
    seen = {"evidence": F.col("evidence")} if "evidence" in notes.columns else {}
    advice = F.col("recommendation") if "recommendation" in notes.columns else None
    return notes.select(
        *_finding(
            artifact, F.concat(F.lit("query_"), "code"),
            F.initcap(F.translate("code", "-", " ")),
            F.when(proven & high, "error").otherwise("warn"),
            F.when(proven & high, FAIL).otherwise(WARN),
            F.when(proven, "performance").otherwise("cost"),
            F.when(proven, "explain").otherwise("advisory"),
            F.when(proven, "production_explain").otherwise("static_parse"),
            F.col("message"),
            _evidence(confidence=F.col("confidence"), severity=F.col("severity"), **seen),
            advice,
            proven & high,
        )
    )


def _flags(findings: DataFrame, *more: Column) -> DataFrame:
    """What each finding does to the verdict of its artifact, and more about it."""
    return findings.select(
        "artifact",
        (F.col("blocking") & (F.col("severity") == "error")).alias("fails"),
        ((F.col("severity") == "warn") | (F.col("verdict") == WARN)).alias("warns"),
        *more,
    )


def _many(marks: DataFrame) -> DataFrame:
    """Rows per artifact that a join sorts and merges.

    Findings are stored in a few bytes each, so Spark would take millions of artifacts for a small table and give all to every task.
    """
    return marks.hint("merge")


def aggregate_verdict(findings: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Verdict per artifact: blocking error, then missing proof, then warning, then pass.

    Artifacts are those named by findings or limits; flags combine on the map side,
    so an artifact with very many findings is no burden.
    """
    flags = _flags(findings, F.lit(False).alias("unproven"))
    if limits is not None:
        flags = flags.unionByName(
            limits.select(
                "artifact",
                F.lit(False).alias("fails"),
                F.col("type").isin("budget", "permissions").alias("unproven"),
                F.lit(False).alias("warns"),
            )
        )
    return flags.groupBy("artifact").agg(
        F.when(F.bool_or("fails"), FAIL)
        .when(F.bool_or("unproven"), INDETERMINATE)
        .when(F.bool_or("warns"), WARN)
        .otherwise(PASS)
        .alias("verdict")
    )


def gate_status(runs: DataFrame, strict: bool = False) -> DataFrame:
    """Per run (``artifact, type, verdict``): does it fail the gate, did it error?"""
    warned = (F.col("verdict") == WARN) & ((F.col("type") == "migration") | F.lit(strict))
    return runs.select(
        "artifact",
        "type",
        "verdict",
        ((F.col("verdict") == FAIL) | warned).alias("failing"),
        F.col("type").isin("unknown", "error").alias("errored"),
    )


def exit_code(gate: DataFrame) -> DataFrame:
    """One row: 2 if anything errored, else 1 if anything fails, else 0."""
    code = F.when(F.col("errored"), 2).when(F.col("failing"), 1).otherwise(0)
    return gate.agg(F.coalesce(F.max(code), F.lit(0)).alias("exit_code"))


def verdict_exit_code(verdict: Column) -> Column:
    """The exit code of one verdict on its own."""
    return (
        F.when(verdict.isin("correct", "likely-correct", PASS), 0)
        .when(verdict.isin("incorrect", FAIL, WARN), 1)
        .otherwise(2)
    )


def report_rows(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per artifact: verdict and the ids of its findings, with their number if more than one.

    Findings are counted per id first, so only distinct ids are gathered and written.
    """
    counted = findings.groupBy("artifact", "id").agg(F.count("*").alias("times"))
    listed = counted.groupBy("artifact").agg(
        F.array_sort(F.collect_list(F.struct("id", "times"))).alias("found")
    )
    ids = F.transform(
        "found",
        lambda item: F.when(item["times"] > 1, F.concat(item["id"], F.lit(" ("), item["times"].cast("string"), F.lit(")")))
        .otherwise(item["id"]),
    )
    return runs.join(_many(listed), "artifact", "left").select(
        "artifact",
        F.upper("verdict").alias("verdict"),
        F.coalesce(F.array_join(ids, ", "), F.lit("-")).alias("finding_ids"),
    )


def report_totals(gate: DataFrame) -> DataFrame:
    """One row: runs, and how many of them fail or errored."""
    return gate.agg(
        F.count("*").alias("artifacts"),
        F.count_if(F.col("failing") | F.col("errored")).alias("failed"),
    )


def to_runs(
    artifacts: DataFrame, findings: DataFrame, limits: DataFrame | None = None
) -> DataFrame:
    """One run per artifact (``artifact, type``), also for those nothing was found on.

    Run verdicts follow the kind of artifact: a query with a missing proof warns, a
    pair or a table without proof is indeterminate, unknown texts always are. The
    confidence says what the verdict rests on.
    """
    strategy = F.col("strategy")
    flags = _flags(
        findings,
        strategy.isin("production_explain", "static_parse").alias("diagnosed"),
        (strategy == "production_bounded_probe").alias("probed"),
        F.lit(None).cast("boolean").alias("budget"),
    )
    if limits is not None:
        flags = flags.unionByName(limits.select("artifact", (F.col("type") == "budget").alias("budget")), allowMissingColumns=True)
    marks = flags.groupBy("artifact").agg(
        F.when(F.bool_or("fails"), FAIL).when(F.bool_or("warns"), WARN).otherwise(PASS).alias("verdict"),
        *[F.bool_or(mark).alias(mark) for mark in ("diagnosed", "probed", "budget")],
    )
    runs = artifacts.join(_many(marks), "artifact", "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit(PASS))
    )
    kind, limited = F.col("type"), F.col("budget").isNotNull()
    warned = F.when(F.col("verdict") == PASS, WARN).otherwise(F.col("verdict"))
    verdict = (
        F.when(kind.isin("unknown", "error"), INDETERMINATE)
        .when((kind == "query") & F.coalesce("budget", F.lit(False)), warned)
        .when((kind != "query") & limited, INDETERMINATE)
        .otherwise(F.col("verdict"))
    )
    severity = (
        F.when(F.col("verdict") == FAIL, "error").when(F.col("verdict") == PASS, "none").otherwise("warn")
    )
    confidence = (
        F.when(F.col("verdict") == INDETERMINATE, "advisory")
        .when((kind == "query") & F.coalesce("diagnosed", F.lit(False)), "explain")
        .when((kind == "migration") & F.coalesce("probed", F.lit(False)), "bounded")
        .when(kind.isin("query", "migration"), "metadata")
        .otherwise("exact")
    )
    return runs.withColumn("verdict", verdict).select(
        *artifacts.columns, "verdict", severity.alias("severity"), confidence.alias("confidence")
    )


def run_rows(spark, rows: Sequence[tuple[str, str]]) -> DataFrame:
    """Artifacts that are not SQL texts, such as checked tables: (artifact, type)."""
    return literal_rows(spark, [("artifact", "string"), ("type", "string")], rows)
