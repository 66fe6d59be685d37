"""What a proposed change would touch, and which existing values would not survive it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import (
    AnalysisException,
    ArithmeticException,
    ArrayIndexOutOfBoundsException,
    DateTimeException,
    NumberFormatException,
    ParseException,
    SparkRuntimeException,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from dataproof.functions.casts import as_type, cast_fails, is_unprobeable
from dataproof.functions.changetext import UNSUPPORTED, change_class_columns, change_class_of
from dataproof.functions.display import format_count
from dataproof.functions.literal import literal_rows
from dataproof.functions.sqltext import EXTERNAL_FUNCTIONS, JVM_FUNCTIONS
from dataproof.operators.profile import part_units, storage_columns
from dataproof.operators.stability import SUBQUERIES, expressions_of
from dataproof.spec import DELETE, MODIFY_COLUMN, UPDATE, ChangeSpec, TableSpec, as_column

OK = "ok"
WARNING = "warning"
UNKNOWN = "unknown"
ERROR = "error"
# Statuses from best to worst.
STATUS_ORDER = [OK, UNKNOWN, WARNING, ERROR]

NO_EVIDENCE = "none"
UPPER_BOUND = "table-metadata-upper-bound"
PART_SCAN = "predicate-part-scan"


#: What an expression can do wrong on the data. Lost executors and cancelled jobs are none of it.
DATA_ERRORS = (
    AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException,
    NumberFormatException, SparkRuntimeException,
)


@dataclass(frozen=True)
class Probe:
    """One conversion to judge; ``settled`` holds (status, message) if no data is needed."""

    check: str
    subject: str
    expression: str | None = None
    target: DataType | str | None = None
    nullable: bool = False
    settled: tuple[str, str] | None = None


def predicate_match(df: DataFrame, predicate: Column | str) -> DataFrame:
    """One row: how many rows the predicate of a mutation matches."""
    return df.filter(as_column(predicate)).agg(F.count("*").alias("matching_rows"))


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("bigint")


def _bytes_or_unknown(parts: Column, total: Column) -> Column:
    """No parts are zero bytes; parts of unknown size are NULL bytes."""
    return F.when(parts == 0, F.lit(0)).otherwise(total).cast("bigint")


def blast_radius(
    df: DataFrame,
    predicate: Column | str,
    part: Column | str | None = None,
    size: Column | str | None = None,
) -> DataFrame:
    """One row: matching rows, and all rows and bytes of the parts that hold one.

    The predicate is a filter, so it prunes partitions and reaches the files; matching rows are
    counted per part. Rows of the parts come from the footers of their files, or from a scan of logical parts.
    """
    unit, _ = storage_columns(part, size)
    hits = df.filter(as_column(predicate)).groupBy(unit.alias("part")).agg(F.count("*").alias("hits"))
    rows = part_units(df, None, part, size)
    touched = hits.withColumnRenamed("part", "hit_part").join(rows, F.col("hit_part").eqNullSafe(F.col("part")))
    return touched.agg(
        _zero(F.sum("hits")).alias("matching_rows"),
        _zero(F.sum("rows")).alias("affected_part_rows"),
        F.count("*").alias("affected_parts"),
        _bytes_or_unknown(F.count("*"), F.sum("bytes")).alias("affected_bytes"),
    )


def full_rewrite_bound(summary: DataFrame) -> DataFrame:
    """The whole table as the upper bound of a rewrite, from a ``parts_summary`` row."""
    return summary.select(
        F.col("rows").alias("matching_rows"),
        F.col("rows").alias("affected_part_rows"),
        F.col("active_parts").alias("affected_parts"),
        F.col("bytes").alias("affected_bytes"),
        F.lit(UPPER_BOUND).alias("evidence"),
    )


def no_rewrite(spark) -> DataFrame:
    """The estimate of a change that rewrites nothing."""
    fields = [
        ("matching_rows", "bigint"), ("affected_part_rows", "bigint"),
        ("affected_parts", "bigint"), ("affected_bytes", "bigint"), ("evidence", "string"),
    ]
    return literal_rows(spark, fields, [(0, 0, 0, 0, NO_EVIDENCE)])


def cast_probe(
    df: DataFrame,
    value: Column | str,
    target: DataType | str,
    predicate: Column | str | None = None,
) -> DataFrame:
    """One row: checked rows, non-null values without an exact counterpart, nulls."""
    if is_unprobeable(target):
        raise ValueError(f"values cannot be probed one by one for {as_type(target).simpleString()}")
    rows = df.filter(as_column(predicate)) if predicate is not None else df
    probed = rows.select(as_column(value).alias("value"))
    source = probed.schema["value"].dataType
    return probed.agg(
        F.count("*").alias("checked_rows"),
        F.count_if(cast_fails(F.col("value"), source, target)).alias("cast_failures"),
        F.count_if(F.col("value").isNull()).alias("null_values"),
    )


_REFUSED = {name.lower() for name in EXTERNAL_FUNCTIONS + JVM_FUNCTIONS}


def safe_expression(expression: str) -> str | None:
    """Why an expression must not run as a probe, or None.

    Spark reads the text; what counts is the tree it makes of it, so words in literals and functions that are named
    like parts of a query decide nothing.
    """
    spark = SparkSession.active()
    if not hasattr(spark, "_jsparkSession"):
        return "this session does not show how it reads an expression"
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(expression)
    except ParseException:
        return "Spark reads no expression in it"
    for node in expressions_of(tree):
        kind = node.getClass().getSimpleName()
        if hasattr(node, "plan") and kind in SUBQUERIES or kind == "InSubquery":
            return "subqueries are not allowed in probe expressions"
        if kind == "ExpressionWithUnresolvedIdentifier":
            return "functions named by IDENTIFIER are not allowed in probe expressions"
        if kind == "UnresolvedFunction":
            parts = node.nameParts()
            name = parts.apply(parts.size() - 1)
            if name.lower() in _REFUSED:
                return f"external function {name}() is not allowed in probe expressions"
    return None


def _probe(check: str, subject: str, expression: str, target, nullable: bool) -> Probe:
    unsafe = safe_expression(expression)
    if unsafe:
        return Probe(check, subject, settled=(ERROR, f"{subject} was not evaluated: {unsafe}."))
    kind = as_type(target)
    if is_unprobeable(kind):
        return Probe(
            check,
            subject,
            settled=(UNKNOWN, f"{subject} was not checked: {kind.simpleString()} is not probed by value."),
        )
    return Probe(check, subject, expression, kind, nullable)


def _modify_probe(df: DataFrame, column: str, target, nullable: bool) -> Probe:
    if column not in df.columns:
        return Probe("cast-safety", column, settled=(ERROR, f"Column {column} does not exist."))
    return _probe("cast-safety", f"Column {column}", f"`{column}`", target, nullable)


def _update_probes(df: DataFrame, assignments: Mapping[str, str]) -> list[Probe]:
    probes = []
    for column, expression in assignments.items():
        if column not in df.columns:
            message = f"UPDATE assigns to missing column {column}."
            probes.append(Probe("update-expression", column, settled=(ERROR, message)))
            continue
        field = df.schema[column]
        probes.append(
            _probe("update-expression", f"UPDATE of {column}", expression, field.dataType, field.nullable)
        )
    return probes


def _expression_probe(column: str, expression: str, target, kind: str, nullable: bool) -> Probe:
    return _probe("column-expression", f"{kind.upper()} of {column}", expression, target, nullable)


def _failures(position: int, probe: Probe) -> Column:
    """Failed conversions, and nulls where the target takes none."""
    failures = F.col(f"failed_{position}")
    return failures if probe.nullable else failures + F.col(f"nulls_{position}")


def _message(position: int, probe: Probe, checked: Column) -> Column:
    target = as_type(probe.target).simpleString()
    failures = _failures(position, probe)
    nulls = F.when(
        F.lit(not probe.nullable) & (F.col(f"nulls_{position}") > 0),
        F.concat(
            F.lit(", of them "), format_count(F.col(f"nulls_{position}")),
            F.lit(" NULL for a target without NULLs"),
        ),
    ).otherwise("")
    bad = F.concat(
        F.lit(f"{probe.subject}: "), format_count(failures), F.lit(f" row(s) do not convert to {target}"),
        nulls, F.lit("."),
    )
    good = F.concat(
        F.lit(f"{probe.subject}: all "), format_count(checked), F.lit(f" row(s) convert to {target}."),
    )
    return F.when(failures > 0, bad).otherwise(good)


def _finding(position: int, probe: Probe, checked: Column) -> Column:
    """The outcome of a probe as a struct over the aggregated counts."""
    if probe.settled:
        status, message = F.lit(probe.settled[0]), F.lit(probe.settled[1])
        counts = [F.lit(0).cast("bigint")] * 3
    else:
        status = F.when(_failures(position, probe) > 0, ERROR).otherwise(OK)
        message = _message(position, probe, checked)
        counts = [checked, F.col(f"failed_{position}"), F.col(f"nulls_{position}")]
    return F.struct(
        F.lit(probe.check).alias("check"),
        F.lit(probe.subject).alias("subject"),
        status.alias("status"),
        *[count.alias(name) for count, name in zip(counts, ("checked_rows", "cast_failures", "null_values"))],
        message.alias("message"),
    )


def _measured(probes: Sequence[Probe]) -> list[tuple[int, Probe]]:
    return [(position, probe) for position, probe in enumerate(probes) if probe.settled is None]


def _values(probes: Sequence[Probe]) -> list[Column]:
    return [F.expr(probe.expression).alias(f"value_{position}") for position, probe in _measured(probes)]


def _counters(rows: DataFrame, probes: Sequence[Probe]) -> list[Column]:
    counters = []
    for position, probe in _measured(probes):
        value = F.col(f"value_{position}")
        source = rows.schema[f"value_{position}"].dataType
        null = value.isNull()
        counters.append(F.count_if(cast_fails(value, source, probe.target)).alias(f"failed_{position}"))
        counters.append(F.count_if(null).alias(f"nulls_{position}"))
    return counters


def probe_findings(
    df: DataFrame, probes: Sequence[Probe], predicate: Column | str | None = None
) -> DataFrame:
    """One row per probe; all of them share one scan under one predicate."""
    rows = df.filter(as_column(predicate)) if predicate is not None else df
    if _measured(probes):
        values = rows.select(*_values(probes))
        counts = values.agg(F.count("*").alias("checked"), *_counters(values, probes))
    else:
        counts = df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("checked"))
    findings = [_finding(position, probe, F.col("checked")) for position, probe in enumerate(probes)]
    return counts.select(F.inline(F.array(*findings)))


def modify_column_probe(
    df: DataFrame, column: str, target: DataType | str, nullable: bool = False
) -> DataFrame:
    """Does every existing value of a column fit its new type?"""
    return probe_findings(df, [_modify_probe(df, column, target, nullable)])


def update_expr_probe(
    df: DataFrame, assignments: Mapping[str, str], predicate: Column | str
) -> DataFrame:
    """Does every new value of an UPDATE fit its column? One row per assignment."""
    return probe_findings(df, _update_probes(df, assignments), predicate)


def column_expr_probe(
    df: DataFrame,
    expression: str,
    target: DataType | str,
    kind: str = "default",
    column: str = "column",
    nullable: bool = False,
) -> DataFrame:
    """Does a DEFAULT or MATERIALIZED expression fit its type on every row?"""
    return probe_findings(df, [_expression_probe(column, expression, target, kind, nullable)])


def change_class(changes: DataFrame) -> DataFrame:
    """Class and rewrite scope for a table of changes with ``op`` and ``kind``."""
    classification, scope = change_class_columns(F.col("op"), F.col("kind"))
    return changes.withColumn("classification", classification).withColumn("rewrite_scope", scope)


def _rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(name) for name in STATUS_ORDER]), status)


def worst_status(statuses: Column) -> Column:
    """The worst of an array of statuses; ``ok`` for none."""
    worst = F.lit(OK)
    for name in STATUS_ORDER[1:]:
        worst = F.when(F.array_contains(statuses, name), name).otherwise(worst)
    return worst


def correctness_status(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The worst status over all findings, or per group; ``ok`` where there are none."""
    worst = F.max(F.struct(_rank(F.col("status")).alias("rank"), F.col("status").alias("name")))["name"]
    return findings.groupBy(*by).agg(F.coalesce(worst, F.lit(OK)).alias("status"))


# Operations whose predicate or expressions have to be read before they can be judged.
def _unsupported_reason(change: ChangeSpec, classification: str) -> str | None:
    if classification == UNSUPPORTED:
        return f"No cost model for the operation {change.op}."
    if change.op in {UPDATE, DELETE}:
        if not change.predicate or not change.predicate.strip():
            return f"{change.op.upper()} without a predicate."
        unsafe = safe_expression(change.predicate)
        if unsafe:
            return f"The predicate was not evaluated: {unsafe}."
        if change.op == UPDATE and not change.assignments:
            return "UPDATE without assignments."
    return None


def _probes_of(df: DataFrame, change: ChangeSpec) -> list[Probe]:
    probes = []
    if change.op == UPDATE:
        probes += _update_probes(df, change.assignments)
    if change.op == MODIFY_COLUMN and change.column and change.target_type and change.kind != "materialized":
        probes.append(_modify_probe(df, change.column, change.target_type, change.nullable))
    if change.expression and change.kind and change.column and change.target_type:
        probes.append(
            _expression_probe(
                change.column, change.expression, change.target_type, change.kind, change.nullable
            )
        )
    return probes


def dry_run_change(
    df: DataFrame,
    spec: TableSpec,
    change: ChangeSpec,
    size: Column | str | None = None,
    on_error: str = "finding",
) -> DataFrame:
    """One row: class, table footprint, rewrite estimate and the outcome of all probes.

    Matching rows and probes come from one scan that the predicate prunes, rows and bytes of parts from footers (or, for
    logical parts, a scan of the part column); a change that rewrites and probes nothing reads no data. Nothing is ever written. With
    ``on_error="finding"`` the job runs at once, and a predicate or probe that fails on the data
    becomes an error finding; any other failure is raised. With ``"raise"`` the result stays lazy.
    """
    classification, scope = change_class_of(change.op, change.kind)
    problem = _unsupported_reason(change, classification)
    if problem:
        classification, scope = UNSUPPORTED, "none"
    probes = [] if problem else _probes_of(df, change)
    if on_error == "raise":
        return _dry_run(df, spec, change, size, classification, scope, problem, probes)
    try:
        return _evaluated(_dry_run(df, spec, change, size, classification, scope, problem, probes))
    except DATA_ERRORS:
        failed = _failed_predicate(df, change.predicate) if scope == "predicate" else None
        if failed:
            message = "was not checked: the predicate fails on current data."
            tested = [Probe(p.check, p.subject, settled=p.settled or (UNKNOWN, f"{p.subject} {message}")) for p in probes]
        else:
            tested = [_tested(df, probe, change.predicate) for probe in probes]
        return _evaluated(_dry_run(df, spec, change, size, classification, scope, problem, tested, failed))


def _evaluated(row: DataFrame) -> DataFrame:
    """The single result row, computed now."""
    return df_from_rows(row.sparkSession, row.collect(), row.schema)


def df_from_rows(spark, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _failed_predicate(df: DataFrame, predicate: str) -> str | None:
    """Why the predicate cannot be evaluated on the data, or None."""
    try:
        predicate_match(df, predicate).collect()
    except DATA_ERRORS as error:
        return (str(error).splitlines() or ["unknown error"])[0]
    return None


def _tested(df: DataFrame, probe: Probe, predicate: str | None) -> Probe:
    """The probe itself if it runs alone, else its error."""
    if probe.settled:
        return probe
    try:
        probe_findings(df, [probe], predicate).collect()
    except DATA_ERRORS as error:
        reason = (str(error).splitlines() or ["unknown error"])[0]
        settled = (ERROR, f"{probe.subject} could not be evaluated on current data: {reason}")
        return Probe(probe.check, probe.subject, settled=settled)
    return probe


def _dry_run(
    df: DataFrame,
    spec: TableSpec,
    change: ChangeSpec,
    size: Column | str | None,
    classification: str,
    scope: str,
    problem: str | None,
    probes: Sequence[Probe],
    failed_predicate: str | None = None,
) -> DataFrame:
    applied = scope == "predicate" and failed_predicate is None
    counted = [f"{name}_{position}" for position, _ in _measured(probes) for name in ("failed", "nulls")]
    parts = part_units(df, None, spec.part, size).select("part", "rows", "bytes")
    if applied or counted:
        # One scan for matching rows and probes; the predicate is its filter.
        unit, _ = storage_columns(spec.part, size)
        matching = df.filter(as_column(change.predicate)) if applied else df
        rows = matching.select(unit.alias("hit_part"), *_values(probes))
        found = rows.groupBy("hit_part").agg(F.count("*").alias("found"), *_counters(rows, probes))
        parts = parts.join(found, F.col("part").eqNullSafe(F.col("hit_part")), "left")
    hits = {"predicate": _zero(F.col("found")) if applied else F.lit(0), "all": F.col("rows"), "none": F.lit(0)}[scope]
    per_part = parts.withColumn("hits", hits)
    touched = F.col("hits") > 0
    totals = per_part.agg(
        _zero(F.sum("rows")).alias("table_rows"),
        F.count("*").alias("active_parts"),
        F.sum("bytes").cast("bigint").alias("table_bytes"),
        _zero(F.sum("hits")).alias("matching_rows"),
        _zero(F.sum(F.when(touched, F.col("rows")))).alias("affected_part_rows"),
        F.count_if(touched).alias("affected_parts"),
        _bytes_or_unknown(F.count_if(touched), F.sum(F.when(touched, F.col("bytes")))).alias("affected_bytes"),
        *[_zero(F.sum(name)).alias(name) for name in counted],
    )
    checked = F.col("matching_rows") if scope == "predicate" else F.col("table_rows")
    findings = []
    if failed_predicate is not None:
        message = f"The predicate could not be evaluated on current data: {failed_predicate}"
        findings.append(_finding(0, Probe("predicate", "predicate", settled=(ERROR, message)), checked))
    elif scope == "predicate":
        findings.append(
            F.struct(
                F.lit("predicate").alias("check"),
                F.lit("predicate").alias("subject"),
                F.lit(OK).alias("status"),
                F.col("matching_rows").alias("checked_rows"),
                F.lit(0).cast("bigint").alias("cast_failures"),
                F.lit(0).cast("bigint").alias("null_values"),
                F.concat(F.lit("The predicate matches "), format_count(F.col("matching_rows")), F.lit(" row(s)."))
                .alias("message"),
            )
        )
    findings += [_finding(position, probe, checked) for position, probe in enumerate(probes)]
    evidence = {"none": NO_EVIDENCE, "all": UPPER_BOUND, "predicate": PART_SCAN}[scope]
    if failed_predicate is not None:
        evidence = NO_EVIDENCE
    correctness = F.array(*findings) if findings else F.array().cast(_FINDING_TYPE)
    return totals.select(
        F.lit(spec.name).alias("table"),
        F.lit(change.op).alias("op"),
        F.lit(classification).alias("classification"),
        F.lit(scope).alias("rewrite_scope"),
        F.lit(problem).cast("string").alias("unsupported_reason"),
        "table_rows",
        "active_parts",
        "table_bytes",
        "matching_rows",
        "affected_part_rows",
        "affected_parts",
        "affected_bytes",
        F.lit(evidence).alias("evidence"),
        correctness.alias("correctness"),
    ).withColumn("correctness_status", worst_status(F.col("correctness.status")))


_FINDING_TYPE = (
    "array<struct<check:string,subject:string,status:string,checked_rows:bigint,"
    "cast_failures:bigint,null_values:bigint,message:string>>"
)
