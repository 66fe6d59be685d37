"""Many checks over many artifacts, joined into one set of findings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from dataproof.operators.artifacts import query_advisories, triage
from dataproof.operators.changes import dry_run_change
from dataproof.operators.profile import largest_partitions, partition_stats, parts_summary
from dataproof.operators.pruning import no_scan_evidence, scan_findings
from dataproof.operators.readpath import read_path_check
from dataproof.operators.rowdiff import verify_equivalent
from dataproof.operators.uniqueness import (
    dedup_eligibility,
    dup_sample,
    duplicate_proof,
    ineligible_reason,
    scan_guard,
    scope_partition,
)
from dataproof.plans.findings import (
    dedup_finding,
    dedup_limit,
    diagnosis_finding,
    equivalence_finding,
    equivalence_limit,
    exit_code,
    gate_status,
    migration_finding,
    migration_limit,
    read_path_finding,
    read_path_limit,
    report_rows,
    run_rows,
    to_runs,
)
from dataproof.sources.keep import keep
from dataproof.sources.shared import new_folder
from dataproof.spec import ChangeSpec, TableSpec

#: Checks of a suite that are computed at the same time.
CHECKS_AT_ONCE = 4


@dataclass(frozen=True)
class Check:
    """The outcome of a check on data: its findings and limits, both may be None.

    A duplicate proof also has ``samples``, the keys with the most copies, and, if it was skipped, ``partitions``, the
    largest ones to prove instead. Both are lazy: they read the table when they are asked for.
    """

    findings: DataFrame | None = None
    limits: DataFrame | None = None
    artifacts: DataFrame | None = None
    samples: DataFrame | None = None
    partitions: DataFrame | None = None


class Verification:
    """The tables a suite ends in."""

    def __init__(self, artifacts: DataFrame, findings: DataFrame, limits: DataFrame):
        self.artifacts, self.findings, self.limits = artifacts, findings, limits

    @cached_property
    def runs(self) -> DataFrame:
        """One run per artifact; computed and stored when first asked for, as gates and reports read it again."""
        return keep(to_runs(self.artifacts, self.findings, self.limits))

    def gate(self, strict: bool = False) -> DataFrame:
        return gate_status(self.runs, strict)

    def exit_code(self, strict: bool = False) -> DataFrame:
        return exit_code(self.gate(strict))

    def report(self) -> DataFrame:
        return report_rows(self.runs, self.findings)


def text_checks(artifacts: DataFrame) -> Check:
    """What the texts alone tell: advisories, rejections and unsupported changes.

    ``artifacts`` has ``path, sql, prev_sql``. The texts are read once; what is kept
    of them are flags and reasons.
    """
    triaged = keep(triage(artifacts).drop("statement"))
    advised = query_advisories(triaged.select("path", "shape.*"))
    limits = triaged.filter(F.col("limit_type").isNotNull()).select(
        F.col("path").alias("artifact"),
        F.col("limit_type").alias("type"),
        F.col("limit_message").alias("message"),
    )
    rows = triaged.select(F.col("path").alias("artifact"), "type", "fingerprint")
    return Check(diagnosis_finding(advised), limits, rows)


def dedup_check(
    df: DataFrame,
    spec: TableSpec,
    partition: object = None,
    max_rows: int = 0,
    max_bytes: int = 0,
    size: Column | str | None = None,
) -> Check:
    """The duplicate proof of one table, or the reason why there is none.

    Tables of any size are proven. Only where the caller sets a budget is a table beyond
    it not read, unless one partition is named; sizes come from rows per stored part.
    """
    artifacts = run_rows(df.sparkSession, [(spec.name, "table_assumption")])
    if ineligible_reason(spec, df.columns):
        return Check(None, dedup_limit(dedup_eligibility(spec, df), spec.name), artifacts)
    if partition is not None:
        df = scope_partition(df, spec.partition, partition)
    elif max_rows > 0 or max_bytes > 0:
        guard = keep(scan_guard(parts_summary(df, None, spec.part, size), max_rows, max_bytes))
        if guard.first()["scan_skipped"]:
            largest = largest_partitions(partition_stats(df, spec.partition, spec.part, size))
            return Check(None, dedup_limit(guard, spec.name), artifacts, partitions=_of(spec.name, largest))
    by = spec.partition if partition is None else None
    proof = duplicate_proof(df, spec.dedup_key, by)
    keys = F.to_json(F.struct(*[F.col(name) for name in spec.dedup_key])).alias("key")
    sample = dup_sample(df, spec.dedup_key, by).select(F.col("partition").cast("string").alias("partition"), keys, "copies")
    return Check(dedup_finding(proof, spec.name), None, artifacts, samples=_of(spec.name, sample))


def _of(artifact: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(artifact).alias("artifact"), "*")


def equivalence_check(
    left: DataFrame, right: DataFrame, artifact: str, round_to: int | None = None, max_rows: int | None = None
) -> Check:
    """The comparison of two queries."""
    result = keep(verify_equivalent(left, right, round_to, max_rows))
    return Check(
        equivalence_finding(result, artifact),
        equivalence_limit(result, artifact),
        run_rows(left.sparkSession, [(artifact, "query_pair")]),
    )


def change_check(
    df: DataFrame, spec: TableSpec, change: ChangeSpec, artifact: str, size: Column | str | None = None
) -> Check:
    """The dry run of one change."""
    result = dry_run_change(df, spec, change, size)
    return Check(
        migration_finding(result, artifact),
        migration_limit(result, artifact),
        run_rows(df.sparkSession, [(artifact, "migration")]),
    )


def read_path_checks(reads: DataFrame, assumptions: DataFrame, proofs: DataFrame) -> Check:
    outcomes = read_path_check(reads, assumptions, proofs)
    return Check(read_path_finding(outcomes), read_path_limit(outcomes))


def scan_checks(queries: DataFrame, ratios: DataFrame, sizes: DataFrame) -> Check:
    """Pruning findings per table, given to each query (``path, table``) that reads it.

    The ratios hold two rows per table and are kept, so the tables are read once.
    """
    known = keep(ratios)
    notes = queries.join(scan_findings(known, keep(sizes)), "table").drop("table")
    missing = no_scan_evidence(queries, known).drop("table")
    return Check(diagnosis_finding(notes).unionByName(diagnosis_finding(missing)))


def verify_suite(checks: Sequence[Check | Callable[[], Check]], at_once: int = CHECKS_AT_ONCE) -> Verification:
    """Unites checks into findings, limits and one run per artifact.

    Artifacts come from the checks that declare them (``artifact, type``). A check can be a function that
    makes it. Checks are made, and their findings and limits computed, ``at_once`` at a time, each in a scheduler pool of
    its own (which shares the cluster fairly where the session's scheduler is FAIR), and stored in one Parquet table
    each, partitioned by check; runs and reports read them again. The first check that fails ends the suite with its error.
    """
    if not checks:
        raise ValueError("a suite needs at least one check with artifacts and one with findings")
    # The first check that is not a function names the session; else it is the active one.
    made = next((c for c in checks if isinstance(c, Check)), None)
    frames = [f for f in (made.findings, made.limits, made.artifacts) if f is not None] if made else []
    spark = frames[0].sparkSession if frames else SparkSession.active()
    stores = {kind: new_folder(spark, kind) for kind in ("findings", "limits")}

    def compute(number: int) -> Check:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"check-{number}")
        check = checks[number] if isinstance(checks[number], Check) else checks[number]()
        for kind, frame in (("findings", check.findings), ("limits", check.limits)):
            if frame is not None:
                frame.write.parquet(f"{stores[kind]}/check={number}")
        return check

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(compute), range(len(checks))))
    artifacts = _union([check.artifacts for check in done])
    findings = _stored(spark, stores["findings"], [check.findings for check in done])
    limits = _stored(spark, stores["limits"], [check.limits for check in done])
    if artifacts is None or findings is None:
        raise ValueError("a suite needs at least one check with artifacts and one with findings")
    if limits is None:
        limits = spark.createDataFrame([], "artifact STRING, type STRING, message STRING")
    return Verification(artifacts, findings, limits)


def _stored(spark: SparkSession, store: str, frames: Sequence[DataFrame | None]) -> DataFrame | None:
    """The stored rows of all frames; a column that some of them lack is NULL there."""
    fields = {field.name: field for frame in frames if frame is not None for field in frame.schema.fields}
    if not fields:
        return None
    return spark.read.schema(StructType([*fields.values(), StructField("check", IntegerType())])).parquet(store).drop("check")


def _union(frames: Sequence[DataFrame | None]) -> DataFrame | None:
    united = None
    for frame in frames:
        if frame is not None:
            united = frame if united is None else united.unionByName(frame, allowMissingColumns=True)
    return united


def verify_sql_pair(spark, before: str, after: str, round_to: int | None = None) -> DataFrame:
    """Two query texts compared by result; Spark parses and plans them."""
    return verify_equivalent(spark.sql(before), spark.sql(after), round_to)
