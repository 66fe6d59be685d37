"""Does a query trust a uniqueness that its tables violate?"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataproof.functions.display import format_count
from dataproof.functions.keys import bare_name, normalized_key, same_key
from dataproof.functions.literal import literal_rows
from dataproof.operators.uniqueness import duplicate_proof, ineligible_reason
from dataproof.spec import TableSpec

VIOLATED = "violated"
CLEAN = "clean"
UNKNOWN = "unknown"


def proof_rows(
    tables: Mapping[str, DataFrame], specs: Sequence[TableSpec], too_large: Sequence[str] = ()
) -> DataFrame:
    """One duplicate proof per eligible table, as ``table, dedup_key, duplicate_rows``.

    Ineligible tables are left out. Tables named in ``too_large`` (see
    ``scan_guard``) are not read; their ``scan_skipped`` is true.
    """
    if not tables:
        raise ValueError("no tables to prove")
    spark = next(iter(tables.values())).sparkSession
    proofs = literal_rows(
        spark,
        [("table", "string"), ("dedup_key", "array<string>"), ("duplicate_rows", "bigint"),
         ("scan_skipped", "boolean")],
        [(spec.name, list(spec.dedup_key), 0, True) for spec in specs if spec.name in too_large],
    )
    for spec in specs:
        df = tables.get(spec.name)
        if df is None or spec.name in too_large or ineligible_reason(spec, df.columns):
            continue
        # The scope is the whole table, so the partition does not matter here.
        proof = duplicate_proof(df, spec.dedup_key)
        proofs = proofs.unionByName(
            proof.select(
                F.lit(spec.name).alias("table"),
                F.array(*[F.lit(name) for name in spec.dedup_key]).alias("dedup_key"),
                F.col("final_collapsible_rows").alias("duplicate_rows"),
                F.lit(False).alias("scan_skipped"),
            )
        )
    return proofs


def assumption_lookup(tables: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Adds ``unique_by`` to rows with a ``table``: by qualified name, else by bare name.

    A table that is declared unique by several keys gives a row for each; lists that name the same columns are one key.
    """
    key = F.array_sort(F.array_distinct(normalized_key(F.col("unique_by"))))
    declared = assumptions.groupBy("table", key.alias("key")).agg(F.min("unique_by").alias("unique_by")).drop("key")
    every = declared.groupBy("table").agg(F.collect_set("unique_by").alias("keys"))
    exact = every.select("table", F.col("keys").alias("exact_keys"))
    loose = every.select(F.col("table").alias("bare"), F.col("keys").alias("bare_keys"))
    return (
        tables.withColumn("bare", bare_name(F.col("table")))
        .join(exact, "table", "left")
        .join(loose, "bare", "left")
        .withColumn("unique_by", F.explode_outer(F.coalesce("exact_keys", "bare_keys")))
        .drop("bare", "exact_keys", "bare_keys")
    )


def read_path_check(reads: DataFrame, assumptions: DataFrame, proofs: DataFrame) -> DataFrame:
    """Per (query, table, declared key) read without collapsing: does the uniqueness hold?

    ``reads`` has ``query_id, table`` and ``uses_final`` (NULL: not known to collapse) or, from ``reads_of``,
    ``collapsed_by``: a read that keeps one row for some of the declared columns trusts nothing. Tables without a proof
    are left out rather than guessed. Each key that is declared for a table has an outcome of its own.
    """
    outcomes = judge_trust(assumption_lookup(proofs, assumptions).filter(F.size("unique_by") > 0))
    if "uses_final" in reads.columns:
        reads = reads.filter(~F.coalesce("uses_final", F.lit(False)))
    by = F.col("collapsed_by") if "collapsed_by" in reads.columns else F.lit(None).cast("array<string>")
    trusting = reads.select("query_id", "table", by.alias("collapsed_by")).distinct()
    missing = F.array_except(normalized_key(F.col("collapsed_by")), normalized_key(F.col("unique_by")))
    collapsed = F.coalesce(F.size(missing) == 0, F.lit(False))
    found = trusting.join(outcomes, "table").filter(~collapsed)
    return found.select("query_id", "table", "unique_by", "status", "duplicate_rows", "message").distinct()


def judge_trust(trusted: DataFrame) -> DataFrame:
    """One outcome per proof and declared key; queries that read the table share it."""
    bound = same_key(F.col("unique_by"), F.col("dedup_key"))
    keys = F.array_join("unique_by", ", ")
    dirty = F.col("duplicate_rows") > 0
    status = (
        F.when(~bound | F.col("scan_skipped"), UNKNOWN).when(dirty, VIOLATED).otherwise(CLEAN)
    )
    message = (
        F.when(
            ~bound,
            F.concat(
                "table", F.lit(" is declared unique by ("), keys, F.lit("), but deduplicates by ("),
                F.array_join("dedup_key", ", "), F.lit("); declare that key to have it proven."),
            ),
        )
        .when(
            F.col("scan_skipped"),
            F.concat(
                "table", F.lit(" is too large to prove its uniqueness by ("), keys, F.lit(").")
            ),
        )
        .when(
            dirty,
            F.concat(
                "table", F.lit(" is trusted to be unique by ("), keys, F.lit("), but holds "),
                format_count(F.col("duplicate_rows")), F.lit(" duplicate row(s); the query can overcount."),
            ),
        )
        .otherwise(F.concat("table", F.lit(" is unique by ("), keys, F.lit(").")))
    )
    return trusted.select(
        "table",
        "unique_by",
        status.alias("status"),
        F.when(status == VIOLATED, F.col("duplicate_rows")).otherwise(0).cast("bigint").alias("duplicate_rows"),
        message.alias("message"),
    )


def uniqueness_audit(
    tables: Mapping[str, DataFrame], assumptions: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Every declared uniqueness, checked on the live data by its own columns."""
    audits = None
    for table, unique_by in assumptions.items():
        df = tables[table]
        proof = duplicate_proof(df, list(unique_by)).select(
            F.lit(table).alias("table"),
            F.lit(", ".join(unique_by)).alias("unique_by"),
            F.col("final_collapsible_rows").alias("duplicate_rows"),
            F.when(F.col("final_collapsible_rows") > 0, VIOLATED).otherwise(CLEAN).alias("status"),
        )
        audits = proof if audits is None else audits.unionByName(proof)
    if audits is None:
        raise ValueError("no assumptions to audit")
    return audits
