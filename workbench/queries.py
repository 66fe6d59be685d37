"""Registered queries: each runs one operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import dataproof as d
from dataproof import ChangeSpec, Range
from dataproof.functions.display import format_bytes, format_count
from dataproof.functions.keys import same_key
from dataproof.functions.literal import literal_rows
from dataproof.functions.sqltext import clean_sql, mask_literals, normalize_query
from dataproof.operators.pruning import layout_table
from dataproof.operators.readpath import assumption_lookup
from dataproof.plans import findings as fs
from dataproof.plans.suite import Verification, read_path_checks, scan_checks, text_checks
from dataproof.sources.keep import keep
from dataproof.sources.runlog import append_run_log, read_run_log, run_log_rows
from dataproof.sources.shared import new_folder
from dataproof.sources.slices import extract_slice, slice_catalog, slice_rows, stored_bytes, write_manifest
from workbench import data
from workbench.data import LINEITEM_KEY, MONTH, PART, YEAR, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


# --- duplicates -------------------------------------------------------------


@query
def duplicate_proof(spark, sf_dir):
    return d.duplicate_proof(_lineitem(spark, sf_dir), LINEITEM_KEY, YEAR)


@query
def duplicate_proof_texts(spark, sf_dir):
    return d.duplicate_proof(table(spark, sf_dir, "documents"), ["text"], "lang")


@query
def dup_within_partition_year(spark, sf_dir):
    return d.dup_within_partition(_lineitem(spark, sf_dir), LINEITEM_KEY, YEAR)


@query
def dup_within_partition_month(spark, sf_dir):
    return d.dup_within_partition(_lineitem(spark, sf_dir), LINEITEM_KEY, MONTH)


@query
def dup_global(spark, sf_dir):
    return d.dup_global(_lineitem(spark, sf_dir), LINEITEM_KEY)


@query
def dup_cross_partition(spark, sf_dir):
    return d.dup_cross_partition(_lineitem(spark, sf_dir), LINEITEM_KEY, MONTH)


@query
def dup_sample(spark, sf_dir):
    return d.dup_sample(_lineitem(spark, sf_dir), LINEITEM_KEY, YEAR, 5)


@query
def scope_partition(spark, sf_dir):
    scoped = d.scope_partition(_lineitem(spark, sf_dir), YEAR, 1996)
    return d.duplicate_proof(scoped, LINEITEM_KEY)


@query
def scan_guard(spark, sf_dir):
    df = _lineitem(spark, sf_dir)
    summary = d.parts_summary(df, YEAR, PART, F.lit(1_000_000))
    guards = [
        d.scan_guard(summary, max_rows, max_bytes, scoped).withColumn("case", F.lit(case))
        for case, max_rows, max_bytes, scoped in (
            ("default", 200_000_000, 50_000_000_000, False),
            ("rows", 1000, 0, False),
            ("bytes", 0, 1000, False),
            ("scoped", 1000, 1000, True),
            ("off", 0, 0, False),
        )
    ]
    united = guards[0]
    for guard in guards[1:]:
        united = united.unionByName(guard)
    return united


@query
def largest_partitions(spark, sf_dir):
    return d.largest_partitions(d.partition_stats(_lineitem(spark, sf_dir), MONTH, PART, F.lit(1000)))


@query
def latest_per_key(spark, sf_dir):
    return d.latest_per_key(_lineitem(spark, sf_dir), LINEITEM_KEY, "l_shipdate")


@query
def latest_per_key_deleted(spark, sf_dir):
    flagged = _lineitem(spark, sf_dir).withColumn("gone", (F.col("l_returnflag") == "R").cast("int"))
    latest = d.latest_per_key(flagged, LINEITEM_KEY, "l_shipdate", "gone")
    return latest.groupBy("l_linenumber").agg(
        F.count("*").alias("rows"), F.sum("l_partkey").alias("sum_partkey"), F.sum("gone").alias("gone")
    )


def _dedup_runs(spark, sf_dir) -> Verification:
    tables = (
        (data.LINEITEM, "lineitem"), (data.ORDERS, "orders"), (data.EVENTS, "events"),
        (data.CUSTOMER, "customer"), (data.PARTS, "part"), (data.NATION, "nation"),
    )
    # Whole tables at any scale, so the budget is off; scan_guard has a query of its own.
    return d.verify_suite([
        d.dedup_check(table(spark, sf_dir, name), spec, max_rows=0, max_bytes=0) for spec, name in tables
    ])


@query
def dedup_finding(spark, sf_dir):
    return _flat(_dedup_runs(spark, sf_dir).findings)


@query
def dedup_eligibility(spark, sf_dir):
    return _dedup_runs(spark, sf_dir).runs


def _flat(findings: DataFrame) -> DataFrame:
    """Findings as plain columns, without wording."""
    return findings.select(
        "artifact", "id", "severity", "verdict", "category", "evidence_level", "strategy", "blocking",
        F.array_join(F.transform("evidence", lambda e: F.concat(e["label"], F.lit("="), e["value"])), ";")
        .alias("evidence"),
    )


# --- row comparison ---------------------------------------------------------


def _filtered_pair(spark, sf_dir):
    left = _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity")
    return left, left.filter("l_quantity > 1")


@query
def diff_counts(spark, sf_dir):
    return d.diff_counts(*_filtered_pair(spark, sf_dir))


@query
def diff_counts_wide(spark, sf_dir):
    left = _lineitem(spark, sf_dir)
    changed = F.when(F.col("l_suppkey") % 50 == 7, F.lit(None)).otherwise(F.col("l_returnflag"))
    right = left.withColumn("l_returnflag", changed).filter("l_linenumber < 7")
    return d.diff_counts(left, right)


@query
def diff_counts_texts(spark, sf_dir):
    left = table(spark, sf_dir, "documents").select("text", "lang")
    return d.diff_counts(left, left.distinct())


@query
def diff_sample(spark, sf_dir):
    left, right = _filtered_pair(spark, sf_dir)
    return d.diff_sample(left, right.union(right.filter("l_linenumber = 2")), 10)


def _pairs(spark, sf_dir) -> dict[str, tuple[DataFrame, DataFrame]]:
    items = _lineitem(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    joined = (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("items"), F.sum("l_quantity").cast("bigint").alias("quantity"))
    )
    per_order = items.groupBy("l_orderkey").agg(
        F.count("*").alias("items"), F.sum("l_quantity").alias("quantity")
    )
    early = (
        per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
        .groupBy("o_orderpriority")
        .agg(F.sum("items").alias("items"), F.sum("quantity").cast("bigint").alias("quantity"))
    )
    narrow = items.select("l_orderkey", "l_linenumber")
    return {
        "rewrite": (joined, early),
        "renamed": (narrow, narrow.withColumnRenamed("l_linenumber", "line")),
        "shape": (narrow, items.select("l_orderkey", "l_quantity")),
        "columns": (narrow, items.select("l_orderkey", "l_linenumber", "l_tax")),
        "rows": (narrow, narrow.filter("l_linenumber <> 3")),
        "unstable": (narrow, narrow.limit(10)),
        "random": (narrow, narrow.filter(F.rand() < 2)),
    }


@query
def verify_equivalent(spark, sf_dir):
    results = None
    for name, (left, right) in _pairs(spark, sf_dir).items():
        result = d.verify_equivalent(left, right).withColumn("pair", F.lit(name))
        results = result if results is None else results.unionByName(result)
    return results.withColumn("explained", F.col("reason").isNotNull()).drop("reason")


@query
def verify_equivalent_rounded(spark, sf_dir):
    items = _lineitem(spark, sf_dir)
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    direct = items.groupBy("l_returnflag").agg(F.sum(value).alias("revenue"))
    staged = (
        items.groupBy("l_returnflag", "l_suppkey").agg(F.sum(value).alias("revenue"))
        .groupBy("l_returnflag").agg(F.sum("revenue").alias("revenue"))
    )
    return d.verify_equivalent(direct, staged, round_to=2).drop("reason")


@query
def compare_shape(spark, sf_dir):
    left, right = _pairs(spark, sf_dir)["columns"]
    filled = right.agg(*[F.count(name).alias(name) for name in right.columns])
    counts = filled.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("right_name"), F.col(name).alias("right_values")) for name in right.columns
    ])))
    return d.compare_shape(left, right).drop("left_type", "right_type").join(counts, "right_name")


@query
def equivalence_finding(spark, sf_dir):
    findings, limits = None, None
    for name, (left, right) in _pairs(spark, sf_dir).items():
        result = d.verify_equivalent(left, right)
        found, limit = d.equivalence_finding(result, name), fs.equivalence_limit(result, name)
        findings = found if findings is None else findings.unionByName(found)
        limits = limit if limits is None else limits.unionByName(limit)
    named = fs.run_rows(spark, [(name, "query_pair") for name in _pairs(spark, sf_dir)])
    runs = d.to_runs(named, findings, limits)
    return d.report_rows(runs, findings)


# --- read paths -------------------------------------------------------------


def _proofs(spark, sf_dir):
    specs = [data.LINEITEM, data.ORDERS, data.EVENTS, data.CUSTOMER, data.PARTS]
    tables = {spec.name: table(spark, sf_dir, spec.bare_name) for spec in specs}
    proofs = d.proof_rows(tables, specs)
    # The log knows the events table under another database.
    return proofs.withColumn(
        "table", F.when(F.col("table") == "db.events", "other.events").otherwise(F.col("table"))
    )


@query
def read_path_check(spark, sf_dir):
    return d.read_path_check(
        data.reads(spark, sf_dir), data.assumptions(spark), _proofs(spark, sf_dir)
    ).select("query_id", "table", "status", "duplicate_rows")


@query
def read_path_finding(spark, sf_dir):
    check = read_path_checks(data.reads(spark, sf_dir), data.assumptions(spark), _proofs(spark, sf_dir))
    verdicts = d.aggregate_verdict(check.findings, check.limits)
    return verdicts.groupBy("verdict").agg(F.count("*").alias("queries"))


@query
def read_path_plans(spark, sf_dir):
    """What queries read comes from their plans; two keys are declared for one table."""
    items, orders, events = (table(spark, sf_dir, name).alias(f"db.{name}") for name in ("lineitem", "orders", "events"))
    latest = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.desc("l_shipdate"))
    queries = {
        "sums": items.groupBy("l_returnflag").agg(F.sum("l_quantity")),
        "latest": items.withColumn("rank", F.row_number().over(latest)).where("rank = 1").agg(F.sum("l_quantity")),
        "joined": items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").count(),
        "picked": events.groupBy("user_id").agg(F.max_by("event_type", "ts")),
        "filtered": orders.where(F.col("o_custkey").isin([]) | (F.col("o_totalprice") > 0)),
    }
    specs = [data.LINEITEM, d.TableSpec("db.orders", ("o_custkey",)), d.TableSpec("db.events", ("user_id",))]
    proofs = d.proof_rows({spec.name: table(spark, sf_dir, spec.bare_name) for spec in specs}, specs)
    assumptions = literal_rows(
        spark, [("table", "string"), ("unique_by", "array<string>")],
        [("db.lineitem", ["l_suppkey"]), ("db.lineitem", LINEITEM_KEY), ("lineitem", ["l_tax"]), ("orders", ["`O_CUSTKEY`"]), ("db.events", ["user_id"])],
    )
    found = d.read_path_check(d.reads_of(queries), assumptions, proofs)
    return found.select("query_id", "table", F.lower(F.array_join("unique_by", ",")).alias("declared"), "status", "duplicate_rows")


@query
def assumption_lookup_reads(spark, sf_dir):
    found = assumption_lookup(data.reads(spark, sf_dir), data.assumptions(spark))
    return found.groupBy("table").agg(
        F.count("*").alias("reads"), F.count_if(F.col("unique_by").isNotNull()).alias("declared")
    )


@query
def key_binding(spark, sf_dir):
    declared = F.array(F.concat(F.lit("`"), F.upper("event_type"), F.lit("`")), F.lit(" USER_ID "))
    key = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("user_id"), F.col("event_type"))).when(
        F.col("event_id") % 3 == 1, F.array(F.lit("user_id"))
    ).otherwise(F.array(F.lit("user_id"), F.col("event_type"), F.lit("ts")))
    return table(spark, sf_dir, "events").select("event_id", same_key(declared, key).alias("bound"))


@query
def uniqueness_audit(spark, sf_dir):
    tables = {name: table(spark, sf_dir, name) for name in ("lineitem", "orders", "events", "documents")}
    return d.uniqueness_audit(
        tables,
        {"lineitem": LINEITEM_KEY, "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["text"]},
    )


# --- table profile ----------------------------------------------------------


@query
def parts_summary(spark, sf_dir):
    return d.parts_summary(_lineitem(spark, sf_dir), YEAR, PART, F.lit(4096))


@query
def parts_summary_files(spark, sf_dir):
    summary = d.parts_summary(_lineitem(spark, sf_dir), YEAR)
    return summary.select("active_parts", "rows", "partitions", (F.col("bytes") > 0).alias("has_bytes"))


@query
def part_stats_files(spark, sf_dir):
    """Rows and bounds of whole files, as their footers state them."""
    stats = d.part_stats(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderdate"])
    return stats.agg(
        F.sum("rows").alias("rows"), F.bool_and(F.col("bytes") > 0).alias("has_bytes"),
        *[f(f"{short}_{name}").alias(f"{short}_{name}") for name in ("o_orderkey", "o_custkey", "o_orderdate") for f, short in ((F.min, "min"), (F.max, "max"))],
    )


@query
def stored_columns(spark, sf_dir):
    """Type, nullability and default of every column; that its codec and bytes are known, and values fill them."""
    items = _lineitem(spark, sf_dir)
    spec = d.TableSpec("db.lineitem", generated={"l_tax": ("DEFAULT", "0.0")})
    filled = items.agg(*[F.count(name).alias(name) for name in items.columns]).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(name).alias("filled")) for name in items.columns
    ])))
    return d.column_profile(items, spec).join(filled, "name").select(
        "pos", "name", "type", "nullable", "default_kind", "default_expr", "filled",
        (F.col("codec") != "").alias("has_codec"), F.col("plain_bytes").between(F.col("filled") / 1000, F.col("filled") * 100).alias("sized"),
    )


@query
def partition_stats(spark, sf_dir):
    return d.partition_stats(_lineitem(spark, sf_dir), MONTH, PART, F.lit(4096))


@query
def table_profile(spark, sf_dir):
    profile = d.table_profile(_lineitem(spark, sf_dir), data.LINEITEM)
    return profile.select(
        "table", "sort_key", "partition_by", "version_column", "is_versioned", "rows", "active_parts",
        "partitions", F.size("columns").alias("columns"), "eligible_checks.duplicate_proof",
        F.size("warnings").alias("warnings"),
    )


@query
def column_profile(spark, sf_dir):
    items = _lineitem(spark, sf_dir)
    filled = items.agg(*[F.count(name).alias(name) for name in items.columns])
    counts = filled.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(name).alias("filled")) for name in items.columns
    ])))
    return d.column_profile(items).select("pos", "name").join(counts, "name")


# --- proposed changes -------------------------------------------------------

HIT = "l_suppkey IN (3, 19, 40) AND l_quantity > 45"


@query
def predicate_match(spark, sf_dir):
    return d.predicate_match(_lineitem(spark, sf_dir), HIT)


@query
def blast_radius(spark, sf_dir):
    return d.blast_radius(_lineitem(spark, sf_dir), HIT, PART, F.lit(4096))


@query
def full_rewrite_bound(spark, sf_dir):
    return d.full_rewrite_bound(d.parts_summary(_lineitem(spark, sf_dir), YEAR, PART, F.lit(4096)))


@query
def cast_probe_discount(spark, sf_dir):
    return d.cast_probe(_lineitem(spark, sf_dir), "l_discount", "int")


@query
def cast_probe_quantity(spark, sf_dir):
    return d.cast_probe(_lineitem(spark, sf_dir), "l_quantity", "int")


@query
def cast_probe_decimal(spark, sf_dir):
    return d.cast_probe(_lineitem(spark, sf_dir), "l_extendedprice", "decimal(7,2)")


@query
def cast_probe_varchar(spark, sf_dir):
    return d.cast_probe(table(spark, sf_dir, "documents"), "text", "varchar(500)")


@query
def cast_probe_float(spark, sf_dir):
    return d.cast_probe(_lineitem(spark, sf_dir), "l_extendedprice", "float")


@query
def cast_probe_narrow(spark, sf_dir):
    customer = d.cast_probe(table(spark, sf_dir, "customer"), "c_acctbal", "tinyint")
    part = d.cast_probe(table(spark, sf_dir, "part"), "p_size", "tinyint")
    return customer.withColumn("column", F.lit("c_acctbal")).unionByName(
        part.withColumn("column", F.lit("p_size"))
    )


@query
def cast_probe_text(spark, sf_dir):
    """Text into dates and numbers, some of it broken."""
    orders = table(spark, sf_dir, "orders")
    day = "concat('2024-', lpad(o_orderkey % 14, 2, '0'), '-', lpad(o_custkey % 32, 2, '0'))"
    number = "if(o_orderkey % 9 = 0, NULL, if(o_orderkey % 4 = 0, 'x', cast(o_custkey AS string)))"
    dates = d.cast_probe(orders, day, "date").withColumn("target", F.lit("date"))
    numbers = d.cast_probe(orders, number, "smallint", "o_orderkey % 2 = 0")
    return dates.unionByName(numbers.withColumn("target", F.lit("smallint")))


@query
def cast_probe_timestamp(spark, sf_dir):
    return d.cast_probe(table(spark, sf_dir, "events"), "if(event_id % 3 = 0, date_trunc('DAY', ts), ts)", "date")


@query
def modify_column_probe(spark, sf_dir):
    holes = _lineitem(spark, sf_dir).withColumn(
        "flag", F.when(F.col("l_suppkey") % 10 == 1, None).otherwise(F.col("l_linenumber"))
    )
    probes = [
        d.modify_column_probe(holes, "flag", "tinyint", nullable).withColumn("case", F.lit(case))
        for case, nullable in (("required", False), ("nullable", True))
    ]
    missing = d.modify_column_probe(holes, "absent", "int").withColumn("case", F.lit("missing"))
    nested = d.modify_column_probe(holes, "flag", "array<int>").withColumn("case", F.lit("nested"))
    united = probes[0].unionByName(probes[1]).unionByName(missing).unionByName(nested)
    return united.select("case", "check", "status", "checked_rows", "cast_failures", "null_values")


@query
def update_expr_probe(spark, sf_dir):
    probes = d.update_expr_probe(
        _lineitem(spark, sf_dir),
        {
            "l_linenumber": "bigint(l_linenumber) + 2147483644",
            "l_quantity": "l_quantity * 2",
            "l_suppkey": "l_partkey / 2",
            "l_absent": "1",
            "l_tax": "(SELECT 1)",
        },
        "l_quantity > 25",
    )
    return probes.select("check", "subject", "status", "checked_rows", "cast_failures")


@query
def update_expr_functions(spark, sf_dir):
    """Functions that are named like parts of a query are none; subqueries are, wherever they stand."""
    assignments = {
        "l_quantity": "element_at((map('a', l_quantity)), 'a')",
        "l_tax": "size(map_keys(map('a', l_tax)))",
        "l_discount": "coalesce(reduce(array(l_discount), 0D, (x, y) -> x + y), 0)",
        "l_suppkey": "l_suppkey + (SELECT 1)",
        "l_partkey": "if(exists(VALUES (1)), l_partkey, 0)",
        "l_returnflag": "concat(l_returnflag, '(SELECT 1)')",
        "l_linenumber": "reflect('java.lang.Math', 'abs', l_linenumber)",
    }
    probes = d.update_expr_probe(_lineitem(spark, sf_dir), assignments, "l_linenumber < 4")
    return probes.select("subject", "status", "checked_rows", "cast_failures")


@query
def column_expr_probe(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    good = d.column_expr_probe(events, "get_json_object(props, '$.k')", "int", "materialized", "k")
    bad = d.column_expr_probe(events, "value * 10", "int", "default", "tenfold")
    return good.unionByName(bad).select("check", "subject", "status", "checked_rows", "cast_failures", "null_values")


@query
def change_class(spark, sf_dir):
    return d.change_class(data.change_list(spark, sf_dir)).select(
        "change_id", "classification", "rewrite_scope"
    )


@query
def correctness_status(spark, sf_dir):
    names = F.array(*[F.lit(name) for name in ("ok", "unknown", "warning", "error")])
    level = F.when(F.col("l_quantity") > 49, 4).when(F.col("l_tax") > 0.07, 3).when(F.col("l_discount") > 0.09, 2)
    outcomes = _lineitem(spark, sf_dir).select("l_orderkey", F.element_at(names, F.coalesce(level, F.lit(1))).alias("status"))
    per_order = d.correctness_status(outcomes, ["l_orderkey"])
    return per_order.groupBy("status").agg(F.count("*").alias("orders"))


UPDATE = ChangeSpec(
    "db.lineitem", "update", predicate=HIT,
    assignments={"l_linenumber": "l_linenumber + 1", "l_suppkey": "l_suppkey / 7"},
)
DRY_RUNS = {
    "update": UPDATE,
    "delete": ChangeSpec("db.lineitem", "delete", predicate="l_quantity = 50 AND l_suppkey % 16 < 4"),
    "delete_all": ChangeSpec("db.lineitem", "delete"),
    "subquery": ChangeSpec("db.lineitem", "delete", predicate="l_orderkey IN (SELECT 1)"),
    "modify": ChangeSpec("db.lineitem", "modify_column", "l_discount", "int"),
    "nested": ChangeSpec("db.lineitem", "modify_column", "l_tax", "array<int>"),
    "add": ChangeSpec("db.lineitem", "add_column", "bulk", "smallint", expression="l_partkey * 100", kind="default"),
    "drop": ChangeSpec("db.lineitem", "drop_column", "l_tax"),
    "other": ChangeSpec("db.lineitem", "swap_tables"),
}


def _dry_runs(spark, sf_dir) -> DataFrame:
    items = _lineitem(spark, sf_dir)
    rows = None
    for name, change in DRY_RUNS.items():
        row = d.dry_run_change(items, data.LINEITEM, change, F.lit(4096), on_error="raise").withColumn(
            "change", F.lit(name)
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query
def dry_run_change(spark, sf_dir):
    return _dry_runs(spark, sf_dir).select(
        "change", "classification", "rewrite_scope", "table_rows", "active_parts", "table_bytes",
        "matching_rows", "affected_part_rows", "affected_parts", "affected_bytes", "evidence",
        F.size("correctness").alias("probes"), "correctness_status",
    )


@query
def dry_run_change_errors(spark, sf_dir):
    """The default mode on expressions that fail on the data: the predicate, then one of two probes."""
    broken = "l_quantity / (l_linenumber - 1)"
    changes = {
        "predicate": d.ChangeSpec("db.lineitem", "update", predicate=f"{broken} > 1", assignments={"l_tax": "0.0"}),
        "probe": d.ChangeSpec(
            "db.lineitem", "update", predicate="l_quantity > 10", assignments={"l_tax": broken, "l_discount": "0.0"}
        ),
        "neither": d.ChangeSpec("db.lineitem", "update", predicate="l_quantity > 10", assignments={"l_tax": "0.0"}),
    }
    found = [
        d.dry_run_change(_lineitem(spark, sf_dir), data.LINEITEM, change).select(
            F.lit(name).alias("change"), "table_rows", "matching_rows",
            F.array_join("correctness.status", ",").alias("statuses"), "correctness_status", "evidence",
        )
        for name, change in changes.items()
    ]
    return found[0].union(found[1]).union(found[2])


@query
def migration_finding(spark, sf_dir):
    dry_runs = _dry_runs(spark, sf_dir)
    findings = d.migration_finding(dry_runs, F.col("change"))
    limits = fs.migration_limit(dry_runs, F.col("change"))
    runs = d.to_runs(fs.run_rows(spark, [(name, "migration") for name in DRY_RUNS]), findings, limits)
    return d.report_rows(runs, findings)


# --- pruning ----------------------------------------------------------------


def _stats(spark, sf_dir):
    return d.part_stats(
        _lineitem(spark, sf_dir), ["l_orderkey", "l_suppkey"], YEAR, f"concat({YEAR}, '-', {PART})", F.lit(4096)
    )


@query
def part_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


def _ratios(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    return d.scan_ratios(stats, {
        "both": d.ScanFilter("partition BETWEEN 1996 AND 1997", [Range("l_suppkey", 3, 9)]),
        "key": d.ScanFilter(None, [Range("l_suppkey", None, 2), Range("l_orderkey", 0, None)]),
        "year": d.ScanFilter("partition = 1999"),
        "none": d.ScanFilter(),
    })


@query
def scan_ratio(spark, sf_dir):
    return _ratios(spark, sf_dir)


def _sizes(spark, sf_dir):
    summary = d.parts_summary(_lineitem(spark, sf_dir), YEAR, PART, F.lit(4096))
    return summary.select(F.explode(F.array(F.lit("none"), F.lit("year"))).alias("table"), "rows", "bytes")


@query
def full_scan(spark, sf_dir):
    """Once with a known small size, once with an unknown and thus large one."""
    ratios = _ratios(spark, sf_dir)
    renamed = ratios.filter("table = 'none'").withColumn("table", F.lit("unsized"))
    found = d.full_scan(ratios.unionByName(renamed), _sizes(spark, sf_dir))
    return found.select("table", "code", "severity", "confidence", "evidence")


@query
def missing_partition_pruning(spark, sf_dir):
    return d.missing_partition_pruning(_ratios(spark, sf_dir)).select("table", "code", "severity", "evidence")


@query
def missing_key_pruning(spark, sf_dir):
    return d.missing_key_pruning(_ratios(spark, sf_dir)).select("table", "code", "severity", "evidence")


@query
def layout_hint(spark, sf_dir):
    found = d.missing_partition_pruning(_ratios(spark, sf_dir))
    named = found.withColumn("table", F.when(F.col("table") == "none", "db.lineitem").otherwise(F.col("table")))
    hinted = d.layout_hint(named, layout_table(spark, [data.LINEITEM]))
    return hinted.select("table", "code", F.col("recommendation").contains("year(l_shipdate)").alias("names_layout"))


@query
def no_scan_evidence(spark, sf_dir):
    queries = data.reads(spark, sf_dir).select(F.col("query_id").alias("path"), "table")
    known = d.scan_ratio(_stats(spark, sf_dir), "db.lineitem")
    return d.no_scan_evidence(queries, known).groupBy("table", "code").agg(F.count("*").alias("queries"))


@query
def diagnosis_finding(spark, sf_dir):
    notes = d.scan_findings(_ratios(spark, sf_dir), _sizes(spark, sf_dir))
    return _flat(d.diagnosis_finding(notes, F.col("table")))


# --- workload ---------------------------------------------------------------

AS_OF = "2024-01-31 00:00:00"


def _as_of():
    return F.to_timestamp(F.lit(AS_OF))


@query
def log_filter(spark, sf_dir):
    recent = d.log_filter(data.query_log(spark, sf_dir), _as_of(), 7)
    return recent.groupBy(F.element_at("tables", 1).alias("first_table")).agg(
        F.count("*").alias("queries"), F.sum("read_bytes").alias("read_bytes")
    )


@query
def user_table_filter(spark, sf_dir):
    kept = d.user_table_filter(data.query_log(spark, sf_dir))
    return kept.groupBy(F.array_join("tables", ",").alias("tables")).agg(F.count("*").alias("queries"))


@query
def normalize_query_log(spark, sf_dir):
    return d.with_shape(data.query_log(spark, sf_dir)).groupBy("shape", "hash").agg(F.count("*").alias("runs"))


@query
def normalize_query_texts(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", normalize_query(F.col("text")).alias("shape"))
    return texts.select("doc_id", F.sha2("shape", 256).alias("hash"), F.length("shape").alias("length"))


def _ranked(spark, sf_dir):
    log = d.user_table_filter(d.log_filter(data.query_log(spark, sf_dir), _as_of(), 30))
    return d.rank_workload(d.with_shape(log), 20)


@query
def rank_workload(spark, sf_dir):
    return _ranked(spark, sf_dir).withColumn("tables", F.array_join("tables", ","))


@query
def flag_versioned_tables(spark, sf_dir):
    flagged = d.flag_versioned_tables(_ranked(spark, sf_dir), data.versioned_tables(spark))
    return flagged.select("hash", "runs", F.array_join("replacing_tables", ",").alias("replacing_tables"))


@query
def workload_summary(spark, sf_dir):
    flagged = d.discover_workload(
        data.query_log(spark, sf_dir), data.versioned_tables(spark), _as_of(), 30, limit=None
    )
    return d.workload_summary(flagged)


# --- SQL texts --------------------------------------------------------------


@query
def clean_sql_texts(spark, sf_dir):
    cleaned = data.artifacts(spark, sf_dir).select("path", clean_sql(F.col("sql")).alias("statement"))
    return cleaned.select("path", F.length("statement").alias("length"), F.sha2("statement", 256).alias("hash"))


@query
def mask_literals_texts(spark, sf_dir):
    masked = data.artifacts(spark, sf_dir).select(
        "path", mask_literals(clean_sql(F.col("sql"))).alias("masked")
    )
    return masked.select("path", F.length("masked").alias("length"), F.sha2("masked", 256).alias("hash"))


@query
def fingerprint(spark, sf_dir):
    return d.classify(data.artifacts(spark, sf_dir)).select("path", "fingerprint")


@query
def statement_kind(spark, sf_dir):
    return d.classify(data.artifacts(spark, sf_dir)).select("path", "kind")


@query
def query_shape_flags(spark, sf_dir):
    flags = d.query_shape_flags(d.classify(data.artifacts(spark, sf_dir)))
    return flags.select(
        "path", "has_final", "join_count", "has_cross_join", "has_function_wrapped_predicate",
        "has_leading_wildcard", "selects_all_columns",
    )


@query
def query_advisories(spark, sf_dir):
    flags = d.query_shape_flags(d.classify(data.artifacts(spark, sf_dir)))
    return d.query_advisories(flags).select("path", "code", "severity")


@query
def unstable_flags(spark, sf_dir):
    flags = d.query_shape_flags(d.classify(data.artifacts(spark, sf_dir)))
    return flags.select("path", "unstable_reason")


@query
def reject_reason(spark, sf_dir):
    flags = d.query_shape_flags(d.classify(data.artifacts(spark, sf_dir)))
    return flags.select("path", "reject_reason")


@query
def alter_class(spark, sf_dir):
    return d.alter_classes(d.classify(data.artifacts(spark, sf_dir))).select(
        "path", "classification", "rewrite_scope"
    )


@query
def match_globs(spark, sf_dir):
    return d.match_globs(data.artifacts(spark, sf_dir), ["queries/*.sql", "**/d?5*.md", "mig*/**"]).select("path")


# --- slices -----------------------------------------------------------------

SLICE_YEAR = "1998"


@query
def slice_budget(spark, sf_dir):
    stats = d.partition_stats(_lineitem(spark, sf_dir), YEAR, PART, F.lit(1_000_000))
    cases = [
        d.slice_budget(stats, SLICE_YEAR, stored, max_rows, max_bytes, total).withColumn("case", F.lit(case))
        for case, stored, max_rows, max_bytes, total in (
            ("fits", 0, 10**12, 10**12, 10**12),
            ("rows", 0, 10, 10**12, 10**12),
            ("bytes", 0, 10**12, 10, 10**12),
            ("total", 10**9, 10**12, 10**12, 10**9),
        )
    ]
    united = cases[0]
    for case in cases[1:]:
        united = united.unionByName(case)
    return united.select("case", "rows", "bytes", "allowed")


@query
def choose_partition(spark, sf_dir):
    stats = d.partition_stats(_lineitem(spark, sf_dir), YEAR, PART)
    chosen = d.choose_partition(stats, SLICE_YEAR)
    return stats.filter(F.col("partition").cast("string") == chosen).select("partition", "rows")


@query
def slice_proof(spark, sf_dir):
    """A year against its written copy, and against the copy with the first lines of all orders doubled."""
    items = _lineitem(spark, sf_dir)
    source = d.scope_partition(items, YEAR, int(SLICE_YEAR))
    copy = spark.read.parquet(extract_slice(items, data.LINEITEM, SLICE_YEAR, new_folder(spark, "slice")))
    damaged = copy.union(copy.filter("l_linenumber = 1"))
    return d.slice_proof(source, copy, LINEITEM_KEY).withColumn("case", F.lit("copy")).union(
        d.slice_proof(source, damaged, LINEITEM_KEY).withColumn("case", F.lit("damaged"))
    )


@query
def slice_round_trip(spark, sf_dir):
    """A slice of one shipping year on shared storage: write, prove, list."""
    items = _lineitem(spark, sf_dir)
    spec = d.TableSpec("db.lineitem", tuple(LINEITEM_KEY), partition=YEAR)
    scoped = d.scope_partition(items, YEAR, int(SLICE_YEAR))
    # The size of the year's data is what a slice of it takes: its columns are read, not its files.
    budget = keep(d.slice_budget(d.partition_stats(scoped, YEAR, F.lit("year"), F.lit(0)), SLICE_YEAR))
    root = new_folder(spark, "slices")
    path = f"{root}/slice-{SLICE_YEAR}"
    copy = spark.read.parquet(extract_slice(items, spec, SLICE_YEAR, path))
    proof = d.slice_proof(scoped, copy, LINEITEM_KEY)
    write_manifest(proof, budget, spec, SLICE_YEAR, path, "2024-01-31T00:00:00.000Z", 0)
    return slice_catalog(spark, root).select(
        "state", F.col("source.rows").alias("rows"), F.col("proof.sourceDuplicateRows").alias("duplicates"),
        F.col("proof.matched").alias("matched"),
    )


# --- verdicts ---------------------------------------------------------------


def _suite(spark, sf_dir) -> Verification:
    reads = data.reads(spark, sf_dir)

    def scans():
        queries = reads.select(F.col("query_id").alias("path"), "table")
        ratios = d.scan_ratio(_stats(spark, sf_dir), "db.lineitem")
        sizes = d.parts_summary(_lineitem(spark, sf_dir), YEAR, PART).withColumn("table", F.lit("db.lineitem"))
        return scan_checks(queries, ratios, sizes)

    return d.verify_suite([
        d.Check(artifacts=reads.select(F.col("query_id").alias("artifact"), F.lit("query").alias("type")).distinct()),
        lambda: text_checks(data.artifacts(spark, sf_dir)),
        scans,
        lambda: read_path_checks(reads, data.assumptions(spark), _proofs(spark, sf_dir)),
        lambda: d.change_check(_lineitem(spark, sf_dir), data.LINEITEM, UPDATE, "update"),
    ])


@query
def verify_suite(spark, sf_dir):
    return _suite(spark, sf_dir).findings.groupBy("id", "severity", "blocking").agg(F.count("*").alias("findings"))


@query
def aggregate_verdict(spark, sf_dir):
    suite = _suite(spark, sf_dir)
    return d.aggregate_verdict(suite.findings, suite.limits).groupBy("verdict").agg(F.count("*").alias("artifacts"))


@query
def text_runs(spark, sf_dir):
    suite = d.verify_suite([text_checks(data.artifacts(spark, sf_dir))])
    gate = suite.gate(strict=True)
    return suite.report().join(gate.select("artifact", "type", "failing", "errored").hint("merge"), "artifact")


@query
def report_totals(spark, sf_dir):
    """How many texts fail or are in error, with warnings let pass and not."""
    suite = d.verify_suite([text_checks(data.artifacts(spark, sf_dir))])
    totals = [fs.report_totals(suite.gate(strict)).withColumn("strict", F.lit(strict)) for strict in (False, True)]
    return totals[0].unionByName(totals[1])


@query
def run_log_round_trip(spark, sf_dir):
    """Runs appended twice to a log, read back, and the bytes of its files."""
    path = new_folder(spark, "run-log")
    runs = table(spark, sf_dir, "documents").select(
        F.to_timestamp(F.lit(AS_OF)).alias("finished_at"), F.col("lang").alias("name"), (F.col("doc_id") % 4 == 0).alias("failed"),
        F.col("n_chars").alias("duration_ms"), "text",
    )
    for _ in range(2):
        append_run_log(runs, path)
    counts = read_run_log(spark, path).groupBy("tool", "outcome").agg(F.count("*").alias("runs"), F.sum("durationMs").alias("ms"))
    stored = stored_bytes(spark, path).first()["bytes"] > 0
    return counts.withColumn("stored", F.lit(stored))


@query
def gate_status(spark, sf_dir):
    suite = _suite(spark, sf_dir)
    gates = [
        suite.gate(strict).groupBy("type", "verdict", "failing", "errored")
        .agg(F.count("*").alias("artifacts")).withColumn("strict", F.lit(strict))
        for strict in (False, True)
    ]
    return gates[0].unionByName(gates[1])


@query
def exit_code(spark, sf_dir):
    dedup = _dedup_runs(spark, sf_dir)
    texts = d.verify_suite([text_checks(data.artifacts(spark, sf_dir))])
    pairs = [("dedup", dedup), ("texts", texts)]
    codes = [suite.exit_code().withColumn("suite", F.lit(name)) for name, suite in pairs]
    return codes[0].unionByName(codes[1])


@query
def run_log_entries(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").select(
        F.to_timestamp(F.lit(AS_OF)).alias("finished_at"),
        F.concat(F.lit("check-"), "lang").alias("name"),
        (F.col("doc_id") % 4 == 0).alias("failed"),
        F.col("n_chars").alias("duration_ms"),
        "text",
    )
    return run_log_rows(runs).select("tool", "outcome", "durationMs", F.length("summary").alias("summary_length"))


@query
def display_numbers(spark, sf_dir):
    scaled = F.floor(F.col("o_totalprice") * F.pow(F.lit(10.0), (F.col("o_orderkey") % 9).cast("double")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        format_count(scaled).alias("count_text"),
        format_bytes(scaled.cast("bigint")).alias("bytes_text"),
    )
