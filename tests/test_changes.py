from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

import dataproof as d
from dataproof.functions.casts import cast_fails


@pytest.fixture
def versions(spark):
    return spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "id STRING, version BIGINT")


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(
        [(1, "123", "new"), (2, "not-a-number", "new")], "id BIGINT, raw STRING, status STRING"
    )


SPEC = d.TableSpec("db.t", ("id",), part="'p0'")


def test_blast_radius_counts_whole_parts(versions, one):
    touched = one(d.blast_radius(versions, "id = 'a'", "'p0'", F.lit(64)))
    assert touched == {
        "matching_rows": 2, "affected_part_rows": 3, "affected_parts": 1, "affected_bytes": 64,
    }
    untouched = one(d.blast_radius(versions, "id = 'z'", "'p0'", F.lit(64)))
    assert set(untouched.values()) == {0}
    assert one(d.blast_radius(versions, "id = 'a'", "'p0'"))["affected_bytes"] is None


def test_blast_radius_of_files(spark, versions, one, tmp_path):
    versions.coalesce(1).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    touched = one(d.blast_radius(stored, "version = 2"))
    assert (touched["matching_rows"], touched["affected_part_rows"], touched["affected_parts"]) == (1, 3, 1)
    assert touched["affected_bytes"] > 0


def test_type_change_of_text(raw, one):
    finding = one(d.modify_column_probe(raw, "raw", LongType()))
    assert (finding["check"], finding["status"], finding["cast_failures"]) == ("cast-safety", "error", 1)


def test_update_passes(raw, one):
    change = d.ChangeSpec("db.t", "update", predicate="id = 1", assignments={"status": "concat(status, '-done')"})
    result = one(d.dry_run_change(raw, SPEC, change))
    assert result["matching_rows"] == 1 and result["correctness_status"] == "ok"
    assert [(f["check"], f["status"]) for f in result["correctness"]] == [
        ("predicate", "ok"), ("update-expression", "ok"),
    ]


@pytest.mark.parametrize(
    "value, source, target, fails",
    [
        ("1.5D", "double", "int", True), ("2.0D", "double", "int", False), ("300", "int", "tinyint", True),
        ("1.25BD", "decimal(3,2)", "decimal(3,1)", True), ("1.50BD", "decimal(3,2)", "decimal(3,1)", False),
        ("16777217", "int", "float", True), ("'1.5'", "string", "int", True), ("' 12 '", "string", "int", False),
        ("'2024-02-30'", "string", "date", True), ("'2024-02-29'", "string", "date", False),
        ("double('NaN')", "double", "float", False), ("double('Infinity')", "double", "int", True),
        ("9223372036854775807", "bigint", "double", True), ("2", "int", "boolean", True),
        ("2147483647", "int", "float", True), ("2147483647", "int", "double", False),
        ("1152921504606846976", "bigint", "double", False), ("12345", "int", "decimal(4,0)", True),
        ("9223372036854775808D", "double", "bigint", True), ("4611686018427387904D", "double", "bigint", False),
        ("3000000000D", "double", "int", True), ("2147483648", "float", "int", True),
        ("timestamp'2024-01-01 00:00:00'", "timestamp", "date", False),
        ("timestamp'2024-01-01 00:00:01'", "timestamp", "date", True),
        ("12", "int", "string", False), ("NULL", "int", "tinyint", False), ("date'2024-01-01'", "date", "timestamp", False),
    ],
)
def test_exact_casts(spark, one, value, source, target, fails):
    df = spark.sql(f"SELECT CAST({value} AS {source}) AS v")
    result = df.select(F.coalesce(cast_fails(F.col("v"), df.schema["v"].dataType, target), F.lit(False)).alias("f"))
    assert one(result)["f"] is fails


def test_nulls_fail_only_required_targets(spark, one):
    df = spark.createDataFrame([(1,), (None,)], "a INT")
    required, nullable = (one(d.modify_column_probe(df, "a", "bigint", n)) for n in (False, True))
    assert required["status"] == "error" and "1 NULL" in required["message"]
    assert nullable["status"] == "ok" and nullable["null_values"] == 1


def test_unprobeable_and_missing(raw, one):
    assert one(d.modify_column_probe(raw, "raw", "array<int>"))["status"] == "unknown"
    assert one(d.modify_column_probe(raw, "absent", "int"))["status"] == "error"
    with pytest.raises(ValueError):
        d.cast_probe(raw, "raw", "map<string,int>")


@pytest.mark.parametrize(
    "expression, safe",
    [
        ("lower(status)", True), ("(SELECT 1)", False), ("url('http://x')", False), ("reflect('a', 'b')", False),
        ("concat(status, 'select url(')", True), ("my_url(status)", True), ("'it''s (select 1)'", True),
        ("element_at((map('a',1)),'a')", True), ("size(map_keys(map('a',1)))", True), ("coalesce(reduce(a, 0, (x,y)->x+y), 0)", True),
        ("transform(a, x -> REFLECT('b', x))", False), ("EXISTS (SELECT 1)", False), ("a + (FROM t SELECT max(b))", False),
        ("identifier('reflect')('a')", False), ("a +", False), ("`url(x)` + 1", True), ("db.url(a)", False),
    ],
)
def test_safe_expressions(expression, safe):
    assert (d.safe_expression(expression) is None) is safe


def test_failing_expression_becomes_a_finding(raw, one):
    change = d.ChangeSpec(
        "db.t", "update", predicate="id > 0",
        assignments={"id": "id", "status": "raise_error('boom')", "raw": "no_such_column"},
    )
    result = one(d.dry_run_change(raw, SPEC, change))
    statuses = [finding["status"] for finding in result["correctness"]]
    assert statuses == ["ok", "ok", "error", "error"] and "boom" in result["correctness"][2]["message"]
    with pytest.raises(Exception):
        d.dry_run_change(raw, SPEC, change, on_error="raise").collect()


def test_expressions_outside_the_predicate_do_not_run(raw, one):
    change = d.ChangeSpec("db.t", "update", predicate="id = 1", assignments={"id": "cast(raw AS bigint)"})
    result = one(d.dry_run_change(raw, SPEC, change, on_error="raise"))
    assert result["correctness_status"] == "ok" and result["correctness"][1]["checked_rows"] == 1


@pytest.mark.parametrize(
    "change, classification, scope, status",
    [
        (d.ChangeSpec("t", "add_column"), "metadata-only", "none", "ok"),
        (d.ChangeSpec("t", "delete", predicate="id = 1"), "part-rewriting", "predicate", "ok"),
        (d.ChangeSpec("t", "delete", predicate=" "), "unsupported", "none", "ok"),
        (d.ChangeSpec("t", "delete", predicate="id IN (SELECT 1)"), "unsupported", "none", "ok"),
        (d.ChangeSpec("t", "update", predicate="id = 1"), "unsupported", "none", "ok"),
        (d.ChangeSpec("t", "modify_column", "raw", "bigint"), "part-rewriting", "all", "error"),
        (d.ChangeSpec("t", "modify_column", "raw", "bigint", kind="materialized", expression="id"),
         "risky-materialized-column", "all", "ok"),
        (d.ChangeSpec("t", "add_column", "n", "tinyint", kind="default", expression="id * 100"),
         "metadata-only", "none", "error"),
        (d.ChangeSpec("t", "materialize_column", "raw"), "risky-materialized-column", "all", "ok"),
        (d.ChangeSpec("t", "vacuum"), "unsupported", "none", "ok"),
    ],
)
def test_dry_runs(raw, one, change, classification, scope, status):
    result = one(d.dry_run_change(raw, SPEC, change, F.lit(10)))
    assert (result["classification"], result["rewrite_scope"]) == (classification, scope)
    assert result["correctness_status"] == status
    assert result["affected_parts"] == (0 if scope == "none" else 1)


def test_dry_run_findings(raw, rows):
    change = d.ChangeSpec("t", "modify_column", "raw", "array<int>")
    findings = rows(d.migration_finding(d.dry_run_change(raw, SPEC, change), "m.sql"))
    assert [(f["id"], f["severity"], f["verdict"]) for f in findings] == [
        ("migration_cast-safety", "warn", "pass"), ("migration_rewrite_footprint", "warn", "warn"),
    ]


def test_change_rules_agree(spark, rows):
    changes = spark.createDataFrame(
        [("modify_column", "materialized"), ("update", None), ("nothing", None), ("remove_ttl", "default")],
        "op STRING, kind STRING",
    )
    found = {row["op"]: (row["classification"], row["rewrite_scope"]) for row in rows(d.change_class(changes))}
    assert found == {
        "modify_column": ("risky-materialized-column", "all"), "update": ("part-rewriting", "predicate"),
        "nothing": ("unsupported", "none"), "remove_ttl": ("metadata-only", "none"),
    }


def test_worst_status(spark, one):
    findings = spark.createDataFrame([("ok",), ("unknown",), ("warning",)], "status STRING")
    assert one(d.correctness_status(findings))["status"] == "warning"
    assert one(d.correctness_status(findings.filter("false")))["status"] == "ok"


def test_no_rewrite(spark, one):
    assert one(d.no_rewrite(spark))["evidence"] == "none"


def test_bounded_strings(spark, one):
    df = spark.createDataFrame([("abcd", 123456), ("ab", 1), (None, None)], "t string, n int")
    for target in ("varchar(3)", "char(3)"):
        for column in ("t", "n"):
            assert one(d.cast_probe(df, column, target))["cast_failures"] == 1


def test_subqueries_are_no_probes():
    for text in ("a IN (TABLE t)", "a IN (FROM t)", "EXISTS(TABLE t)", "a IN (VALUES 1)", "(WITH x AS (SELECT 1) SELECT 1)"):
        assert d.safe_expression(text) is not None
    assert d.safe_expression("a IN (1, 2) AND b = '(TABLE t)'") is None


def test_foreign_failures_are_raised(spark):
    """A cancelled job is not the data's fault."""
    df = spark.range(5).toDF("id")
    change = d.ChangeSpec("t", "update", predicate="id > 1", assignments={"id": "id + 1"})
    from pyspark.errors import PySparkException

    from dataproof.operators import changes

    class Lost(PySparkException):
        pass

    def lost(*_):
        raise Lost("executor lost")

    kept, changes._evaluated = changes._evaluated, lost
    try:
        with pytest.raises(PySparkException, match="lost"):
            d.dry_run_change(df, d.TableSpec("t", ("id",), part="1"), change)
    finally:
        changes._evaluated = kept


def test_dry_run_prunes(spark, one, tmp_path):
    """The predicate reaches partitions and files, and what rewrites and probes nothing reads no data."""
    path = str(tmp_path / "t")
    spark.range(90).selectExpr("id", "id % 7 AS v", "cast(id % 3 AS int) AS y").repartition(1).write.partitionBy("y").parquet(path)
    df, spec = spark.read.parquet(path), d.TableSpec("t", ("id",))
    change = d.ChangeSpec("t", "update", predicate="y = 1 AND v > 4", assignments={"v": "v + 1"})
    lazy = d.dry_run_change(df, spec, change, on_error="raise")
    plan = lazy._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) == 1 and "isnotnull(y" in scans[0] and "GreaterThan(v,4)" in scans[0]
    row = one(d.dry_run_change(df, spec, change))
    hits = sum(1 for i in range(90) if i % 3 == 1 and i % 7 > 4)
    assert (row["table_rows"], row["active_parts"], row["matching_rows"], row["affected_part_rows"], row["affected_parts"]) == (90, 3, hits, 30, 1)
    assert [f["checked_rows"] for f in row["correctness"]] == [hits, hits] and 0 < row["affected_bytes"] < row["table_bytes"]
    idle = d.dry_run_change(df, spec, d.ChangeSpec("t", "add_column", "n", "int"), on_error="raise")
    assert "FileScan" not in idle._jdf.queryExecution().executedPlan().toString()
    assert one(idle)["table_rows"] == 90 and one(idle)["matching_rows"] == 0
    blast = d.blast_radius(df, "y = 1 AND v > 4")
    assert blast._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert one(blast)["affected_part_rows"] == 30
