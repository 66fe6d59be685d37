from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

import dataproof as d
from dataproof.functions.display import format_bytes, format_count
from dataproof.plans import findings as fs
from dataproof.plans.suite import text_checks
from dataproof.sources.slices import stored_bytes


@pytest.fixture
def source(spark):
    rows = [("a", 1, "202606"), ("a", 2, "202606"), ("b", 1, "202606"), ("c", 1, "202607")]
    return spark.createDataFrame(rows, "id STRING, version BIGINT, month STRING")


SPEC = d.TableSpec("db.events", ("id",), partition="month", part="month", generated={"month": ("ALIAS", "x")})


def test_partition_choice(source):
    stats = d.partition_stats(source, "month", "month")
    assert d.choose_partition(stats, "202606") == "202606"
    with pytest.raises(ValueError, match="not found"):
        d.choose_partition(stats, "209901")
    with pytest.raises(ValueError, match="2 partitions; choose one, such as 202606, 202607"):
        d.choose_partition(stats)
    assert d.choose_partition(stats.filter("partition = '202607'")) == "202607"
    with pytest.raises(ValueError, match="no partitions"):
        d.choose_partition(stats.filter("false"))


def test_slice_round_trip(spark, source, one, rows, tmp_path):
    stats = d.partition_stats(source, "month", "month", F.lit(128))
    assert not one(d.slice_budget(stats, "202606", max_rows=2))["allowed"]
    assert not one(d.slice_budget(stats, "202606", max_bytes=100))["allowed"]
    assert not one(d.slice_budget(stats, "202606", stored_bytes=100, max_total_bytes=300))["allowed"]
    budget = d.slice_budget(stats, "202606")
    assert one(budget)["allowed"]
    root = str(tmp_path)
    path = f"{root}/slice-one"
    copy = spark.read.parquet(d.extract_slice(source, SPEC, "202606", path))
    assert copy.columns == ["id", "version"] and copy.count() == 3
    proof = d.slice_proof(d.scope_partition(source, "month", "202606"), copy, ["id"])
    assert one(proof)["matched"] and one(proof)["slice_duplicate_rows"] == 1
    size = one(stored_bytes(spark, path))["bytes"]
    d.write_manifest(proof, budget, SPEC, "202606", path, "2026-06-02T00:00:00.000Z", size)
    with pytest.raises(Exception, match="exist"):
        d.extract_slice(source, SPEC, "202606", path)

    other = d.slice_proof(d.scope_partition(source, "month", "202606"), copy.dropDuplicates(["version"]), ["version"])
    assert not one(other)["matched"]

    (tmp_path / "slice-bad").mkdir()
    (tmp_path / "slice-bad" / "manifest.json").write_text("{not json")
    (tmp_path / "slice-old").mkdir()
    (tmp_path / "slice-old" / "manifest.json").write_text(json.dumps({"version": 2}))
    (tmp_path / "slice-half").mkdir()
    (tmp_path / "slice-half" / "data.bin").write_text("x")
    hand = {
        "version": 1, "createdAt": "2026-06-03T00:00:00.000Z", "engine": "other",
        "source": {"table": "t", "partitionId": "p", "rows": 3, "bytesOnDisk": 128},
        "local": {"table": "t", "createStatement": "", "dataFile": "d", "dataBytes": 1},
        "proof": {"sourceDuplicateRows": 1, "localDuplicateRows": 1, "matched": True},
    }
    (tmp_path / "slice-two").mkdir()
    (tmp_path / "slice-two" / "manifest.json").write_text(json.dumps(hand, indent=2))
    catalog = rows(d.slice_catalog(spark, root))
    states = {row["id"]: row["state"] for row in catalog}
    assert states == {
        "slice-one": "valid", "slice-two": "valid", "slice-bad": "corrupt", "slice-old": "corrupt",
        "slice-half": "incomplete",
    }
    assert [row["id"] for row in catalog if row["state"] == "valid"] == ["slice-two", "slice-one"]
    first = next(row for row in catalog if row["id"] == "slice-one")
    assert first["source"]["rows"] == 3 and first["proof"]["matched"] and first["bytes"] > size


def test_run_log(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    runs = spark.createDataFrame(
        [(datetime.datetime(2024, 1, 2, 3, 4, 5), "verify", True, 7, " head \nrest"),
         (datetime.datetime(2024, 1, 2), "other", False, 8, "x" * 300)],
        "finished_at TIMESTAMP, name STRING, failed BOOLEAN, duration_ms INT, text STRING",
    )
    d.append_run_log(runs.limit(1), path)
    d.append_run_log(runs.offset(1), path)
    logged = sorted(rows(d.read_run_log(spark, path)), key=lambda row: row["durationMs"])
    assert logged[0] == {
        "timestamp": "2024-01-02T03:04:05.000Z", "tool": "verify", "outcome": "error", "durationMs": 7, "summary": "head",
        "text": " head \nrest",
    }
    assert len(logged[1]["summary"]) == 200 and logged[1]["summary"].endswith("...") and logged[1]["text"] == "x" * 300


def finding(artifact, severity, blocking=False, verdict=None, id="x"):
    return (artifact, id, severity, verdict or {"error": "fail", "warn": "warn"}.get(severity, "pass"), blocking)


FINDINGS = "artifact STRING, id STRING, severity STRING, verdict STRING, blocking BOOLEAN"


def test_verdict_order(spark, rows):
    findings = spark.createDataFrame(
        [finding("a", "error", True), finding("a", "warn"), finding("b", "warn"), finding("c", "info"),
         finding("d", "error", False), finding("e", "info", verdict="warn"), finding("f", "error", True)],
        FINDINGS,
    )
    limits = spark.createDataFrame(
        [("b", "budget", ""), ("c", "scope", ""), ("f", "permissions", ""), ("g", "permissions", "")],
        "artifact STRING, type STRING, message STRING",
    )
    verdicts = {row["artifact"]: row["verdict"] for row in rows(d.aggregate_verdict(findings, limits))}
    assert verdicts == {
        "a": "fail", "b": "indeterminate", "c": "pass", "d": "pass", "e": "warn", "f": "fail", "g": "indeterminate",
    }


@pytest.mark.parametrize(
    "runs, strict, code",
    [
        ([("a", "query", "pass")], False, 0), ([("a", "query", "warn")], False, 0), ([("a", "query", "warn")], True, 1),
        ([("a", "migration", "warn")], False, 1), ([("a", "query", "fail")], False, 1),
        ([("a", "query_pair", "indeterminate")], True, 0), ([("a", "unknown", "indeterminate"), ("b", "query", "fail")], False, 2),
        ([], False, 0),
    ],
)
def test_gate(spark, one, runs, strict, code):
    df = spark.createDataFrame(runs, "artifact STRING, type STRING, verdict STRING")
    assert one(d.exit_code(d.gate_status(df, strict)))["exit_code"] == code


def test_verdict_exit_codes(spark, rows):
    df = spark.createDataFrame([("pass",), ("correct",), ("warn",), ("incorrect",), ("indeterminate",)], "v STRING")
    assert [row["c"] for row in rows(df.select(fs.verdict_exit_code(F.col("v")).alias("c")))] == [0, 0, 1, 1, 2]


def test_report(spark, rows, one):
    findings = spark.createDataFrame(
        [finding("a", "warn", id="y"), finding("a", "warn", id="x"), finding("a", "warn", id="x")], FINDINGS
    )
    runs = spark.createDataFrame([("a", "query", "warn"), ("b", "query", "pass")], "artifact STRING, type STRING, verdict STRING")
    report = {row["artifact"]: (row["verdict"], row["finding_ids"]) for row in rows(d.report_rows(runs, findings))}
    assert report == {"a": ("WARN", "x (2), y"), "b": ("PASS", "-")}
    assert one(fs.report_totals(d.gate_status(runs, True))) == {"artifacts": 2, "failed": 1}


def test_runs_of_many_artifacts(spark, rows, tmp_path):
    """Runs and reports give no task all artifacts, however small the stored findings look."""
    kinds = {
        "strategy": F.when(F.col("id") % 2 == 0, "static_parse").otherwise("production_bounded_probe"),
        "severity": F.when(F.col("id") % 10 == 0, "error").otherwise("warn"), "blocking": F.col("id") % 10 == 0,
    }
    named = spark.range(1000).withColumn("artifact", F.concat(F.lit("a"), "id"))
    found = named.filter("id < 600").withColumns(kinds).withColumn("verdict", F.lit("warn")).withColumn("id", F.lit("x"))
    found.write.parquet(f"{tmp_path}/findings")
    findings = spark.read.parquet(f"{tmp_path}/findings")
    limits = named.filter("id >= 500 and id < 700").select("artifact", F.when(F.col("id") % 2 == 0, "budget").otherwise("scope").alias("type"))
    runs = d.to_runs(named.select("artifact", F.when(F.col("id") % 4 < 2, "query").otherwise("migration").alias("type")), findings, limits)
    report = d.report_rows(runs, findings)
    for df in (runs, report):
        assert df.count() == 1000
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    seen = {row["artifact"]: (row["verdict"], row["severity"], row["confidence"]) for row in rows(runs)}
    for i in range(1000):
        query, fails = i % 4 < 2, i % 10 == 0 and i < 600
        verdict = "fail" if fails else "warn" if i < 600 else "pass"
        if 500 <= i < 700:
            verdict = "indeterminate" if not query else "warn" if i % 2 == 0 and verdict == "pass" else verdict
        basis = "explain" if query and i % 2 == 0 else "bounded" if not query and i % 2 else "metadata"
        confidence = "advisory" if verdict == "indeterminate" else basis if i < 600 else "metadata"
        assert seen[f"a{i}"] == (verdict, {"fail": "error", "pass": "none"}.get(verdict, "warn"), confidence), i
    assert {row["artifact"]: row["finding_ids"] for row in rows(report)} == {f"a{i}": "x" if i < 600 else "-" for i in range(1000)}


def test_text_suite(spark, rows, one):
    texts = spark.createDataFrame(
        [("ok.sql", "SELECT a FROM t", None), ("star.sql", "SELECT * FROM t", None), ("two.sql", "SELECT 1; SELECT 2", None),
         ("alter.sql", "ALTER TABLE t FREEZE", None), ("pair.sql", "SELECT now()", "SELECT 1")],
        "path STRING, sql STRING, prev_sql STRING",
    )
    suite = d.verify_suite([text_checks(texts)])
    assert {row["artifact"]: (row["type"], row["verdict"]) for row in rows(suite.runs)} == {
        "ok.sql": ("query", "pass"), "star.sql": ("query", "warn"), "two.sql": ("error", "indeterminate"),
        "alter.sql": ("migration", "indeterminate"), "pair.sql": ("query_pair", "indeterminate"),
    }
    assert one(suite.exit_code())["exit_code"] == 2


def test_equivalence_and_dedup_findings(spark, source, rows):
    result = d.verify_equivalent(source, source.filter("id <> 'c'"))
    found = rows(d.equivalence_finding(result, "p"))
    assert [(f["id"], f["blocking"]) for f in found] == [("query_not_equivalent", True)]
    assert {"label": "leftOnly", "value": "1"} in found[0]["evidence"]
    assert rows(d.equivalence_finding(d.verify_equivalent(source, source), "p")) == []
    crossing = d.duplicate_proof(source.select("version", "month"), ["version"], "month")
    assert {f["id"]: f["severity"] for f in rows(d.dedup_finding(crossing, "t"))} == {
        "dedup_duplicates_present": "error", "dedup_scope_warning": "warn",
    }
    guard = d.scan_guard(d.parts_summary(source, None, "month"), max_rows=1)
    assert [row["type"] for row in rows(fs.dedup_limit(guard, "t"))] == ["budget"]


def test_empty_tables_of_findings(spark):
    assert fs.no_findings(spark).columns[0] == "artifact" and fs.no_limits(spark).count() == 0


@pytest.mark.parametrize(
    "value, text",
    [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KiB"), (10 * 1024, "10.0 KiB"), (1536, "1.50 KiB"), (1 << 30, "1.00 GiB"),
     (5 * (1 << 60), "5120.0 PiB")],
)
def test_bytes(spark, one, value, text):
    df = spark.createDataFrame([(value,)], "v BIGINT")
    assert one(df.select(format_bytes(F.col("v")).alias("t")))["t"] == text


def test_counts(spark, one):
    df = spark.createDataFrame([(184203991,)], "v BIGINT")
    assert one(df.select(format_count(F.col("v")).alias("t")))["t"] == "184,203,991"


def test_checks_make_one_suite(spark, source, rows):
    versioned = d.TableSpec("db.events", ("id",), partition="month", part="month")
    change = d.ChangeSpec("db.events", "modify_column", "version", "string")
    suite = d.verify_suite([
        d.dedup_check(source, versioned),
        d.dedup_check(source, d.TableSpec("db.big", ("id",), part="month"), max_rows=3),
        d.dedup_check(source, d.TableSpec("db.month", ("id",), partition="month"), "202607"),
        d.dedup_check(source, d.TableSpec("db.none")),
        d.equivalence_check(source, source, "same.sql"),
        d.equivalence_check(source, source.limit(1), "limit.sql"),
        d.change_check(source, versioned, change, "change.sql"),
        d.change_check(source, versioned, d.ChangeSpec("db.events", "drop_column", "version"), "drop.sql"),
    ])
    runs = {row["artifact"]: (row["verdict"], row["severity"], row["confidence"]) for row in rows(suite.runs)}
    assert runs == {
        "db.events": ("fail", "error", "exact"), "db.big": ("indeterminate", "warn", "advisory"),
        "db.month": ("pass", "none", "exact"), "db.none": ("indeterminate", "warn", "advisory"),
        "same.sql": ("pass", "none", "exact"), "limit.sql": ("indeterminate", "warn", "advisory"),
        "change.sql": ("warn", "warn", "bounded"), "drop.sql": ("pass", "none", "metadata"),
    }
    assert suite.exit_code().first()["exit_code"] == 1


def test_duplicate_check_shows_keys_and_partitions(spark, rows):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (2, "b", "y"), (2, "b", "y"), (2, "b", "y"), (3, "c", "z")], "id INT, name STRING, part STRING")
    spec = d.TableSpec("db.t", ("id", "name"), partition="part", part="part")
    check = d.dedup_check(df, spec)
    assert [(r["artifact"], r["partition"], r["key"], r["copies"]) for r in rows(check.samples)] == [
        ("db.t", "y", '{"id":2,"name":"b"}', 3), ("db.t", "x", '{"id":1,"name":"a"}', 2),
    ]
    assert check.partitions is None
    assert [r["copies"] for r in rows(d.dedup_check(df, spec, partition="x").samples)] == [2]
    skipped = d.dedup_check(df, spec, max_rows=3)
    assert skipped.findings is None and skipped.samples is None
    assert [(r["partition"], r["rows"]) for r in rows(skipped.partitions)] == [("y", 4), ("x", 2), ("z", 1)]
