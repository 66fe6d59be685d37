from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import dataproof as d
from dataproof.functions.keys import same_key
from dataproof.operators.pruning import layout_table
from dataproof.operators.readpath import proof_rows


@pytest.fixture
def events(spark):
    return spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "event_id STRING, version BIGINT")


SPEC = d.TableSpec("db.events", ("event_id",))


def outcome(spark, df, unique_by, uses_final=False, spec=SPEC, declared="db.events", too_large=()):
    reads = spark.createDataFrame([("q1", "db.events", uses_final)], "query_id STRING, table STRING, uses_final BOOLEAN")
    assumptions = spark.createDataFrame([(declared, unique_by)], "table STRING, unique_by ARRAY<STRING>")
    proofs = proof_rows({"db.events": df}, [spec], too_large)
    return [row.asDict() for row in d.read_path_check(reads, assumptions, proofs).collect()]


def test_violated_and_clean(spark, events):
    found = outcome(spark, events, ["event_id"])
    assert [(row["status"], row["duplicate_rows"]) for row in found] == [("violated", 1)]
    assert [row["status"] for row in outcome(spark, events.dropDuplicates(["event_id"]), ["event_id"])] == ["clean"]


def test_other_key_and_large_table_are_unknown(spark, events):
    assert [row["status"] for row in outcome(spark, events, ["version"])] == ["unknown"]
    assert [row["status"] for row in outcome(spark, events, ["event_id"], too_large=["db.events"])] == ["unknown"]


def test_skipped_reads(spark, events):
    assert outcome(spark, events, ["event_id"], uses_final=True) == []
    assert outcome(spark, events, [], declared="db.events") == []
    assert outcome(spark, events, ["event_id"], declared="db.other") == []
    assert outcome(spark, events, ["event_id"], spec=d.TableSpec("db.events", ("event_id",), versioned=False)) == []


def test_bare_names_are_a_fallback(spark, events):
    assert len(outcome(spark, events, ["`EVENT_ID`"], declared="events")) == 1


def test_read_path_runs(spark, events, rows):
    reads = spark.createDataFrame(
        [("q1", "db.events", False), ("q2", "db.big", False), ("q3", "db.events", True)],
        "query_id STRING, table STRING, uses_final BOOLEAN",
    )
    assumptions = spark.createDataFrame(
        [("db.events", ["event_id"]), ("db.big", ["id"])], "table STRING, unique_by ARRAY<STRING>"
    )
    proofs = proof_rows({"db.events": events}, [SPEC, d.TableSpec("db.big", ("id",))], ["db.big"])
    check = d.plans.suite.read_path_checks(reads, assumptions, proofs)
    artifacts = reads.select(F.col("query_id").alias("artifact"), F.lit("query").alias("type"))
    suite = d.verify_suite([d.Check(artifacts=artifacts), check])
    verdicts = {row["artifact"]: row["verdict"] for row in rows(suite.runs)}
    assert verdicts == {"q1": "fail", "q2": "warn", "q3": "pass"}


@pytest.mark.parametrize(
    "declared, key, bound",
    [
        (["a", "B"], ["`b`", " A"], True), (["a"], ["a", "b"], False), (["a", "a"], ["a"], True),
        (["a", "b"], ["a", "a"], True), (["a"], ["a", ""], True), (["a", "b"], ["a", "c"], False),
    ],
)
def test_key_binding(spark, one, declared, key, bound):
    df = spark.createDataFrame([(declared, key)], "d ARRAY<STRING>, k ARRAY<STRING>")
    assert one(df.select(same_key(F.col("d"), F.col("k")).alias("b")))["b"] is bound


def test_audit(events, rows):
    audit = rows(d.uniqueness_audit({"e": events}, {"e": ["event_id"]}))
    assert audit == [{"table": "e", "unique_by": "event_id", "duplicate_rows": 1, "status": "violated"}]


def test_profile_of_files(spark, events, one, rows, tmp_path):
    path = str(tmp_path / "events")
    events.repartition(1).write.partitionBy("version").parquet(path)
    stored = spark.read.parquet(path)
    summary = one(d.parts_summary(stored, "version"))
    assert (summary["active_parts"], summary["rows"], summary["partitions"]) == (2, 3, 2)
    assert summary["bytes"] > 0
    stats = {row["partition"]: row["rows"] for row in rows(d.partition_stats(stored, "version"))}
    assert stats == {1: 2, 2: 1}
    assert [row["partition"] for row in rows(d.largest_partitions(d.partition_stats(stored, "version"), 1))] == [1]
    profile = one(d.table_profile(stored, SPEC))
    assert profile["rows"] == 3 and profile["eligible_checks"]["duplicate_proof"] and len(profile["warnings"]) == 1
    plan = d.scope_partition(stored, "version", 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan


def test_files_with_several_partitions_count_once(spark, one, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    stored = spark.read.parquet(path)
    summary = one(d.parts_summary(stored, "id % 10"))
    assert (summary["active_parts"], summary["partitions"], summary["rows"]) == (1, 10, 100)
    stats = d.part_stats(stored, ["id"], "id % 10")
    ratio = d.scan_ratio(stats, "t", "partition = 3").filter("level = 'partition'")
    assert (one(ratio)["selected"], one(ratio)["total"], one(ratio)["selected_rows"]) == (1, 1, 100)


def test_columns(events, rows):
    spec = d.TableSpec("t", generated={"version": ("DEFAULT", "1")})
    assert [(r["pos"], r["name"], r["type"], r["default_expr"]) for r in rows(d.column_profile(events, spec))] == [
        (1, "event_id", "string", None), (2, "version", "bigint", "1"),
    ]


def test_catalog_spec(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS spec_events")
    spark.sql(
        "CREATE TABLE spec_events (id BIGINT, v BIGINT, day STRING) USING parquet PARTITIONED BY (day) "
        "CLUSTERED BY (id) SORTED BY (id) INTO 2 BUCKETS "
        f"LOCATION '{tmp_path}/spec' TBLPROPERTIES ('dataproof.version' = 'v')"
    )
    spec = d.catalog_spec(spark, "spec_events")
    spark.sql("DROP TABLE spec_events")
    assert (spec.dedup_key, spec.version, spec.partition) == (("id",), "v", "concat_ws('/', day)")
    with pytest.raises(Exception):
        d.catalog_spec(spark, "no_such_table")


@pytest.fixture
def sorted_events(spark):
    """20,000 rows by month of day, sorted by (tenant, id); a part is a block of one tenant."""
    n = F.col("id")
    return spark.range(20_000).select(
        (n % 10).alias("tenant"), "id",
        F.expr("date_add(date'2026-01-01', cast(id % 60 AS int))").alias("day"),
        F.when(n % 2 == 0, "ok").otherwise("failed").alias("status"),
    )


def diagnose(df, **filters):
    month = "date_format(day, 'yyyyMM')"
    stats = d.part_stats(df, ["tenant", "id"], month, f"concat({month}, '-', tenant)", F.lit(10))
    ratios = d.scan_ratio(stats, "events", **filters)
    sizes = d.parts_summary(df, month, f"concat({month}, '-', tenant)", F.lit(10)).withColumn("table", F.lit("events"))
    return {row["code"]: row["severity"] for row in d.scan_findings(ratios, sizes).collect()}


def test_wrapped_filter_scans_everything(sorted_events):
    found = diagnose(sorted_events)
    assert found == {
        "full-scan": "medium", "missing-partition-pruning": "medium", "missing-primary-key-pruning": "medium",
    }


def test_key_filter_prunes(sorted_events):
    found = diagnose(sorted_events, ranges=[d.Range("tenant", 3, 3), d.Range("id", 43, 43)])
    assert "full-scan" not in found and "missing-primary-key-pruning" not in found


def test_full_scan_severity(spark, rows):
    ratios = spark.createDataFrame(
        [(t, level, False, 4, 4, 40, 40) for t in ("small", "rows", "bytes", "unknown") for level in ("partition", "key")]
        + [("pruned", "partition", True, 4, 4, 40, 40), ("pruned", "key", True, 1, 4, 10, 40)],
        "table STRING, level STRING, has_condition BOOLEAN, selected BIGINT, total BIGINT, selected_rows BIGINT, total_rows BIGINT",
    )
    sizes = spark.createDataFrame(
        [("small", 9_999_999, 10), ("rows", 10_000_000, 10), ("bytes", 5, 1 << 30), ("pruned", 1, 1)],
        "table STRING, rows BIGINT, bytes BIGINT",
    )
    found = {row["table"]: row["severity"] for row in rows(d.full_scan(ratios, sizes))}
    assert found == {"small": "medium", "rows": "high", "bytes": "high", "unknown": "high"}
    blocking = rows(d.diagnosis_finding(d.full_scan(ratios, sizes), F.col("table")))
    assert {f["artifact"] for f in blocking if f["blocking"]} == {"rows", "bytes", "unknown"}
    assert {f["id"] for f in blocking} == {"query_full-scan"} and blocking[0]["title"] == "Full Scan"


def test_layout_hint_without_layout(spark, rows):
    found = spark.createDataFrame(
        [("a", "full-scan"), ("b", "full-scan")], "table STRING, code STRING"
    )
    hinted = d.layout_hint(found, layout_table(spark, [d.TableSpec("a", ("k",), partition="year(t)")]))
    texts = {row["table"]: row["recommendation"] for row in rows(hinted)}
    assert "year(t)" in texts["a"] and "(k)" in texts["a"] and "(" not in texts["b"]


def test_parts_of_nulls_match_no_range(spark, rows):
    df = spark.createDataFrame([(None, "p1"), (5, "p2")], "k INT, p STRING")
    ratio = d.scan_ratio(d.part_stats(df, ["k"], None, "p"), "t", ranges=[d.Range("k", None, None)])
    assert {row["level"]: row["selected"] for row in rows(ratio)} == {"partition": 2, "key": 1}


def test_each_table_is_read_once(spark, sf_dir):
    """Summaries, findings and samples do not scan their table again for each figure."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    stats = d.part_stats(items, ["l_suppkey"], "year(l_shipdate)", "l_suppkey % 16")
    sizes = spark.createDataFrame([("t", 1, 1)], "table STRING, rows BIGINT, bytes BIGINT")
    single = [
        d.parts_summary(items, "year(l_shipdate)"),
        d.scan_findings(d.scan_ratio(stats, "t"), sizes),
        d.duplicate_proof(items, ["l_orderkey"], "year(l_shipdate)"),
        d.dry_run_change(
            items, d.TableSpec("t", ("l_orderkey",)), on_error="raise",
            change=d.ChangeSpec("t", "update", predicate="l_tax > 0", assignments={"l_tax": "l_tax / 3", "l_suppkey": "1.5"}),
        ),
    ]
    for df in single:
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_blast_radius_prunes(spark, tmp_path):
    """The predicate reaches partitions and files; the other scan reads no data column."""
    path = str(tmp_path / "by_year")
    spark.range(100).selectExpr("id", "id % 4 AS y", "id * 2 AS v").write.partitionBy("y").parquet(path)
    plan = d.blast_radius(spark.read.parquet(path), "y = 3 AND v > 50", "y", "1")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2
    assert "isnotnull(y" in scans[0].split("PartitionFilters")[1] and "GreaterThan(v,50)" in scans[0]
    assert "ReadSchema: struct<>" in scans[1]
