from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import dataproof as d
from dataproof.operators.uniqueness import key_copies


@pytest.fixture
def versions(spark):
    return spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "id STRING, version BIGINT")


@pytest.fixture
def partitioned(spark):
    """One duplicate within a partition, two across partitions."""
    data = [("a", 1, 1), ("a", 1, 2), ("b", 1, 1), ("b", 2, 2), ("c", 1, 1), ("c", 2, 2)]
    return spark.createDataFrame(data, "id STRING, p SMALLINT, version BIGINT")


def test_one_duplicate_group(versions, one):
    assert one(d.dup_within_partition(versions, ["id"])) == {
        "duplicate_groups": 1, "duplicate_rows": 1, "max_copies": 2,
    }


def test_scopes_differ(partitioned, one):
    proof = one(d.duplicate_proof(partitioned, ["id"], "p"))
    assert (proof["duplicate_rows"], proof["final_collapsible_rows"], proof["cross_partition_rows"]) == (1, 3, 2)
    assert one(d.dup_global(partitioned, ["id"]))["final_collapsible_rows"] == 3
    crossing = one(d.dup_cross_partition(partitioned, ["id"], "p"))
    assert crossing["cross_partition_rows"] == 2 and crossing["warning"].startswith("2 ")


def test_one_partition_has_one_scope(partitioned, one):
    scoped = d.scope_partition(partitioned, "p", 1)
    proof = one(d.duplicate_proof(scoped, ["id"]))
    assert proof["duplicate_rows"] == proof["final_collapsible_rows"] == 1


def test_empty_table_has_no_duplicates(versions, one):
    proof = one(d.duplicate_proof(versions.filter("false"), ["id"], "version"))
    assert set(proof.values()) == {0}
    assert one(d.dup_within_partition(versions.filter("false"), ["id"]))["max_copies"] == 0


def test_null_keys_are_equal(spark, one):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", None)], "id STRING, n INT")
    assert one(d.dup_global(df, ["id", "n"]))["final_collapsible_rows"] == 1


def test_sample_is_ordered_and_bounded(spark, rows):
    df = spark.range(400).select((F.col("id") % 60).alias("k"))
    sample = rows(d.dup_sample(df, ["k"], limit=58))
    assert len(sample) == 58
    assert [row["k"] for row in sample[:3]] == [0, 1, 2]
    with pytest.raises(ValueError, match="at least one"):
        d.dup_sample(df, ["k"], limit=0)


def test_scan_guard(spark, one):
    stats = spark.createDataFrame([(201_000_000, 10)], "rows BIGINT, bytes BIGINT")
    assert not one(d.scan_guard(stats))["scan_skipped"]
    guarded = one(d.scan_guard(stats, max_rows=200_000_000))
    assert guarded["scan_skipped"] and "201,000,000 rows in 10 B" in guarded["reason"]
    assert not one(d.scan_guard(stats, max_rows=200_000_000, scoped=True))["scan_skipped"]
    assert not one(d.scan_guard(stats, max_rows=0))["scan_skipped"]
    assert one(d.scan_guard(stats, max_rows=0, max_bytes=9))["scan_skipped"]


@pytest.mark.parametrize(
    "spec, eligible",
    [
        (d.TableSpec("t", ("id",)), True),
        (d.TableSpec("t", ("id",), fan_out=True), False),
        (d.TableSpec("t", ("id",), versioned=False), False),
        (d.TableSpec("t"), False),
        (d.TableSpec("t", ("absent",)), False),
    ],
)
def test_eligibility(versions, one, spec, eligible):
    result = one(d.dedup_eligibility(spec, versions))
    assert result["eligible"] is eligible and (result["reason"] is None) is eligible


def test_latest_row_wins_and_deleted_keys_vanish(spark, rows):
    data = [("a", 1, 0), ("a", 3, 1), ("b", 2, 0), ("b", 1, 1), ("c", None, 0)]
    df = spark.createDataFrame(data, "id STRING, version INT, gone INT")
    latest = d.latest_per_key(df, ["id"], "version")
    assert sorted((r["id"], r["version"]) for r in rows(latest.na.fill(-1))) == [("a", 3), ("b", 2), ("c", -1)]
    kept = d.latest_per_key(df, ["id"], "version", "gone")
    assert sorted(r["id"] for r in rows(kept)) == ["b", "c"]


def test_latest_per_key_prunes_before_the_shuffle(versions):
    plan = d.latest_per_key(versions, ["id"], "version")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_hot_key_combines_before_the_shuffle(spark, one):
    """Half of all rows share one key; the counts are right and combined map-side."""
    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    proof = one(d.duplicate_proof(df, ["k"], "id % 3"))
    assert proof["final_collapsible_rows"] == 99_999 and proof["max_copies"] == 33_334
    plan = key_copies(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abc") | st.none(), st.integers(0, 2)), max_size=25))
def test_proof_against_counting(spark, data):
    df = spark.createDataFrame(data, "k STRING, p INT")
    proof = d.duplicate_proof(df, ["k"], "p").first().asDict()
    within, overall = Counter(data), Counter(key for key, _ in data)
    assert proof["total_rows"] == len(data)
    assert proof["duplicate_rows"] == sum(n - 1 for n in within.values())
    assert proof["duplicate_groups"] == sum(n > 1 for n in within.values())
    assert proof["final_collapsible_rows"] == sum(n - 1 for n in overall.values())
    assert proof["max_copies"] == max([n for n in within.values() if n > 1], default=0)
    assert proof["final_collapsible_rows"] >= proof["duplicate_rows"]
    assert d.latest_per_key(df, ["k"], "p").count() == len(overall)
