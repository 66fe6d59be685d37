"""Reads and collapses from plans, and trust in several keys."""

from __future__ import annotations

import pytest

import dataproof as d
from dataproof.operators.readpath import assumption_lookup, proof_rows


@pytest.fixture
def views(spark):
    spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k STRING, version BIGINT, n INT").createOrReplaceTempView("pr_events")
    spark.createDataFrame([("a", 1)], "k STRING, x INT").createOrReplaceTempView("pr_users")


def found(spark, sql):
    return sorted(((r["table"], tuple(r["collapsed_by"]) if r["collapsed_by"] is not None else None) for r in d.reads_of({"q": spark.sql(sql)}).collect()), key=repr)


RANKED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS rn FROM pr_events)"


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT count(*) FROM pr_events", [("pr_events", None)]),
        (f"{RANKED} WHERE rn = 1", [("pr_events", ("k",))]),
        (f"{RANKED} WHERE n > 3 AND rn <= 1", [("pr_events", ("k",))]),
        (f"{RANKED} WHERE 2 > rn", [("pr_events", ("k",))]),
        (f"{RANKED} WHERE rn = 2", [("pr_events", None)]),
        (f"{RANKED} WHERE rn = 1 OR n > 3", [("pr_events", None)]),
        (f"{RANKED} WHERE rn <= 2", [("pr_events", None)]),
        (f"SELECT sum(n) FROM ({RANKED} WHERE rn = 1)", [("pr_events", ("k",))]),
        ("SELECT k, max_by(n, version) FROM pr_events e GROUP BY k", [("pr_events", ("k",))]),
        ("SELECT k, max_by(n, version), sum(n) FROM pr_events GROUP BY k", [("pr_events", None)]),
        ("SELECT k, max(n) FROM pr_events GROUP BY k", [("pr_events", None)]),
        ("SELECT max_by(n, version) FROM pr_events GROUP BY upper(k)", [("pr_events", None)]),
        ("SELECT DISTINCT * FROM pr_events", [("pr_events", None)]),
        ("SELECT * FROM pr_events JOIN pr_users USING (k)", [("pr_events", None), ("pr_users", None)]),
        (f"SELECT * FROM ({RANKED} WHERE rn = 1) JOIN pr_users USING (k)", [("pr_events", ("k",)), ("pr_users", None)]),
        ("SELECT k, max_by(x, n) FROM pr_events JOIN pr_users USING (k) GROUP BY k", [("pr_events", None), ("pr_users", None)]),
        (f"WITH c AS ({RANKED}) SELECT k FROM c WHERE rn = 1", [("pr_events", ("k",))]),
        (f"WITH c AS ({RANKED} WHERE rn = 1) SELECT a.k FROM c a, pr_events b", [("pr_events", ("k",)), ("pr_events", None)]),
        ("SELECT x FROM pr_users WHERE k IN (SELECT k FROM pr_events)", [("pr_events", None), ("pr_users", None)]),
        ("SELECT (SELECT max(n) FROM pr_events) FROM pr_users", [("pr_events", None), ("pr_users", None)]),
        ("SELECT 1", []),
        ("SELECT k FROM pr_events UNION ALL SELECT k FROM pr_users", [("pr_events", None), ("pr_users", None)]),
    ],
)
def test_reads(spark, views, sql, expected):
    assert found(spark, sql) == sorted(expected, key=repr)


def test_frames(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    df = spark.read.parquet(path)
    got = d.reads_of({"a": df.alias("db.t").dropDuplicates(["id"]), "b": df.alias("db.t").where("id > 1"), "c": df})
    assert [tuple(row) for row in got.orderBy("query_id").collect()] == [("a", "db.t", ["id"]), ("b", "db.t", None)]
    with pytest.raises(ValueError):
        d.reads_of({})
    with pytest.raises(ValueError):
        d.reads_of({"a": object()})


def test_catalog_tables(spark):
    spark.sql("CREATE TEMPORARY VIEW pr_over AS SELECT 1 AS id")
    assert found(spark, "SELECT * FROM pr_over") == []


def test_every_declared_key_counts(spark, rows):
    """A table declared by another key first is still violated by the one it is proven by."""
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "a INT, b INT")
    assumptions = spark.createDataFrame(
        [("db.t", ["a"]), ("db.t", ["b"]), ("db.t", ["`B`"]), ("t", ["c"])], "table STRING, unique_by ARRAY<STRING>"
    )
    reads = spark.createDataFrame([("q", "db.t", None, None), ("r", "db.t", None, ["b"]), ("s", "db.t", True, None)], "query_id STRING, table STRING, uses_final BOOLEAN, collapsed_by ARRAY<STRING>")
    proofs = proof_rows({"db.t": df}, [d.TableSpec("db.t", ("b",))])
    got = sorted((r["query_id"], r["unique_by"][0].strip("`").lower(), r["status"], r["duplicate_rows"]) for r in rows(d.read_path_check(reads, assumptions, proofs)))
    assert got == [("q", "a", "unknown", 0), ("q", "b", "violated", 2), ("r", "a", "unknown", 0)]
    looked_up = assumption_lookup(spark.createDataFrame([("db.t",), ("x.t",), ("y",)], "table STRING"), assumptions)
    assert sorted((r["table"], len(r["unique_by"] or [])) for r in rows(looked_up)) == [("db.t", 1), ("db.t", 1), ("x.t", 1), ("y", 0)]


def test_collapse_by_another_key_trusts_still(spark, rows):
    reads = spark.createDataFrame([("q", "t", ["a", "z"]), ("r", "t", ["A"])], "query_id STRING, table STRING, collapsed_by ARRAY<STRING>")
    assumptions = spark.createDataFrame([("t", ["a", "b"])], "table STRING, unique_by ARRAY<STRING>")
    df = spark.createDataFrame([(1, 1), (1, 1)], "a INT, b INT")
    got = rows(d.read_path_check(reads, assumptions, proof_rows({"t": df}, [d.TableSpec("t", ("a", "b"))])))
    assert [(r["query_id"], r["status"]) for r in got] == [("q", "violated")]
