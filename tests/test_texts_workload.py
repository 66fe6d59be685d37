from __future__ import annotations

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

import dataproof as d
from dataproof.functions.sqltext import (
    clean_sql,
    glob_to_regex,
    mask_literals,
    normalize_query,
    top_level,
)


def apply(spark, function, text):
    df = spark.createDataFrame([(text,)], "t STRING")
    return df.select(function(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("-- head\nSELECT 1;", "SELECT 1"),
        ("SELECT a/* x */FROM t", "SELECT a FROM t"),
        ("SELECT '-- no /* no' -- yes", "SELECT '-- no /* no'"),
        ("SELECT 'it''s -- in', \"a\"\"--\", `b--` FROM t", "SELECT 'it''s -- in', \"a\"\"--\", `b--` FROM t"),
        (r"SELECT 'a\'-- in' -- out", r"SELECT 'a\'-- in'"),
        (r"SELECT `a\` -- out", r"SELECT `a\`"),
        ("SELECT 1 /* open", "SELECT 1"),
        ("SELECT 'open -- in", "SELECT 'open -- in"),
        ("SELECT 2 - 1 / 3;", "SELECT 2 - 1 / 3"),
        ("/* only */ -- that", ""),
        ("SELECT 1;;", "SELECT 1;"),
        ("SELECT '\\", "SELECT '\\"),
    ],
)
def test_clean(spark, raw, clean):
    assert apply(spark, clean_sql, raw) == clean


def test_long_texts_match_without_recursion(spark):
    body = "x''y\\'z-/ " * 60_000
    text = f"SELECT '{body}' /* {'*' * 200_000} */ FROM t -- {'a' * 100_000}"
    assert apply(spark, clean_sql, text) == f"SELECT '{body}'   FROM t"
    assert apply(spark, mask_literals, f"SELECT '{body}'") == "SELECT " + " " * (len(body) + 2)


def test_masks_keep_length(spark):
    text = "SELECT 'a', \"b\"\"c\", `d` FROM t"
    masked = apply(spark, mask_literals, text)
    assert len(masked) == len(text) and masked == "SELECT    ,       ,     FROM t"


def test_top_level(spark):
    assert apply(spark, top_level, "a (b (c) d) e)f(g") == "a (  ( )  ) e)f( "
    deep = "(" * 40 + "LIMIT" + ")" * 40 + " ORDER"
    assert apply(spark, top_level, deep).split() == ["(" * 40, ")" * 40, "ORDER"]


def artifacts(spark, *texts, prev=None):
    rows = [(f"f{n}.sql", text, prev) for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "path STRING, sql STRING, prev_sql STRING")


@pytest.mark.parametrize(
    "text, kind",
    [
        ("select 1", "query"), ("WITH a AS (SELECT 1) SELECT * FROM a", "query"), ("-- c\nALTER TABLE t DROP COLUMN a", "migration"),
        ("SELECTED", "unknown"), ("INSERT INTO t VALUES (1)", "unknown"), ("", "unknown"),
    ],
)
def test_kinds(spark, one, text, kind):
    assert one(d.classify(artifacts(spark, text)))["kind"] == kind


def test_pairs(spark, one):
    pair = one(d.classify(artifacts(spark, "SELECT 2;", prev="SELECT 1 -- old")))
    assert (pair["kind"], pair["previous"]) == ("query_pair", "SELECT 1")
    assert pair["fingerprint"] == hashlib.sha256(b"SELECT 1\n---\nSELECT 2").hexdigest()
    assert one(d.classify(artifacts(spark, "ALTER TABLE t DROP COLUMN a", prev="SELECT 1")))["kind"] == "migration"


@pytest.mark.parametrize(
    "text, reason",
    [
        ("SELECT 1", None), ("SELECT 1;", None), ("SELECT 1; SELECT 2", "several statements"),
        ("SELECT 'a--b'", None), ("SELECT 'a;b'", None), ("WITH a AS (SELECT 1)", "WITH without a top-level SELECT"),
        ("SELECT * FROM t INTO  OUTFILE 'x'", "writes a file"), ("SELECT 'INTO OUTFILE'", None),
        ("SELECT 1 FORMAT JSON", "names an output format"), ("SELECT format(a) FROM t", None),
        ("SELECT 1 SETTINGS max_threads = 2", "changes settings"), ("SELECT settings FROM t", None),
        ("SELECT * FROM url('x')", "calls external function url"), ("SELECT 'url(' FROM t", None),
        ("SELECT * FROM (SELECT * FROM s3 ('x'))", "calls external function s3"),
    ],
)
def test_rejections(spark, one, text, reason):
    assert one(d.query_shape_flags(d.classify(artifacts(spark, text))))["reject_reason"] == reason


@pytest.mark.parametrize(
    "text, reason",
    [
        ("SELECT now()", "now"), ("SELECT randCanonical ( )", "randCanonical"), ("SELECT generateUUIDv4()", "generateUUIDv4"),
        ("SELECT 'rand('", None), ("SELECT brand(a) FROM t", None), ("SELECT a FROM t LIMIT 5", "LIMIT"),
        ("SELECT a FROM t ORDER BY a LIMIT 5", None), ("SELECT * FROM (SELECT a FROM t LIMIT 5)", None),
        ("SELECT (SELECT 1 ORDER BY 1) FROM t LIMIT 5", "LIMIT"), ("SELECT a FROM t SAMPLE 0.1", "sample"),
        ("SELECT 'SAMPLE 1' FROM t", None), ("SELECT sample FROM t", None),
    ],
)
def test_unstable_texts(spark, one, text, reason):
    found = one(d.query_shape_flags(d.classify(artifacts(spark, text))))["unstable_reason"]
    assert (found is None) if reason is None else (reason in found)


def test_advisories(spark, rows):
    text = "SELECT DISTINCT * FROM a FINAL JOIN b JOIN c PREWHERE toDate(t) = 1 AND n LIKE '%x'"
    found = rows(d.query_advisories(d.query_shape_flags(d.classify(artifacts(spark, text)))))
    assert {row["code"]: row["severity"] for row in found} == {
        "final-cost": "medium", "function-wrapped-predicate": "medium", "leading-wildcard": "medium",
        "join-shape": "medium", "select-star": "low",
    }
    assert rows(d.query_advisories(d.query_shape_flags(d.classify(artifacts(spark, "SELECT a FROM b JOIN c"))))) == []


@pytest.mark.parametrize(
    "operation, classification, scope",
    [
        ("ADD COLUMN a INT", "metadata-only", "none"), ("DROP COLUMN a", "metadata-only", "none"),
        ("RENAME COLUMN a TO b", "metadata-only", "none"), ("MODIFY ORDER BY (a, b)", "metadata-only", "none"),
        ("REMOVE TTL", "metadata-only", "none"), ("ADD COLUMN a INT MATERIALIZED b + 1", "risky-materialized-column", "none"),
        ("MODIFY COLUMN a BIGINT", "part-rewriting", "all"), ("MODIFY COLUMN a INT MATERIALIZED b", "risky-materialized-column", "all"),
        ("MATERIALIZE INDEX i", "part-rewriting", "all"), ("MATERIALIZE TTL", "part-rewriting", "all"),
        ("MODIFY TTL d + 1", "part-rewriting", "all"), ("CLEAR COLUMN a", "part-rewriting", "all"),
        ("UPDATE a = 1, b = f(c, d) WHERE e = 2", "part-rewriting", "predicate"),
        ("UPDATE a = 'x' WHERE b = ''", "part-rewriting", "predicate"), ("UPDATE a = 'WHERE x' ", "unsupported", "none"),
        ("DELETE WHERE a IN (1, 2)", "part-rewriting", "predicate"), ("DELETE WHERE  ", "unsupported", "none"),
        ("DELETE IN PARTITION 1 WHERE a = 1", "unsupported", "none"), ("DELETE WHERE a IN (SELECT 1)", "unsupported", "none"),
        ("DELETE WHERE a = 'SELECT'", "part-rewriting", "predicate"), ("DELETE WHERE file('x') = 1", "unsupported", "none"),
        ("DELETE WHERE a = 1 LIMIT 5", "unsupported", "none"), ("UPDATE WHERE a = 1", "unsupported", "none"),
        ("DELETE WHERE a = 1 SETTINGS mutations_sync = 1", "part-rewriting", "predicate"),
        ("DELETE WHERE SETTINGS x = 1", "part-rewriting", "predicate"),
        ("ON CLUSTER c DROP COLUMN a", "unsupported", "none"), ("DROP COLUMN a, DROP COLUMN b", "unsupported", "none"),
        ("FREEZE", "unsupported", "none"), ("DROP COLUMN a; DROP TABLE t", "invalid", "none"),
        ("ADD COLUMN a STRING DEFAULT 'MATERIALIZED'", "metadata-only", "none"),
        ("MODIFY COLUMNS a", "unsupported", "none"),
    ],
)
def test_alter_classes(spark, one, operation, classification, scope):
    found = one(d.alter_classes(d.classify(artifacts(spark, f"ALTER TABLE db.t {operation}"))))
    assert (found["classification"], found["rewrite_scope"]) == (classification, scope), found


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        ("*.sql", "a.sql", True), ("*.sql", "q/a.sql", False), ("**/*.sql", "q/r/a.sql", True), ("**/*.sql", "a.sql", True),
        ("q/**", "q/a/b.txt", True), ("q?.sql", "q1.sql", True), ("q?.sql", "q/.sql", False), ("a+b(1).sql", "a+b(1).sql", True),
    ],
)
def test_globs(spark, glob, path, hit):
    df = spark.createDataFrame([(path,)], "path STRING")
    assert (d.match_globs(df, [glob]).count() == 1) is hit
    assert glob_to_regex(glob).startswith("^")


def test_globs_default_and_backslashes(spark):
    df = spark.createDataFrame([("a.sql",), ("b.txt",), ("q\\c.sql",)], "path STRING")
    assert d.match_globs(df).count() == 2
    assert d.match_globs(df, ["q/*.sql"]).count() == 1


@pytest.mark.parametrize(
    "text, shape",
    [
        ("SELECT a  FROM t1 WHERE b = 'it''s' AND c = 1.5e3", "SELECT a FROM t1 WHERE b = ? AND c = ?"),
        ("SELECT a IN (1, 2,'x')", "SELECT a IN (?..)"), ("SELECT a_1, 7", "SELECT a_1, ?"),
    ],
)
def test_shapes(spark, text, shape):
    assert apply(spark, normalize_query, text) == shape


@pytest.fixture
def log(spark):
    now = datetime.datetime(2024, 1, 10)
    old = datetime.datetime(2024, 1, 1)
    rows = [
        (now, "QueryFinish", "Select", True, "SELECT 1 FROM a.e", 10, 1, ["a.e", "users"]),
        (now, "QueryFinish", "Select", True, "SELECT 2 FROM a.e", 30, 1, ["a.e"]),
        (now, "QueryFinish", "Select", True, "SELECT x FROM system.t", 99, 1, ["system.t", "_table_function.n"]),
        (now, "QueryFinish", "Select", True, "SELECT 1", 99, 1, []),
        (now, "QueryFinish", "Select", False, "SELECT 1 FROM a.e", 99, 1, ["a.e"]),
        (now, "QueryFinish", "Insert", True, "SELECT 1 FROM a.e", 99, 1, ["a.e"]),
        (now, "QueryStart", "Select", True, "SELECT 1 FROM a.e", 99, 1, ["a.e"]),
        (old, "QueryFinish", "Select", True, "SELECT 1 FROM a.e", 99, 1, ["a.e"]),
        (now, "QueryFinish", "Select", True, "SELECT b FROM a.f", 5, 2, ["a.f"]),
    ]
    return spark.createDataFrame(
        rows,
        "event_time TIMESTAMP, type STRING, query_kind STRING, is_initial_query BOOLEAN, query STRING, "
        "read_bytes BIGINT, query_duration_ms BIGINT, tables ARRAY<STRING>",
    )


def test_discovery(spark, log, rows, one):
    versioned = spark.createDataFrame([("a.e",), ("default.users",)], "table STRING")
    as_of = F.lit(datetime.datetime(2024, 1, 11))
    found = rows(d.discover_workload(log, versioned, as_of).orderBy(F.desc("total_read_bytes")))
    assert [(r["sample_query"], r["runs"], r["total_read_bytes"], r["total_duration_ms"]) for r in found] == [
        ("SELECT ? FROM a.e", 2, 40, 2), ("SELECT b FROM a.f", 1, 5, 2),
    ]
    assert found[0]["tables"] == ["a.e", "users"] == found[0]["replacing_tables"] and found[1]["replacing_tables"] == []
    summary = one(d.workload_summary(d.discover_workload(log, versioned, as_of)))
    assert summary == {"shapes": 2, "reads_versioned": 1}
    assert len(rows(d.discover_workload(log, versioned, as_of, limit=1))) == 1
    assert rows(d.discover_workload(log.filter("false"), versioned, as_of)) == []


@pytest.mark.parametrize(
    "text, flag, value",
    [
        ("SELECT a FROM t WHERE note = 'say LIKE \"%'", "has_leading_wildcard", False),
        ("SELECT a FROM t WHERE b NOT LIKE\n\"%x\"", "has_leading_wildcard", True),
        ("SELECT a FROM t WHERE b LIKE 'x%'", "has_leading_wildcard", False),
        ("SELECT a FROM t WHERE b LIKE `%x`", "has_leading_wildcard", False),
        ("select distinct\n* FROM t", "selects_all_columns", True), ("SELECT a * b FROM t", "selects_all_columns", False),
        ("SELECT a FROM joiner JOIN t2 join t3", "join_count", 2), ("SELECT a FROM t JOIN JOIN", "join_count", 2),
        ("SELECT lower(a) FROM t", "has_function_wrapped_predicate", False),
        ("SELECT a FROM t PREWHERE b = 1 AND toDate (c) = 2", "has_function_wrapped_predicate", True),
        ("SELECT a FROM t WHERE my_lower(a) = 1", "has_function_wrapped_predicate", False),
        ("SELECT final_x FROM t", "has_final", False), ("SELECT a FROM t final", "has_final", True),
        ("SELECT a FROM t CROSS\t JOIN u", "has_cross_join", True),
    ],
)
def test_flags(spark, one, text, flag, value):
    assert one(d.query_shape_flags(d.classify(artifacts(spark, text))))[flag] == value


def test_all_reasons_are_listed(spark, one):
    text = "WITH a AS (SELECT 1) INSERT ; SELECT * FROM url('x') INTO OUTFILE 'y' FORMAT JSON"
    found = one(d.query_shape_flags(d.classify(artifacts(spark, text))))["reject_reason"]
    assert found.split("; ") == ["several statements", "calls external function url", "names an output format", "writes a file"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("SELECT 'x'/* c */FROM t", "SELECT 'x' FROM t"), ("SELECT 'x'/* 'a */ /* b' */'y'", "SELECT 'x'   'y'"),
        ("SELECT `a`--'\n, \"b\"", "SELECT `a`\n, \"b\""), ("SELECT 1 /* -- */ + 2", "SELECT 1   + 2"),
        ("SELECT 1 -- /* \n+ 2 */", "SELECT 1 \n+ 2 */"), ("SELECT '/*' , 1 -- '*/", "SELECT '/*' , 1"),
    ],
)
def test_comments_next_to_literals(spark, raw, clean):
    assert apply(spark, clean_sql, raw) == clean
