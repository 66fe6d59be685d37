"""The results of the registered queries, stated in SQL over the same tables."""

from __future__ import annotations

import re

ORACLES: dict[str, str] = {}

KEY = "l_orderkey, l_linenumber"
YEAR = "year(l_shipdate)"
MONTH = "strftime(l_shipdate, '%Y%m')"
PART = "l_suppkey % 16"


def _within(partition: str, rows: str = "lineitem", key: str = KEY) -> str:
    return f"""
    SELECT count(*) AS duplicate_groups, coalesce(sum(copies - 1), 0)::BIGINT AS duplicate_rows,
           coalesce(max(copies), 0) AS max_copies
    FROM (SELECT count(*) AS copies FROM {rows} GROUP BY {partition}, {key} HAVING count(*) > 1)"""


def _global(rows: str = "lineitem", key: str = KEY) -> str:
    return f"""
    SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {rows})) AS final_collapsible_rows
    FROM {rows}"""


def _proof(partition: str, rows: str = "lineitem", key: str = KEY) -> str:
    return f"""
    SELECT (SELECT count(*) FROM {rows}) AS total_rows, duplicate_groups, duplicate_rows,
           final_collapsible_rows, final_collapsible_rows - duplicate_rows AS cross_partition_rows, max_copies
    FROM ({_within(partition, rows, key)}), ({_global(rows, key)})"""


ORACLES["duplicate_proof"] = _proof(YEAR)
ORACLES["duplicate_proof_texts"] = _proof("lang", "documents", "text")
ORACLES["dup_within_partition_year"] = _within(YEAR)
ORACLES["dup_within_partition_month"] = _within(MONTH)
ORACLES["dup_global"] = _global()
ORACLES["dup_cross_partition"] = f"""
    SELECT cross_partition_rows,
           CASE WHEN cross_partition_rows <> 0 THEN format('{{:,}}', cross_partition_rows)
             || ' duplicate row(s) lie in different partitions; compaction within partitions keeps them.'
           END AS warning
    FROM ({_proof(MONTH)})"""
ORACLES["dup_sample"] = f"""
    SELECT {YEAR} AS partition, {KEY}, count(*) AS copies FROM lineitem
    GROUP BY ALL HAVING count(*) > 1 ORDER BY copies DESC, partition, {KEY} LIMIT 5"""
ORACLES["scope_partition"] = _proof("true", "(FROM lineitem WHERE year(l_shipdate) = 1996)")
ORACLES["scan_guard"] = f"""
    WITH t AS (SELECT count(*) AS n, count(DISTINCT {PART}) * 1000000 AS size FROM lineitem), s AS (
      SELECT * FROM (VALUES ('default', 200000000, 50000000000, false), ('rows', 1000, 0, false),
        ('bytes', 0, 1000, false), ('scoped', 1000, 1000, true), ('off', 0, 0, false)
      ) v("case", max_rows, max_bytes, scoped)),
    g AS (
      SELECT "case", n, size, ((max_rows > 0 AND n > max_rows) OR (max_bytes > 0 AND size > max_bytes))
        AND NOT scoped AS scan_skipped FROM s, t)
    SELECT "case", scan_skipped, CASE WHEN scan_skipped THEN 'The table has ' || format('{{:,}}', n) || ' rows in '
      || CASE WHEN size >= 10485760 THEN printf('%.1f', size / 1048576) ELSE printf('%.2f', size / 1048576) END
      || ' MiB, above the budget for a whole-table proof; name one partition or raise the budget.'
      END AS reason FROM g"""
ORACLES["largest_partitions"] = f"""
    SELECT {MONTH} AS partition, count(*) AS rows, count(DISTINCT {PART}) * 1000 AS bytes
    FROM lineitem GROUP BY 1 ORDER BY rows DESC, partition LIMIT 10"""
_LATEST = f"""
    SELECT * EXCLUDE (rank) FROM (
      SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY l_shipdate DESC, l_partkey DESC,
        l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC,
        l_returnflag DESC, l_linestatus DESC) AS rank
      FROM lineitem) WHERE rank = 1"""
ORACLES["latest_per_key"] = _LATEST
ORACLES["latest_per_key_deleted"] = f"""
    SELECT l_linenumber, count(*) AS rows, sum(l_partkey)::BIGINT AS sum_partkey, 0::BIGINT AS gone
    FROM ({_LATEST}) WHERE l_returnflag <> 'R' GROUP BY 1"""
_LINE_PROOF = _proof(YEAR)
ORACLES["dedup_finding"] = f"""
    WITH p AS ({_LINE_PROOF})
    SELECT 'db.lineitem' AS artifact, 'dedup_duplicates_present' AS id, 'error' AS severity, 'fail' AS verdict,
      'correctness' AS category, 'exact' AS evidence_level, 'production_exact' AS strategy, true AS blocking,
      'duplicateGroups=' || duplicate_groups || ';duplicateRows=' || duplicate_rows || ';finalCollapsibleRows='
      || final_collapsible_rows || ';maxCopies=' || max_copies AS evidence FROM p WHERE duplicate_rows > 0
    UNION ALL
    SELECT 'db.lineitem', 'dedup_scope_warning', 'warn', 'warn', 'correctness', 'exact', 'production_exact',
      false, 'duplicateRows=' || duplicate_rows || ';finalCollapsibleRows=' || final_collapsible_rows
    FROM p WHERE cross_partition_rows <> 0"""
ORACLES["dedup_eligibility"] = f"""
    WITH p AS ({_LINE_PROOF})
    SELECT 'db.lineitem' AS artifact, 'table_assumption' AS type,
      CASE WHEN duplicate_rows > 0 THEN 'fail' WHEN cross_partition_rows <> 0 THEN 'warn' ELSE 'pass' END AS verdict,
      CASE WHEN duplicate_rows > 0 THEN 'error' WHEN cross_partition_rows <> 0 THEN 'warn' ELSE 'none' END AS severity,
      'exact' AS confidence
    FROM p
    UNION ALL SELECT 'db.' || name, 'table_assumption', verdict, severity,
      CASE verdict WHEN 'indeterminate' THEN 'advisory' ELSE 'exact' END FROM (VALUES
      ('orders', 'pass', 'none'), ('events', 'pass', 'none'), ('customer', 'indeterminate', 'warn'),
      ('part', 'indeterminate', 'warn'), ('nation', 'indeterminate', 'warn')) v(name, verdict, severity)"""


def _counts(left: str, right: str) -> str:
    return f"""
    SELECT left_only, right_only, left_only + right_only AS differing_rows FROM
      (SELECT count(*) AS left_only FROM (({left}) EXCEPT ALL ({right}))),
      (SELECT count(*) AS right_only FROM (({right}) EXCEPT ALL ({left})))"""


_NARROW = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem"
ORACLES["diff_counts"] = _counts(_NARROW, _NARROW + " WHERE l_quantity > 1")
ORACLES["diff_counts_wide"] = _counts(
    "SELECT * FROM lineitem",
    "SELECT * REPLACE (CASE WHEN l_suppkey % 50 = 7 THEN NULL ELSE l_returnflag END AS l_returnflag) "
    "FROM lineitem WHERE l_linenumber < 7",
)
ORACLES["diff_counts_texts"] = _counts(
    "SELECT text, lang FROM documents", "SELECT DISTINCT text, lang FROM documents"
)
_MORE = (
    f"({_NARROW} WHERE l_quantity > 1 UNION ALL "
    f"{_NARROW} WHERE l_quantity > 1 AND l_linenumber = 2)"
)
ORACLES["diff_sample"] = f"""
    (SELECT 'left' AS _side, * FROM (({_NARROW}) EXCEPT ALL {_MORE}) ORDER BY ALL LIMIT 10)
    UNION ALL
    (SELECT 'right' AS _side, * FROM ({_MORE} EXCEPT ALL ({_NARROW})) ORDER BY ALL LIMIT 10)"""
ORACLES["verify_equivalent"] = """
    SELECT pair, verdict, CASE WHEN pair = 'rows' THEN n ELSE 0 END AS left_only, 0 AS right_only,
      CASE WHEN pair = 'rows' THEN n ELSE 0 END AS differing_rows, renamed, shape_mismatch, explained
    FROM (VALUES ('rewrite', 'correct', false, false, false), ('renamed', 'incorrect', true, false, false),
      ('shape', 'incorrect', false, true, false), ('columns', 'incorrect', false, true, false),
      ('rows', 'incorrect', false, false, false), ('unstable', 'indeterminate', false, false, true),
      ('random', 'indeterminate', false, false, true)) v(pair, verdict, renamed, shape_mismatch, explained),
      (SELECT count(*) AS n FROM lineitem WHERE l_linenumber = 3)"""
ORACLES["verify_equivalent_rounded"] = """
    WITH value AS (SELECT l_returnflag AS flag, l_suppkey AS s, l_extendedprice * (1 - l_discount) AS v FROM lineitem),
    direct AS (SELECT flag, round(sum(v), 2) AS r FROM value GROUP BY 1),
    staged AS (SELECT flag, round(sum(v), 2) AS r FROM (SELECT flag, s, sum(v) AS v FROM value GROUP BY 1, 2) GROUP BY 1),
    counted AS (
      SELECT (SELECT count(*) FROM (FROM direct EXCEPT ALL FROM staged)) AS a,
        (SELECT count(*) FROM (FROM staged EXCEPT ALL FROM direct)) AS b)
    SELECT CASE WHEN a + b = 0 THEN 'correct' ELSE 'incorrect' END AS verdict, a AS left_only, b AS right_only,
      a + b AS differing_rows, false AS renamed, false AS shape_mismatch FROM counted"""
ORACLES["compare_shape"] = """
    SELECT pos, left_name, right_name, type_match, name_match, right_values FROM (VALUES
      (1, 'l_orderkey', 'l_orderkey', true, true), (2, 'l_linenumber', 'l_linenumber', true, true),
      (3, NULL, 'l_tax', false, false)) v(pos, left_name, right_name, type_match, name_match)
    JOIN (UNPIVOT (SELECT count(l_orderkey) AS l_orderkey, count(l_linenumber) AS l_linenumber,
      count(l_tax) AS l_tax FROM lineitem) ON COLUMNS(*) INTO NAME right_name VALUE right_values) USING (right_name)"""
# Which of the pairs differ follows from the data; the others are settled by shape, names and plans.
ORACLES["equivalence_finding"] = """
    WITH joined AS (
      SELECT o_orderpriority, count(*) AS items, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
    ), early AS (
      SELECT o_orderpriority, sum(items)::BIGINT AS items, sum(quantity)::BIGINT AS quantity
      FROM (SELECT l_orderkey, count(*) AS items, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
    ), facts AS (
      SELECT (SELECT count(*) FROM lineitem WHERE l_linenumber = 3) AS gone,
        (SELECT count(*) FROM (FROM joined EXCEPT ALL FROM early)) + (SELECT count(*) FROM (FROM early EXCEPT ALL FROM joined)) AS changed
    )
    SELECT artifact,
      CASE WHEN artifact = 'rows' AND gone = 0 THEN 'PASS' WHEN artifact = 'rewrite' AND changed > 0 THEN 'FAIL' ELSE verdict END AS verdict,
      CASE WHEN artifact = 'rows' AND gone = 0 THEN '-' WHEN artifact = 'rewrite' AND changed > 0 THEN 'query_not_equivalent' ELSE finding_ids END AS finding_ids
    FROM facts, (VALUES ('rewrite', 'PASS', '-'), ('renamed', 'FAIL', 'query_column_names_changed'), ('shape', 'FAIL', 'query_shape_mismatch'),
      ('columns', 'FAIL', 'query_shape_mismatch'), ('rows', 'FAIL', 'query_not_equivalent'),
      ('unstable', 'INDETERMINATE', '-'), ('random', 'INDETERMINATE', '-')) v(artifact, verdict, finding_ids)"""

_READS = """
    SELECT 'q' || event_id AS query_id, event_id % 6 = 0 AS uses_final,
      ['db.lineitem', 'db.orders', 'other.events', 'db.customer', 'db.part'][(user_id % 5 + 1)::INT] AS "table"
    FROM events"""
_OUTCOMES = f"""
    SELECT query_id, "table", CASE WHEN "table" = 'db.orders' THEN 'unknown'
        WHEN "table" = 'db.lineitem' AND n > 0 THEN 'violated' ELSE 'clean' END AS status,
      CASE WHEN "table" = 'db.lineitem' THEN n ELSE 0 END AS duplicate_rows
    FROM ({_READS}), (SELECT final_collapsible_rows AS n FROM ({_global()}))
    WHERE NOT uses_final AND "table" IN ('db.lineitem', 'db.orders', 'other.events')"""
ORACLES["read_path_check"] = _OUTCOMES
ORACLES["read_path_finding"] = f"""
    SELECT CASE status WHEN 'violated' THEN 'fail' ELSE 'indeterminate' END AS verdict, count(*) AS queries
    FROM ({_OUTCOMES}) WHERE status <> 'clean' GROUP BY 1"""
ORACLES["assumption_lookup_reads"] = f"""
    SELECT "table", count(*) AS reads, count(*) FILTER ("table" <> 'db.part') AS declared
    FROM ({_READS}) GROUP BY 1"""
ORACLES["key_binding"] = "SELECT event_id, event_id % 3 = 0 AS bound FROM events"
ORACLES["uniqueness_audit"] = f"""
    SELECT "table", unique_by, n AS duplicate_rows, CASE WHEN n > 0 THEN 'violated' ELSE 'clean' END AS status FROM (
      SELECT 'lineitem' AS "table", '{KEY}' AS unique_by, final_collapsible_rows AS n FROM ({_global()})
      UNION ALL SELECT 'orders', 'o_orderkey', * FROM ({_global('orders', 'o_orderkey')})
      UNION ALL SELECT 'events', 'event_id', * FROM ({_global('events', 'event_id')})
      UNION ALL SELECT 'documents', 'text', * FROM ({_global('documents', 'text')}))"""

_TOTALS = f"""
    SELECT count(DISTINCT {PART}) AS active_parts, count(*) AS rows, count(DISTINCT {PART}) * 4096 AS bytes,
      count(DISTINCT {YEAR}) AS partitions FROM lineitem"""
ORACLES["parts_summary"] = _TOTALS
ORACLES["partition_stats"] = f"""
    SELECT {MONTH} AS partition, count(*) AS rows, count(DISTINCT {PART}) * 4096 AS bytes
    FROM lineitem GROUP BY 1"""
ORACLES["table_profile"] = f"""
    SELECT 'db.lineitem' AS "table", '{KEY}' AS sort_key, 'year(l_shipdate)' AS partition_by,
      'l_shipdate' AS version_column, true AS is_versioned, rows, active_parts, partitions, 11 AS columns,
      true AS duplicate_proof, 1 AS warnings FROM ({_TOTALS})"""
ORACLES["column_profile"] = """
    SELECT c.ordinal_position AS pos, name, filled FROM
      (UNPIVOT (SELECT count(COLUMNS(*)) FROM lineitem) ON COLUMNS(*) INTO NAME name VALUE filled)
    JOIN (SELECT column_name, row_number() OVER () AS ordinal_position FROM (DESCRIBE lineitem)) c
      ON c.column_name = name"""

HIT = "l_suppkey IN (3, 19, 40) AND l_quantity > 45"


def _touched(predicate: str) -> str:
    return f"""
    SELECT coalesce(sum(hits), 0)::BIGINT AS matching_rows, coalesce(sum(n), 0)::BIGINT AS affected_part_rows,
      count(*) AS affected_parts, count(*) * 4096 AS affected_bytes
    FROM (SELECT count(*) AS n, count(*) FILTER ({predicate}) AS hits FROM lineitem GROUP BY {PART})
    WHERE hits > 0"""


ORACLES["predicate_match"] = f"SELECT count(*) AS matching_rows FROM lineitem WHERE {HIT}"
ORACLES["blast_radius"] = _touched(HIT)
ORACLES["full_rewrite_bound"] = f"""
    SELECT rows AS matching_rows, rows AS affected_part_rows, active_parts AS affected_parts,
      bytes AS affected_bytes, 'table-metadata-upper-bound' AS evidence FROM ({_TOTALS})"""


def _failed(value: str, source: str, target: str) -> str:
    return (
        f"({value}) IS NOT NULL AND (try_cast(({value}) AS {target}) IS NULL "
        f"OR try_cast(try_cast(({value}) AS {target}) AS {source}) IS DISTINCT FROM ({value}))"
    )


def _cast(rows: str, value: str, source: str, target: str) -> str:
    return f"""
    SELECT count(*) AS checked_rows, count(*) FILTER ({_failed(value, source, target)}) AS cast_failures,
      count(*) FILTER (({value}) IS NULL) AS null_values FROM {rows}"""


ORACLES["cast_probe_discount"] = _cast("lineitem", "l_discount", "DOUBLE", "INT")
ORACLES["cast_probe_quantity"] = _cast("lineitem", "l_quantity", "DOUBLE", "INT")
ORACLES["cast_probe_decimal"] = _cast("lineitem", "l_extendedprice", "DOUBLE", "DECIMAL(7,2)")
ORACLES["cast_probe_float"] = _cast("lineitem", "l_extendedprice", "DOUBLE", "FLOAT")
ORACLES["cast_probe_narrow"] = f"""
    SELECT 'c_acctbal' AS "column", * FROM ({_cast('customer', 'c_acctbal', 'DOUBLE', 'TINYINT')})
    UNION ALL SELECT 'p_size', * FROM ({_cast('part', 'p_size', 'INT', 'TINYINT')})"""
ORACLES["cast_probe_text"] = """
    SELECT 'date' AS target, count(*) AS checked_rows, count(*) FILTER (try_cast(
      '2024-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-' || lpad((o_custkey % 32)::VARCHAR, 2, '0') AS DATE)
      IS NULL) AS cast_failures, 0 AS null_values FROM orders
    UNION ALL
    SELECT 'smallint', count(*), count(*) FILTER (o_orderkey % 9 <> 0 AND (o_orderkey % 4 = 0 OR o_custkey > 32767)),
      count(*) FILTER (o_orderkey % 9 = 0) FROM orders WHERE o_orderkey % 2 = 0"""
ORACLES["cast_probe_timestamp"] = """
    SELECT count(*) AS checked_rows, count(*) FILTER (event_id % 3 <> 0 AND ts <> date_trunc('day', ts)) AS cast_failures,
      0 AS null_values FROM events"""
ORACLES["modify_column_probe"] = """
    WITH n AS (SELECT count(*) AS n, count(*) FILTER (l_suppkey % 10 = 1) AS holes FROM lineitem)
    SELECT "case", 'cast-safety' AS "check", status, CASE WHEN measured THEN n ELSE 0 END AS checked_rows,
      0 AS cast_failures, CASE WHEN measured THEN holes ELSE 0 END AS null_values
    FROM n, (VALUES ('required', 'error', true), ('nullable', 'ok', true), ('missing', 'error', false),
      ('nested', 'unknown', false)) v("case", status, measured)"""
ORACLES["update_expr_probe"] = """
    WITH s AS (FROM lineitem WHERE l_quantity > 25),
    n AS (SELECT count(*) AS n, count(*) FILTER (l_partkey % 2 = 1) AS odd FROM s),
    big AS (SELECT count(*) FILTER (l_linenumber > 3) AS over FROM s)
    SELECT 'update-expression' AS "check", 'UPDATE of l_quantity' AS subject, 'ok' AS status, n AS checked_rows,
      0 AS cast_failures FROM n
    UNION ALL SELECT 'update-expression', 'UPDATE of l_suppkey', CASE WHEN odd > 0 THEN 'error' ELSE 'ok' END, n, odd FROM n
    UNION ALL SELECT 'update-expression', 'UPDATE of l_linenumber', CASE WHEN over > 0 THEN 'error' ELSE 'ok' END, n, over
      FROM n, big
    UNION ALL SELECT 'update-expression', 'l_absent', 'error', 0, 0
    UNION ALL SELECT 'update-expression', 'UPDATE of l_tax', 'error', 0, 0"""
ORACLES["column_expr_probe"] = f"""
    SELECT 'column-expression' AS "check", 'MATERIALIZED of k' AS subject, 'ok' AS status, count(*) AS checked_rows,
      0 AS cast_failures, 0 AS null_values FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INT) IS NOT NULL
    UNION ALL SELECT 'column-expression', 'DEFAULT of tenfold', CASE WHEN cast_failures > 0 THEN 'error' ELSE 'ok' END,
      checked_rows, cast_failures, null_values FROM ({_cast('events', 'value * 10', 'DOUBLE', 'INT')})"""
ORACLES["change_class"] = """
    SELECT doc_id AS change_id,
      CASE WHEN doc_id % 2 = 0 AND doc_id % 25 IN (0, 17) THEN 'risky-materialized-column'
        WHEN doc_id % 25 < 15 THEN 'metadata-only' WHEN doc_id % 25 < 23 THEN 'part-rewriting'
        WHEN doc_id % 25 = 23 THEN 'risky-materialized-column' ELSE 'unsupported' END AS classification,
      CASE WHEN doc_id % 25 IN (15, 16) THEN 'predicate' WHEN doc_id % 25 BETWEEN 17 AND 23 THEN 'all' ELSE 'none' END
        AS rewrite_scope
    FROM documents"""
ORACLES["correctness_status"] = """
    SELECT ['ok', 'unknown', 'warning', 'error'][worst] AS status, count(*) AS orders FROM (
      SELECT l_orderkey, max(CASE WHEN l_quantity > 49 THEN 4 WHEN l_tax > 0.07 THEN 3 WHEN l_discount > 0.09 THEN 2
        ELSE 1 END) AS worst FROM lineitem GROUP BY 1) GROUP BY 1"""
_NOTHING = "0 AS matching_rows, 0 AS affected_part_rows, 0 AS affected_parts, 0 AS affected_bytes"
_DELETE_HIT = "l_quantity = 50 AND l_suppkey % 16 < 4"
_SEVEN = f"SELECT count(*) FROM lineitem WHERE {HIT} AND l_suppkey % 7 <> 0"
_DISCOUNTS = f"SELECT count(*) FROM lineitem WHERE {_failed('l_discount', 'DOUBLE', 'INT')}"
_WIDE = "SELECT count(*) FROM lineitem WHERE l_partkey * 100 > 32767"


def _status(failures: str) -> str:
    return f"CASE WHEN ({failures}) > 0 THEN 'error' ELSE 'ok' END"


_DRY_RUN_ROWS = [
    ("update", "part-rewriting", "predicate", f"({_touched(HIT)})", "predicate-part-scan", 3, _status(_SEVEN)),
    ("delete", "part-rewriting", "predicate", f"({_touched(_DELETE_HIT)})", "predicate-part-scan", 1, "'ok'"),
    ("delete_all", "unsupported", "none", f"(SELECT {_NOTHING})", "none", 0, "'ok'"),
    ("subquery", "unsupported", "none", f"(SELECT {_NOTHING})", "none", 0, "'ok'"),
    ("modify", "part-rewriting", "all", f"({_touched('true')})", "table-metadata-upper-bound", 1, _status(_DISCOUNTS)),
    ("nested", "part-rewriting", "all", f"({_touched('true')})", "table-metadata-upper-bound", 1, "'unknown'"),
    ("add", "metadata-only", "none", f"(SELECT {_NOTHING})", "none", 1, _status(_WIDE)),
    ("drop", "metadata-only", "none", f"(SELECT {_NOTHING})", "none", 0, "'ok'"),
    ("other", "unsupported", "none", f"(SELECT {_NOTHING})", "none", 0, "'ok'"),
]
_DRY_RUNS = " UNION ALL ".join(
    f"""SELECT '{name}' AS change, '{kind}' AS classification, '{scope}' AS rewrite_scope, rows AS table_rows,
      active_parts, bytes AS table_bytes, matching_rows, affected_part_rows, affected_parts, affected_bytes,
      '{evidence}' AS evidence, {probes} AS probes, {status} AS correctness_status
    FROM ({_TOTALS}), {estimate}"""
    for name, kind, scope, estimate, evidence, probes, status in _DRY_RUN_ROWS
)
ORACLES["dry_run_change"] = _DRY_RUNS
ORACLES["migration_finding"] = f"""
    SELECT change AS artifact,
      CASE WHEN classification = 'unsupported' THEN 'INDETERMINATE' WHEN correctness_status = 'error' THEN 'FAIL'
        WHEN affected_parts > 0 THEN 'WARN' ELSE 'PASS' END AS verdict,
      coalesce(nullif(concat_ws(', ',
        CASE WHEN change IN ('modify', 'nested') THEN 'migration_cast-safety' END,
        CASE WHEN change = 'add' THEN 'migration_column-expression' END,
        CASE WHEN rewrite_scope = 'predicate' THEN 'migration_predicate' END,
        CASE WHEN affected_parts > 0 THEN 'migration_rewrite_footprint' END,
        CASE WHEN change = 'update' THEN 'migration_update-expression (2)' END
      ), ''), '-') AS finding_ids
    FROM ({_DRY_RUNS})"""

_STATS = f"""
    SELECT {YEAR} AS partition, {YEAR} || '-' || ({PART}) AS part, count(*) AS rows, 4096 AS bytes,
      min(l_orderkey) AS min_l_orderkey, max(l_orderkey) AS max_l_orderkey,
      min(l_suppkey) AS min_l_suppkey, max(l_suppkey) AS max_l_suppkey
    FROM lineitem GROUP BY 1, 2"""
ORACLES["part_stats"] = _STATS


def _ratio(name: str, partition: str, has_partition: str, key: str, has_key: str) -> str:
    return f"""
    SELECT '{name}' AS "table", 'partition' AS level, {has_partition} AS has_condition,
      count(*) FILTER ({partition}) AS selected, count(*) AS total,
      coalesce(sum(rows) FILTER ({partition}), 0)::BIGINT AS selected_rows, sum(rows)::BIGINT AS total_rows
    FROM ({_STATS})
    UNION ALL
    SELECT '{name}', 'key', {has_key}, count(*) FILTER ({key}), count(*),
      coalesce(sum(rows) FILTER ({key}), 0)::BIGINT, coalesce(sum(rows), 0)::BIGINT
    FROM ({_STATS}) WHERE {partition}"""


_RATIOS = " UNION ALL ".join([
    _ratio("both", "partition BETWEEN 1996 AND 1997", "true", "max_l_suppkey >= 3 AND min_l_suppkey <= 9", "true"),
    _ratio("key", "true", "false", "min_l_suppkey <= 2 AND max_l_orderkey >= 0", "true"),
    _ratio("year", "partition = 1999", "true", "true", "false"),
    _ratio("none", "true", "false", "true", "false"),
])
ORACLES["scan_ratio"] = _RATIOS
ORACLES["full_scan"] = f"""
    SELECT name AS "table", 'full-scan' AS code, severity, 'proven' AS confidence,
      'parts ' || n || '/' || n AS evidence
    FROM (SELECT count(*) AS n, sum(rows) AS rows FROM ({_STATS})),
      (VALUES ('none', 'medium'), ('unsized', 'high')) v(name, severity)
    WHERE rows < 10000000"""
ORACLES["missing_partition_pruning"] = f"""
    SELECT "table", 'missing-partition-pruning' AS code, 'medium' AS severity,
      'parts ' || selected || '/' || total AS evidence
    FROM ({_RATIOS}) WHERE level = 'partition' AND NOT has_condition AND total > 1 AND selected = total"""
ORACLES["missing_key_pruning"] = f"""
    SELECT "table", 'missing-primary-key-pruning' AS code, 'medium' AS severity,
      'parts ' || selected || '/' || total AS evidence
    FROM ({_RATIOS}) WHERE level = 'key' AND NOT has_condition AND total > 1 AND selected = total"""
ORACLES["layout_hint"] = """
    SELECT "table", 'missing-partition-pruning' AS code, "table" = 'db.lineitem' AS names_layout
    FROM (VALUES ('db.lineitem'), ('key')) v("table") WHERE (SELECT count(*) FROM lineitem) > 1"""
ORACLES["no_scan_evidence"] = f"""
    SELECT "table", 'no-scan-evidence' AS code, count(*) AS queries FROM ({_READS})
    WHERE "table" <> 'db.lineitem' GROUP BY 1"""
ORACLES["diagnosis_finding"] = f"""
    SELECT "table" AS artifact, id, 'warn' AS severity, 'warn' AS verdict, 'performance' AS category,
      'explain' AS evidence_level, 'production_explain' AS strategy, false AS blocking,
      'confidence=proven;severity=medium;evidence=parts ' || n || '/' || n AS evidence
    FROM (SELECT *, CASE WHEN "table" = 'year' THEN in_year ELSE parts END AS n FROM
      (SELECT count(*) AS parts, count(*) FILTER (partition = 1999) AS in_year FROM ({_STATS})), (VALUES ('none', 'query_full-scan'), ('none', 'query_missing-partition-pruning'),
      ('none', 'query_missing-primary-key-pruning'), ('key', 'query_missing-partition-pruning'),
      ('year', 'query_missing-primary-key-pruning')) v("table", id))
    WHERE (SELECT count(*) FROM lineitem) < 10000000"""

_LOG = """
    SELECT ts AS event_time, event_type = 'error' AS failed, event_id % 17 = 0 AS insert_query,
      event_id % 19 <> 0 AS is_initial, event_type, round(value * 1000)::BIGINT AS read_bytes,
      (event_id % 100)::BIGINT AS query_duration_ms,
      CASE WHEN event_id % 7 = 0 THEN ['system.parts'] WHEN event_id % 11 = 0 THEN ['_table_function.numbers']
        WHEN event_id % 13 = 0 THEN ['db.' || event_type, 'users'] ELSE ['db.' || event_type] END AS tables
    FROM events"""


def _recent(days: int) -> str:
    return f"""
    SELECT * FROM ({_LOG}) WHERE NOT failed AND NOT insert_query AND is_initial
      AND event_time > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {days} DAY"""


_USER = "len(list_filter(tables, lambda t: split_part(t, '.', 1) <> 'system' AND NOT starts_with(t, '_table_function'))) > 0"
_SHAPE = "'SELECT sum(value) FROM db.' || event_type || ' WHERE user_id IN (?..) AND value > ? AND note = ?'"
ORACLES["log_filter"] = f"""
    SELECT tables[1] AS first_table, count(*) AS queries, sum(read_bytes)::BIGINT AS read_bytes
    FROM ({_recent(7)}) GROUP BY 1"""
ORACLES["user_table_filter"] = f"""
    SELECT array_to_string(tables, ',') AS tables, count(*) AS queries FROM ({_LOG}) WHERE {_USER} GROUP BY 1"""
ORACLES["normalize_query_log"] = f"""
    SELECT {_SHAPE} AS shape, sha256({_SHAPE}) AS hash, count(*) AS runs FROM ({_LOG}) GROUP BY 1, 2"""
ORACLES["normalize_query_texts"] = r"""
    SELECT doc_id, sha256(shape) AS hash, length(shape) AS length FROM (
      SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
        trim(regexp_replace(text, '\s+', ' ', 'g')),
        '''[^''\\]*(?:(?:\\.|'''')[^''\\]*)*''', '?', 'g'),
        '\b[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\b', '?', 'g'),
        '\?(?:\s*,\s*\?)+', '?..', 'g') AS shape FROM documents)"""
_RANKED = f"""
    SELECT sha256({_SHAPE}) AS hash, {_SHAPE} AS sample_query, count(*) AS runs,
      sum(read_bytes)::BIGINT AS total_read_bytes, sum(query_duration_ms)::BIGINT AS total_duration_ms,
      array_to_string(list_sort(list_distinct(flatten(list(tables)))), ',') AS tables, event_type
    FROM ({_recent(30)}) WHERE {_USER} GROUP BY event_type ORDER BY total_read_bytes DESC LIMIT 20"""
ORACLES["rank_workload"] = f"SELECT * EXCLUDE (event_type) FROM ({_RANKED})"
_FLAGGED = f"""
    SELECT hash, runs, concat_ws(',', CASE WHEN event_type IN ('signup', 'click') THEN 'db.' || event_type END,
      CASE WHEN tables LIKE '%users%' THEN 'users' END) AS replacing_tables FROM ({_RANKED})"""
ORACLES["flag_versioned_tables"] = _FLAGGED
ORACLES["workload_summary"] = f"""
    SELECT count(*) AS shapes, count(*) FILTER (replacing_tables <> '') AS reads_versioned FROM ({_FLAGGED})"""

# The texts are built from documents by 29 templates; each is described by what has to come out of it.
_PATH = """
    (CASE doc_id % 3 WHEN 0 THEN 'queries/' WHEN 1 THEN 'migrations/2024/' ELSE 'docs/' END || 'd' || doc_id
      || CASE WHEN doc_id % 5 = 0 THEN '.md' ELSE '.sql' END)"""
# Clean statements; {q} stands for the quoted document, {p} for one quoted after a wildcard.
_CLEAN = [
    "SELECT doc_id, n_chars FROM db.documents WHERE lang = {q}",
    "SELECT * FROM db.documents FINAL",
    "WITH t AS (SELECT 1 AS a) SELECT a FROM t WHERE note = {q}",
    "SELECT a FROM x JOIN y ON x.i = y.i JOIN z ON y.i = z.i WHERE lower(a) = {q}",
    "SELECT a FROM x CROSS JOIN y WHERE b LIKE {p}",
    "SELECT rand() FROM x WHERE b = {q}",
    "SELECT a FROM x LIMIT 10",
    "SELECT a FROM (SELECT a FROM x ORDER BY a LIMIT 5) t WHERE b = {q}",
    "SELECT a FROM x SAMPLE 0.1",
    "SELECT a FROM x; SELECT b FROM y",
    "SELECT a FROM x WHERE b = {q} INTO OUTFILE 'out.csv'",
    "SELECT a FROM x WHERE b = {q} FORMAT JSON",
    "SELECT a FROM x WHERE b = {q} SETTINGS max_threads = 1",
    "SELECT a FROM s3({q})",
    "SELECT 'rand(', {q} FROM x WHERE c = 'FINAL JOIN LIMIT 1'",
    "ALTER TABLE db.t ADD COLUMN c INT DEFAULT 1",
    "ALTER TABLE db.t UPDATE a = concat({q}, b), d = 2 WHERE id = 1",
    "ALTER TABLE db.t DELETE WHERE id IN (SELECT id FROM u WHERE v = {q})",
    "ALTER TABLE db.t MODIFY COLUMN a BIGINT",
    "ALTER TABLE db.t MATERIALIZE COLUMN a",
    "ALTER TABLE db.t ADD COLUMN a INT, DROP COLUMN b",
    "ALTER TABLE db.t UPDATE a = {q}",
    "INSERT INTO x SELECT {q}",
    "",
    "ALTER TABLE db.t ON CLUSTER k DROP COLUMN a",
    "SELECT a, b FROM x WHERE c = {q}",
    "SELECT a FROM x WHERE c = {q}",
    "SELECT \"a -- b\", `c /* d`, '/* e */' FROM x WHERE f = {q}",
    "ALTER TABLE db.t DROP COLUMN a",
]
_QUOTED = r"""('''' || replace(replace(text, '\', '\\'), '''', '''''') || '''')"""


def _clean_case() -> str:
    whens = []
    for number, template in enumerate(_CLEAN):
        text = "'" + template.replace("'", "''") + "'"
        text = text.replace("{q}", f"' || {_QUOTED} || '")
        text = text.replace("{p}", f"' || '''%' || substring({_QUOTED}, 2) || '")
        whens.append(f"WHEN {number} THEN {text}")
    return f"CASE doc_id % {len(_CLEAN)} {' '.join(whens)} END"


def _masked_case() -> str:
    """Quoted parts of the clean statement as blanks of the same length."""
    whens = []
    for number, template in enumerate(_CLEAN):
        pieces = re.split(r"('[^']*'|\"[^\"]*\"|`[^`]*`|\{q\}|\{p\})", template)
        parts = []
        for piece in pieces:
            if piece == "{q}":
                parts.append(f"repeat(' ', length({_QUOTED}))")
            elif piece == "{p}":
                parts.append(f"repeat(' ', length({_QUOTED}) + 1)")
            elif piece[:1] in {"'", '"', "`"}:
                parts.append("'" + " " * len(piece) + "'")
            else:
                parts.append("'" + piece + "'")
        whens.append(f"WHEN {number} THEN {' || '.join(parts)}")
    return f"CASE doc_id % {len(_CLEAN)} {' '.join(whens)} END"


_TEXTS = f"SELECT doc_id, doc_id % 29 AS number, {_PATH} AS path, {_clean_case()} AS statement, {_QUOTED} AS quoted FROM documents"
ORACLES["clean_sql_texts"] = f"SELECT path, length(statement) AS length, sha256(statement) AS hash FROM ({_TEXTS})"
ORACLES["mask_literals_texts"] = f"""
    SELECT path, length(masked) AS length, sha256(masked) AS hash
    FROM (SELECT {_PATH} AS path, {_masked_case()} AS masked FROM documents)"""
ORACLES["fingerprint"] = f"""
    SELECT path, sha256(CASE number WHEN 25 THEN 'SELECT a FROM x' || chr(10) || '---' || chr(10) || statement
      WHEN 26 THEN 'SELECT now() FROM x WHERE c = ' || quoted || chr(10) || '---' || chr(10) || statement
      ELSE statement END) AS fingerprint FROM ({_TEXTS})"""
_KIND = """CASE WHEN number IN (25, 26) THEN 'query_pair' WHEN number <= 14 OR number = 27 THEN 'query'
      WHEN number IN (22, 23) THEN 'unknown' ELSE 'migration' END"""
ORACLES["statement_kind"] = f"SELECT path, {_KIND} AS kind FROM ({_TEXTS})"
_QUERIES = f"SELECT * FROM ({_TEXTS}) WHERE number <= 14 OR number IN (25, 26, 27)"
_FLAGS = f"""
    SELECT path, number, number = 1 AS has_final, CASE number WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS join_count,
      number = 4 AS has_cross_join, number = 3 AS has_function_wrapped_predicate,
      number = 4 AS has_leading_wildcard, number = 1 AS selects_all_columns FROM ({_QUERIES})"""
ORACLES["query_shape_flags"] = f"SELECT * EXCLUDE (number) FROM ({_FLAGS})"
_ADVICE = """(VALUES (1, 'final-cost', 'medium'), (1, 'select-star', 'low'),
      (3, 'function-wrapped-predicate', 'medium'), (3, 'join-shape', 'medium'), (4, 'leading-wildcard', 'medium'),
      (4, 'join-shape', 'high')) v(number, code, severity)"""
ORACLES["query_advisories"] = f"SELECT path, code, severity FROM ({_QUERIES}) JOIN {_ADVICE} USING (number)"
ORACLES["unstable_flags"] = f"""
    SELECT path, CASE number WHEN 5 THEN 'uses the non-deterministic function rand'
      WHEN 6 THEN 'uses LIMIT without an ordering' WHEN 8 THEN 'reads a sample' END AS unstable_reason
    FROM ({_QUERIES})"""
ORACLES["reject_reason"] = f"""
    SELECT path, CASE number WHEN 9 THEN 'several statements' WHEN 10 THEN 'writes a file'
      WHEN 11 THEN 'names an output format' WHEN 12 THEN 'changes settings'
      WHEN 13 THEN 'calls external function s3' END AS reject_reason
    FROM ({_QUERIES})"""
_CLASSES = """(VALUES (15, 'metadata-only', 'none'), (16, 'part-rewriting', 'predicate'), (17, 'unsupported', 'none'),
      (18, 'part-rewriting', 'all'), (19, 'risky-materialized-column', 'all'), (20, 'unsupported', 'none'),
      (21, 'unsupported', 'none'), (24, 'unsupported', 'none'), (28, 'metadata-only', 'none')
      ) v(number, classification, rewrite_scope)"""
ORACLES["alter_class"] = f"SELECT path, classification, rewrite_scope FROM ({_TEXTS}) JOIN {_CLASSES} USING (number)"
ORACLES["match_globs"] = f"""
    SELECT path FROM ({_TEXTS}) WHERE (path LIKE 'queries/%' AND path LIKE '%.sql') OR path LIKE 'migrations/%'
      OR regexp_matches(path, '/d.5[^/]*[.]md$')"""

ORACLES["slice_budget"] = f"""
    SELECT "case", n AS rows, parts * 1000000 AS bytes, "case" = 'fits' AS allowed
    FROM (SELECT count(*) AS n, count(DISTINCT {PART}) AS parts FROM lineitem WHERE {YEAR} = 1998),
      (VALUES ('fits'), ('rows'), ('bytes'), ('total')) v("case")"""
ORACLES["choose_partition"] = f"SELECT 1998 AS partition, count(*) AS rows FROM lineitem WHERE {YEAR} = 1998"
_ONE_YEAR = f"(FROM lineitem WHERE {YEAR} = 1998)"
_DOUBLED = f"(FROM (FROM lineitem WHERE {YEAR} = 1998 UNION ALL FROM lineitem WHERE {YEAR} = 1998 AND l_linenumber = 1))"
ORACLES["slice_proof"] = f"""
    SELECT "case", s.total_rows AS source_total_rows, s.duplicate_groups AS source_duplicate_groups,
      s.duplicate_rows AS source_duplicate_rows, s.max_copies AS source_max_copies, c.total_rows AS slice_total_rows,
      c.duplicate_groups AS slice_duplicate_groups, c.duplicate_rows AS slice_duplicate_rows,
      c.max_copies AS slice_max_copies,
      (s.duplicate_groups, s.duplicate_rows, s.max_copies) = (c.duplicate_groups, c.duplicate_rows, c.max_copies) AS matched
    FROM ({_proof('true', _ONE_YEAR)}) s, (SELECT 'copy' AS "case", * FROM ({_proof('true', _ONE_YEAR)})
      UNION ALL SELECT 'damaged', * FROM ({_proof('true', _DOUBLED)})) c"""
ORACLES["slice_round_trip"] = f"""
    SELECT 'valid' AS state, total_rows AS rows, duplicate_rows AS duplicates, true AS matched
    FROM ({_proof('true', _ONE_YEAR)})"""

_TEXT_RUNS = f"""
    SELECT path, number, CASE WHEN number IN (9, 10, 11, 12, 13) THEN 'error' ELSE {_KIND} END AS type,
      CASE WHEN number IN (9, 10, 11, 12, 13, 17, 20, 21, 24, 22, 23, 26) THEN 'INDETERMINATE'
        WHEN number IN (1, 3, 4) THEN 'WARN' ELSE 'PASS' END AS verdict,
      CASE number WHEN 1 THEN 'query_final-cost, query_select-star'
        WHEN 3 THEN 'query_function-wrapped-predicate, query_join-shape'
        WHEN 4 THEN 'query_join-shape, query_leading-wildcard' ELSE '-' END AS finding_ids FROM ({_TEXTS})"""
ORACLES["text_runs"] = f"""
    SELECT path AS artifact, verdict, finding_ids, type, verdict = 'WARN' AS failing,
      type IN ('unknown', 'error') AS errored FROM ({_TEXT_RUNS})"""

# What the suite finds, per artifact: texts, logged queries and one change.
_TEXT_FINDINGS = f"SELECT path AS artifact, 'query_' || code AS id, 'warn' AS severity, false AS blocking FROM ({_QUERIES}) JOIN {_ADVICE} USING (number)"
_SCAN_FINDINGS = f"""
    SELECT query_id AS artifact, id, severity, blocking FROM ({_READS}), (VALUES
      ('query_full-scan', false), ('query_missing-partition-pruning', false),
      ('query_missing-primary-key-pruning', false)) v(id, _), (SELECT CASE WHEN n < 10000000 THEN 'warn' ELSE 'error' END AS size_severity,
        n >= 10000000 AS large FROM (SELECT count(*) AS n FROM lineitem)),
      LATERAL (SELECT CASE WHEN id = 'query_full-scan' THEN size_severity ELSE 'warn' END AS severity,
        id = 'query_full-scan' AND large AS blocking)
    WHERE "table" = 'db.lineitem'
    UNION ALL SELECT query_id, 'query_no-scan-evidence', 'warn', false FROM ({_READS}) WHERE "table" <> 'db.lineitem'"""
_PATH_FINDINGS = f"""
    SELECT query_id AS artifact, 'read_path_uniqueness_violated' AS id, 'error' AS severity, true AS blocking
    FROM ({_OUTCOMES}) WHERE status = 'violated'"""
_CHANGE_FINDINGS = f"""
    SELECT 'update' AS artifact, id, severity, severity = 'error' AS blocking FROM (
      SELECT 'migration_predicate' AS id, 'info' AS severity
      UNION ALL SELECT 'migration_update-expression', 'info'
      UNION ALL SELECT 'migration_update-expression', CASE WHEN ({_SEVEN}) > 0 THEN 'error' ELSE 'info' END
      UNION ALL SELECT 'migration_rewrite_footprint', 'warn' FROM ({_touched(HIT)}) WHERE affected_parts > 0)"""
_ALL_FINDINGS = f"""
    {_TEXT_FINDINGS} UNION ALL {_SCAN_FINDINGS} UNION ALL {_PATH_FINDINGS} UNION ALL {_CHANGE_FINDINGS}"""
ORACLES["verify_suite"] = f"""
    SELECT id, severity, blocking, count(*) AS findings FROM ({_ALL_FINDINGS}) GROUP BY ALL"""
_LIMITS = f"""
    SELECT path AS artifact, number = 26 AS unproven FROM ({_TEXTS})
    WHERE number IN (9, 10, 11, 12, 13, 17, 20, 21, 24, 22, 23, 26)
    UNION ALL SELECT query_id, true FROM ({_OUTCOMES}) WHERE status = 'unknown'"""
ORACLES["aggregate_verdict"] = f"""
    WITH f AS (
      SELECT artifact, blocking AND severity = 'error' AS fails, severity = 'warn' AS warns, false AS unproven
      FROM ({_ALL_FINDINGS})
      UNION ALL SELECT artifact, false, false, unproven FROM ({_LIMITS}))
    SELECT verdict, count(*) AS artifacts FROM (
      SELECT artifact, CASE WHEN bool_or(fails) THEN 'fail' WHEN bool_or(unproven) THEN 'indeterminate'
        WHEN bool_or(warns) THEN 'warn' ELSE 'pass' END AS verdict FROM f GROUP BY 1) GROUP BY 1"""
ORACLES["gate_status"] = f"""
    WITH f AS (SELECT artifact, bool_or(blocking AND severity = 'error') AS fails FROM ({_ALL_FINDINGS}) GROUP BY 1),
    runs AS (
      SELECT type, lower(verdict) AS verdict FROM ({_TEXT_RUNS})
      UNION ALL SELECT 'query', CASE WHEN fails THEN 'fail' ELSE 'warn' END FROM ({_READS}) JOIN f ON artifact = query_id
      UNION ALL SELECT 'migration', CASE WHEN ({_SEVEN}) > 0 THEN 'fail' WHEN affected_parts > 0 THEN 'warn' ELSE 'pass' END
        FROM ({_touched(HIT)}))
    SELECT strict, type, verdict, verdict = 'fail' OR (verdict = 'warn' AND (type = 'migration' OR strict)) AS failing,
      type IN ('unknown', 'error') AS errored, count(*) AS artifacts
    FROM runs, (VALUES (false), (true)) v(strict) GROUP BY ALL"""
ORACLES["exit_code"] = f"""
    SELECT 'dedup' AS suite, CASE WHEN duplicate_rows > 0 THEN 1 ELSE 0 END AS exit_code FROM ({_LINE_PROOF})
    UNION ALL SELECT 'texts', CASE WHEN count(*) > 0 THEN 2 ELSE 0 END FROM documents"""
ORACLES["run_log_entries"] = r"""
    SELECT 'check-' || lang AS tool, CASE WHEN doc_id % 4 = 0 THEN 'error' ELSE 'ok' END AS outcome,
      n_chars AS "durationMs", least(length(trim(split_part(text, chr(10), 1))), 200) AS summary_length FROM documents"""
ORACLES["display_numbers"] = """
    WITH s AS (SELECT o_orderkey, floor(o_totalprice * pow(10.0, o_orderkey % 9))::BIGINT AS n FROM orders),
    u AS (SELECT *, CASE WHEN n < 1024 THEN 0 ELSE least(floor(log2(n) / 10), 5)::INT END AS unit FROM s)
    SELECT o_orderkey, format('{:,}', n) AS count_text,
      CASE WHEN unit = 0 THEN n || ' B'
        WHEN n / pow(1024, unit) >= 10 THEN printf('%.1f', round(n / pow(1024, unit), 1)) || ' ' || ['KiB', 'MiB', 'GiB', 'TiB', 'PiB'][unit]
        ELSE printf('%.2f', round(n / pow(1024, unit), 2)) || ' ' || ['KiB', 'MiB', 'GiB', 'TiB', 'PiB'][unit] END AS bytes_text
    FROM u"""

ORACLES["cast_probe_varchar"] = """
    SELECT count(*) AS checked_rows, count(*) FILTER (length(text) > 500) AS cast_failures,
      count(*) FILTER (text IS NULL) AS null_values FROM documents"""
# A division by zero happens on every first line of an order.
ORACLES["dry_run_change_errors"] = """
    WITH facts AS (
      SELECT count(*) AS n, count(*) FILTER (l_quantity > 10) AS hits, count(*) FILTER (l_linenumber = 1) > 0 AS fails,
        count(*) FILTER (l_linenumber = 1 AND l_quantity > 10) > 0 AS probe_fails FROM lineitem
    )
    SELECT 'predicate' AS change, n AS table_rows, 0 AS matching_rows, CASE WHEN fails THEN 'error,unknown' END AS statuses,
      CASE WHEN fails THEN 'error' END AS correctness_status, 'none' AS evidence FROM facts
    UNION ALL SELECT 'probe', n, hits, CASE WHEN probe_fails THEN 'ok,error,ok' END, CASE WHEN probe_fails THEN 'error' END,
      'predicate-part-scan' FROM facts
    UNION ALL SELECT 'neither', n, hits, 'ok,ok', 'ok', 'predicate-part-scan' FROM facts"""

# The table is one file.
ORACLES["parts_summary_files"] = f"""
    SELECT 1 AS active_parts, count(*) AS rows, count(DISTINCT {YEAR}) AS partitions, true AS has_bytes FROM lineitem"""

ORACLES["read_path_plans"] = f"""
    WITH items AS ({_global()}), orders_by AS ({_global('orders', 'o_custkey')}), facts AS (
      SELECT i.final_collapsible_rows AS i, o.final_collapsible_rows AS o FROM items i, orders_by o
    )
    SELECT query_id, 'db.lineitem' AS "table", declared, CASE WHEN declared = 'l_suppkey' THEN 'unknown' WHEN i > 0 THEN 'violated' ELSE 'clean' END AS status,
      CASE WHEN declared = 'l_suppkey' THEN 0 ELSE i END AS duplicate_rows
    FROM facts, (VALUES ('sums'), ('latest'), ('joined')) q(query_id), (VALUES ('l_suppkey'), ('l_orderkey,l_linenumber')) k(declared)
    WHERE NOT (query_id = 'latest' AND declared <> 'l_suppkey')
    UNION ALL
    SELECT query_id, 'db.orders', '`o_custkey`', CASE WHEN o > 0 THEN 'violated' ELSE 'clean' END, o FROM facts, (VALUES ('joined'), ('filtered')) q(query_id)"""
ORACLES["part_stats_files"] = """
    SELECT count(*) AS rows, true AS has_bytes, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey,
      min(o_custkey) AS min_o_custkey, max(o_custkey) AS max_o_custkey, min(o_orderdate) AS min_o_orderdate, max(o_orderdate) AS max_o_orderdate
    FROM orders"""
ORACLES["stored_columns"] = """
    SELECT pos, name, type, "null" = 'YES' AS nullable, CASE WHEN name = 'l_tax' THEN 'DEFAULT' END AS default_kind,
      CASE WHEN name = 'l_tax' THEN '0.0' END AS default_expr, filled, true AS has_codec, true AS sized
    FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM lineitem) ON COLUMNS(*) INTO NAME name VALUE filled)
    JOIN (SELECT column_name, "null", row_number() OVER () AS pos,
        replace(replace(replace(lower(column_type), 'varchar', 'string'), 'integer', 'int'), 'timestamp', 'timestamp_ntz') AS type
        FROM (DESCRIBE lineitem)) c
      ON c.column_name = name"""
ORACLES["update_expr_functions"] = """
    WITH n AS (SELECT count(*) AS n FROM lineitem WHERE l_linenumber < 4)
    SELECT 'UPDATE of ' || c AS subject, status, CASE WHEN status = 'ok' THEN n ELSE 0 END AS checked_rows, 0 AS cast_failures
    FROM n, (VALUES ('l_quantity', 'ok'), ('l_tax', 'ok'), ('l_discount', 'ok'), ('l_suppkey', 'error'), ('l_partkey', 'error'),
      ('l_returnflag', 'ok'), ('l_linenumber', 'error')) v(c, status)"""

ORACLES["report_totals"] = f"""
    SELECT count(*) AS artifacts, count(*) FILTER (type IN ('unknown', 'error') OR verdict = 'FAIL' OR (strict AND verdict = 'WARN')) AS failed, strict
    FROM ({_TEXT_RUNS}), (VALUES (false), (true)) s(strict) GROUP BY strict"""
ORACLES["run_log_round_trip"] = """
    SELECT lang AS tool, CASE WHEN doc_id % 4 = 0 THEN 'error' ELSE 'ok' END AS outcome, 2 * count(*) AS runs, 2 * sum(n_chars)::BIGINT AS ms, true AS stored
    FROM documents GROUP BY 1, 2"""
