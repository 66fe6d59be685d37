"""Inputs of the checks, derived from the test tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataproof import TableSpec
from dataproof.functions.literal import literal_rows

LINEITEM_KEY = ["l_orderkey", "l_linenumber"]
YEAR = "year(l_shipdate)"
MONTH = "date_format(l_shipdate, 'yyyyMM')"
PART = "l_suppkey % 16"

LINEITEM = TableSpec(
    "db.lineitem",
    dedup_key=("l_orderkey", "l_linenumber"),
    partition=YEAR,
    part=PART,
    sort_key=("l_orderkey", "l_linenumber"),
    version="l_shipdate",
)
ORDERS = TableSpec("db.orders", dedup_key=("o_orderkey",), partition="year(o_orderdate)")
EVENTS = TableSpec("db.events", dedup_key=("event_id",), partition="date_format(ts, 'yyyyMMdd')")
CUSTOMER = TableSpec("db.customer", dedup_key=("c_custkey",), versioned=False)
PARTS = TableSpec("db.part", dedup_key=("p_partkey",), fan_out=True)
NATION = TableSpec("db.nation", dedup_key=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query log: each event is one finished or failed statement on a table or two."""
    events = table(spark, sf_dir, "events")
    own = F.concat(F.lit("db."), "event_type")
    tables = (
        F.when(F.col("event_id") % 7 == 0, F.array(F.lit("system.parts")))
        .when(F.col("event_id") % 11 == 0, F.array(F.lit("_table_function.numbers")))
        .when(F.col("event_id") % 13 == 0, F.array(own, F.lit("users")))
        .otherwise(F.array(own))
    )
    return events.select(
        F.col("ts").alias("event_time"),
        F.when(F.col("event_type") == "error", "ExceptionWhileProcessing").otherwise("QueryFinish").alias("type"),
        F.when(F.col("event_id") % 17 == 0, "Insert").otherwise("Select").alias("query_kind"),
        (F.col("event_id") % 19 != 0).alias("is_initial_query"),
        F.concat(
            F.lit("/* trace "), F.col("event_id").cast("string"), F.lit(" it's */ SELECT sum(value)  FROM "), own, F.lit(" WHERE user_id IN ("),
            F.col("user_id").cast("string"), F.lit(", "), F.col("event_id").cast("string"),
            F.lit(")\n AND value > "), F.col("value").cast("string"), F.lit(" AND note = 'it''s 5'"),
        ).alias("query"),
        F.round(F.col("value") * 1000).cast("bigint").alias("read_bytes"),
        (F.col("event_id") % 100).cast("bigint").alias("query_duration_ms"),
        tables.alias("tables"),
    )


def versioned_tables(spark: SparkSession) -> DataFrame:
    rows = [("db.signup",), ("db.click",), ("default.users",)]
    return literal_rows(spark, [("table", "string")], rows)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which query reads which table, and whether it collapses versions."""
    names = F.array(
        *[F.lit(name) for name in ("db.lineitem", "db.orders", "other.events", "db.customer", "db.part")]
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query_id"),
        F.element_at(names, (F.col("user_id") % 5 + 1).cast("int")).alias("table"),
        (F.col("event_id") % 6 == 0).alias("uses_final"),
    )


def assumptions(spark: SparkSession) -> DataFrame:
    return literal_rows(
        spark,
        [("table", "string"), ("unique_by", "array<string>")],
        [
            ("db.lineitem", ["`L_LINENUMBER`", "l_orderkey"]),
            ("db.orders", ["o_custkey"]),
            ("events", ["event_id"]),
            ("db.customer", ["c_custkey"]),
        ],
    )


TEMPLATES = 29


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SQL text per document; the whole document is a literal or a comment in it."""
    documents = table(spark, sf_dir, "documents")
    text = F.col("text")
    quoted = F.concat(
        F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'")
    )
    block = F.concat(F.lit("/* "), F.replace(text, F.lit("*/"), F.lit("* /")), F.lit(" */"))
    line = F.concat(F.lit("-- "), F.translate(text, "\r\n", "  "), F.lit("\n"))

    def sql(*pieces: Column | str) -> Column:
        return F.concat(*[F.lit(piece) if isinstance(piece, str) else piece for piece in pieces])

    texts = [
        sql(block, "SELECT doc_id, n_chars FROM db.documents WHERE lang = ", quoted, " ;"),
        sql(line, "SELECT * FROM db.documents FINAL"),
        sql("WITH t AS (SELECT 1 AS a) SELECT a", block, "FROM t WHERE note = ", quoted),
        sql("SELECT a FROM x JOIN y ON x.i = y.i JOIN z ON y.i = z.i WHERE lower(a) = ", quoted),
        sql("SELECT a FROM x CROSS JOIN y WHERE b LIKE '%", F.substring(quoted, F.lit(2), F.length(quoted))),
        sql("SELECT rand() FROM x WHERE b = ", quoted),
        sql("SELECT a FROM x LIMIT 10 ", line),
        sql("SELECT a FROM (SELECT a FROM x ORDER BY a LIMIT 5) t WHERE b = ", quoted),
        sql("SELECT a FROM x SAMPLE 0.1 ", block),
        sql("SELECT a FROM x; SELECT b FROM y", line),
        sql("SELECT a FROM x WHERE b = ", quoted, " INTO OUTFILE 'out.csv'"),
        sql("SELECT a FROM x WHERE b = ", quoted, " FORMAT JSON"),
        sql("SELECT a FROM x WHERE b = ", quoted, " SETTINGS max_threads = 1"),
        sql("SELECT a FROM s3(", quoted, ")"),
        sql("SELECT 'rand(', ", quoted, " FROM x WHERE c = 'FINAL JOIN LIMIT 1'"),
        sql("ALTER TABLE db.t ADD COLUMN c INT DEFAULT 1 ", block),
        sql("ALTER TABLE db.t UPDATE a = concat(", quoted, ", b), d = 2 WHERE id = 1"),
        sql("ALTER TABLE db.t DELETE WHERE id IN (SELECT id FROM u WHERE v = ", quoted, ")"),
        sql("ALTER TABLE db.t MODIFY COLUMN a BIGINT ", line),
        sql("ALTER TABLE db.t MATERIALIZE COLUMN a ", block, ";"),
        sql("ALTER TABLE db.t ADD COLUMN a INT, DROP COLUMN b", line),
        sql("ALTER TABLE db.t UPDATE a = ", quoted),
        sql("INSERT INTO x SELECT ", quoted),
        sql(block),
        sql("ALTER TABLE db.t ON CLUSTER k DROP COLUMN a", line),
        sql("SELECT a, b FROM x WHERE c = ", quoted),
        sql("SELECT a FROM x WHERE c = ", quoted),
        sql("SELECT \"a -- b\", `c /* d`, '/* e */' FROM x WHERE f = ", quoted, line),
        sql(line, "ALTER TABLE db.t DROP COLUMN a ", block),
    ]
    number = (F.col("doc_id") % TEMPLATES).cast("int")
    chosen = F.lit(None).cast("string")
    for position, candidate in enumerate(texts):
        chosen = F.when(number == position, candidate).otherwise(chosen)
    previous = F.when(number == 25, sql("SELECT a FROM x", block)).when(
        number == 26, sql("SELECT now() FROM x WHERE c = ", quoted)
    )
    folder = F.when(F.col("doc_id") % 3 == 0, "queries/").when(F.col("doc_id") % 3 == 1, "migrations/2024/").otherwise("docs/")
    suffix = F.when(F.col("doc_id") % 5 == 0, ".md").otherwise(".sql")
    return documents.select(
        F.concat(folder, F.lit("d"), F.col("doc_id").cast("string"), suffix).alias("path"),
        chosen.alias("sql"),
        previous.alias("prev_sql"),
    )


CHANGE_OPS = [
    "add_column", "drop_column", "rename_column", "comment_column", "modify_comment", "add_index", "add_projection",
    "add_constraint", "drop_index", "drop_projection", "drop_constraint", "modify_order_by", "modify_setting",
    "reset_setting", "remove_ttl", "update", "delete", "modify_column", "modify_ttl", "materialize_ttl", "clear_column",
    "materialize_index", "materialize_projection", "materialize_column", "swap_tables",
]


def change_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed changes, one per document."""
    ops = F.array(*[F.lit(op) for op in CHANGE_OPS])
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("change_id"),
        F.element_at(ops, (F.col("doc_id") % len(CHANGE_OPS) + 1).cast("int")).alias("op"),
        F.when(F.col("doc_id") % 2 == 0, "materialized").alias("kind"),
    )
