from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import dataproof as d


@pytest.fixture
def numbers(spark):
    return spark.createDataFrame([(1,), (1,), (2,), (None,)], "a BIGINT")


def test_equal_sides_are_correct(numbers, one):
    assert one(d.verify_equivalent(numbers, numbers.orderBy("a")))["verdict"] == "correct"


def test_copies_count(numbers, one, rows):
    result = one(d.verify_equivalent(numbers, numbers.distinct()))
    assert (result["verdict"], result["left_only"], result["right_only"]) == ("incorrect", 1, 0)
    assert rows(d.diff_sample(numbers, numbers.distinct())) == [{"_side": "left", "a": 1}]


def test_shape_mismatch_reads_nothing(numbers, one, rows):
    right = numbers.withColumn("b", F.lit("x"))
    result = one(d.verify_equivalent(numbers, right))
    assert result["verdict"] == "incorrect" and result["shape_mismatch"] and result["differing_rows"] == 0
    shape = rows(d.compare_shape(numbers, right))
    assert [row["type_match"] for row in shape] == [True, False]
    assert shape[1]["left_name"] is None and shape[1]["right_type"] == "string"
    narrowed = one(d.verify_equivalent(numbers, numbers.select(F.col("a").cast("int"))))
    assert narrowed["shape_mismatch"]
    with pytest.raises(ValueError):
        d.diff_counts(numbers, right)


def test_renamed_columns_are_incorrect(numbers, one):
    result = one(d.verify_equivalent(numbers.toDF("x"), numbers.toDF("y")))
    assert result["verdict"] == "incorrect" and result["renamed"] and result["differing_rows"] == 0


@pytest.mark.parametrize(
    "change, reason",
    [
        (lambda df: df.filter(F.rand() < 2), "rand"),
        (lambda df: df.withColumn("a", F.length(F.uuid()).cast("bigint")), "uuid"),
        (lambda df: df.filter(F.current_date() > F.lit("2000-01-01").cast("date")), "current_date"),
        (lambda df: df.filter(F.now().isNotNull()), "now"),
        (lambda df: df.limit(2), "LIMIT"),
        (lambda df: df.offset(1).select("a"), "LIMIT"),
        (lambda df: df.union(df.limit(1)), "LIMIT"),
        (lambda df: df.limit(2).orderBy("a"), "LIMIT"),
        (lambda df: df.limit(2).filter("a > 0"), "LIMIT"),
        (lambda df: df.limit(2).distinct(), "LIMIT"),
        (lambda df: df.limit(2).groupBy("a").count().select("a"), "LIMIT"),
        (lambda df: df.join(df.limit(2).toDF("b"), F.col("a") == F.col("b")).select("a"), "LIMIT"),
        (lambda df: df.sample(0.5), "sample"),
    ],
)
def test_unstable_sides_are_indeterminate(numbers, one, change, reason):
    result = one(d.verify_equivalent(numbers, change(numbers)))
    assert result["verdict"] == "indeterminate" and reason in result["reason"]


def test_stable_sides_pass_the_gate(spark, numbers):
    numbers.createOrReplaceTempView("gate_numbers")
    stable = [
        numbers.orderBy("a").limit(2),
        numbers.orderBy("a").limit(2).filter("a > 0").distinct(),
        numbers.filter("cast(a AS string) <> 'rand('"),
        spark.sql("SELECT a FROM gate_numbers ORDER BY a LIMIT 1"),
        numbers.orderBy("a").limit(2).select((F.col("a") + 1).alias("a")),
        numbers.union(numbers.orderBy("a").limit(1)),
    ]
    assert d.stability_gate(*stable) is None
    assert "now" in d.stability_gate(spark.sql("SELECT a FROM gate_numbers WHERE a < (SELECT unix_timestamp(now()))"))


def test_budget(numbers, one):
    result = one(d.verify_equivalent(numbers, numbers, max_rows=7))
    assert result["verdict"] == "indeterminate" and "7 rows" in result["reason"]
    assert one(d.verify_equivalent(numbers, numbers, max_rows=8))["verdict"] == "correct"


def test_sql_pair(spark, numbers, one):
    numbers.createOrReplaceTempView("pair_numbers")
    result = one(d.verify_sql_pair(spark, "SELECT a FROM pair_numbers", "SELECT max(a) AS a FROM pair_numbers GROUP BY a"))
    assert result["differing_rows"] == 1


def test_special_values_and_nested_types(spark, one):
    left = spark.sql("SELECT map('b', 2, 'a', 1) AS m, parse_json('{\"x\": [1, 2]}') AS v, double('NaN') AS f, "
                     "array(map('k', 0.0D)) AS n, named_struct('s', map(1, 'z')) AS s")
    right = spark.sql("SELECT map('a', 1, 'b', 2) AS m, parse_json('{\"x\": [1,2]}') AS v, double('NaN') AS f, "
                      "array(map('k', -0.0D)) AS n, named_struct('s', map(1, 'z')) AS s")
    assert one(d.verify_equivalent(left, right))["verdict"] == "correct"
    other = right.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert one(d.verify_equivalent(left, other))["differing_rows"] == 2


def test_same_column_name_twice(spark, one, rows):
    left = spark.sql("SELECT 1 AS a, 2 AS a")
    right = spark.sql("SELECT 2 AS a, 1 AS a")
    assert one(d.verify_equivalent(left, right))["differing_rows"] == 2
    assert d.diff_sample(left, right).columns == ["_side", "a", "a"]


def test_rounding_forgives_the_last_bits(spark, one):
    left = spark.createDataFrame([(0.1 + 0.2,)], "a DOUBLE")
    right = spark.createDataFrame([(0.3,)], "a DOUBLE")
    assert one(d.verify_equivalent(left, right))["verdict"] == "incorrect"
    assert one(d.verify_equivalent(left, right, round_to=9))["verdict"] == "correct"


def test_sample_sizes(spark, rows):
    left, right = spark.range(200).toDF("a"), spark.range(200, 300).toDF("a")
    for limit, expected in ((3, 3), (None, 10), (80, 80)):
        sample = rows(d.diff_sample(left, right, limit))
        assert len([row for row in sample if row["_side"] == "left"]) == expected
    with pytest.raises(ValueError, match="at least one"):
        d.diff_sample(left, right, 0)
    hot = spark.range(5000).select(F.lit(1).alias("a"))
    assert len(rows(d.diff_sample(hot, hot.filter("false"), 7))) == 7


def test_compare_reads_the_sides_once(spark, one, rows):
    left = spark.range(10).toDF("a")
    verdict, sample = d.compare(left, left.filter("a < 8"), limit=5)
    assert one(verdict)["left_only"] == 2 and [row["a"] for row in rows(sample)] == [8, 9]
    verdict, sample = d.compare(left, left.limit(3))
    assert one(verdict)["verdict"] == "indeterminate" and sample is None


cells = st.tuples(st.integers(0, 3) | st.none(), st.sampled_from(["x", "y", None]))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(cells, max_size=15), st.lists(cells, max_size=15))
def test_diff_against_counting(spark, left, right):
    ours, theirs = (spark.createDataFrame(side, "a INT, b STRING") for side in (left, right))
    counts = d.diff_counts(ours, theirs).first()
    assert counts["left_only"] == sum((Counter(left) - Counter(right)).values())
    assert counts["right_only"] == sum((Counter(right) - Counter(left)).values())
    assert counts["left_only"] - counts["right_only"] == len(left) - len(right)
    assert counts["left_only"] == ours.exceptAll(theirs).count()


def test_limit_in_a_subquery(spark, one):
    spark.range(20).toDF("a").createOrReplaceTempView("gate_subquery")
    loose = spark.sql("SELECT a FROM gate_subquery WHERE a IN (SELECT a FROM gate_subquery LIMIT 3)")
    fixed = spark.sql("SELECT a FROM gate_subquery WHERE a IN (SELECT a FROM gate_subquery ORDER BY a LIMIT 3)")
    assert one(d.verify_equivalent(loose, loose))["verdict"] == "indeterminate"
    assert one(d.verify_equivalent(fixed, fixed))["verdict"] == "correct"


def test_a_plan_that_is_not_shown_proves_nothing():
    class Remote:
        """A frame of a session without plans."""

    assert "does not show" in d.stability_gate(Remote())


def test_only_digests_are_shuffled(spark, one):
    wide = spark.range(100).select(F.repeat(F.lit("x"), 500).alias("text"), "id", F.current_timestamp().alias("t"))
    plan = d.diff_counts(wide, wide)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and all("d0" in line and "d3" in line and "c0" not in line for line in exchanges)
    assert one(d.diff_counts(wide, wide))["differing_rows"] == 0


def test_digests_tell_rows_apart(spark, one):
    """NULLs in different places, values that shift between columns, nested values that flatten to the same."""
    pairs = [
        ("1 AS a, CAST(NULL AS INT) AS b", "CAST(NULL AS INT) AS a, 1 AS b"),
        ("'ab' AS a, 'c' AS b", "'a' AS a, 'bc' AS b"),
        ("array(array(1), array(2)) AS a", "array(array(1, 2)) AS a"),
        ("array(CAST(NULL AS INT), 1) AS a", "array(1, CAST(NULL AS INT)) AS a"),
        ("array() AS a", "CAST(NULL AS ARRAY<VOID>) AS a"),
        ("CAST(0 AS DOUBLE) AS a, true AS b", "CAST(0 AS DOUBLE) AS a, false AS b"),
        ("X'00' AS a", "X'' AS a"), ("1.10 AS a", "1.11 AS a"),
    ]
    for left, right in pairs:
        left, right = spark.sql(f"SELECT {left}"), spark.sql(f"SELECT {right}")
        assert one(d.diff_counts(left, right))["differing_rows"] == 2 and one(d.diff_counts(left, left))["differing_rows"] == 0
        assert d.diff_sample(left, right).count() == 2


def test_sample_fetches_nested_rows(spark, rows):
    left = spark.sql("SELECT explode(sequence(1, 6)) AS k").selectExpr("k % 3 AS k", "array(k % 3, NULL) AS a", "named_struct('x', -0.0D) AS s")
    right = left.where("k > 0").selectExpr("k", "a", "named_struct('x', 0.0D) AS s")
    assert [row["k"] for row in rows(d.diff_sample(left, right))] == [0, 0]
