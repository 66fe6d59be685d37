"""Statistics from footers: equal to a scan, and no data is read."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import dataproof as d
from dataproof.sources import footers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df, partition="'all'", columns=()):
    return sorted(map(tuple, footers.scan_units(df, F.expr(partition), columns).select("partition", "part", "rows", "bytes", *[
        f"{bound}_{name}" for name in columns for bound in ("min", "max")
    ]).collect()), key=repr)


def units(df, partition=None, columns=()):
    found = footers.file_units(df, partition, columns)
    return found, sorted(map(tuple, found.select("partition", "part", "rows", "bytes", *[
        f"{bound}_{name}" for name in columns for bound in ("min", "max")
    ]).collect()), key=repr)


@pytest.fixture
def stored(spark, tmp_path):
    """Four files, in row groups of few rows, one column all NULL in one of them."""
    path = str(tmp_path / "some table")
    rows = spark.range(400).select(
        "id", F.expr("cast(id div 100 as int)").alias("k"), F.expr("date_add(date'2024-01-30', cast(id div 150 as int))").alias("day"),
        F.expr("cast(id / 3 as decimal(12,4))").alias("amount"), F.when(F.col("id") >= 100, F.col("id") % 7).alias("maybe"), F.col("id").cast("string").alias("text"),
    )
    rows.repartitionByRange(4, "id").sortWithinPartitions("id").write.option("parquet.block.size", "2048").parquet(path)
    return spark.read.parquet(path)


def test_no_data_is_read(stored):
    for df in (d.parts_summary(stored), d.partition_stats(stored, "k"), d.part_stats(stored, ["id", "day", "amount", "maybe"], "k * 2"),
               d.scan_guard(d.parts_summary(stored)), d.column_profile(stored)):
        assert "FileScan" not in plan(df) and df.count()


def test_equal_to_a_scan(stored):
    columns = ["id", "day", "amount", "maybe"]
    for partition in ("k", "k + 1", "concat('k', k)"):
        found, got = units(stored, partition, columns)
        assert got == scanned(stored, partition, columns) and len(got) == 4
    assert units(stored, None, columns)[1] == scanned(stored, "'all'", columns)
    narrow = stored.select("k", "id")
    assert units(narrow, "k", ["id"])[1] == scanned(narrow, "k", ["id"])


def test_mixed_files_are_scanned_alone(stored):
    found, got = units(stored, "day", ["id"])
    assert got == scanned(stored, "day", ["id"]) and len(got) == 5
    files = found.inputFiles()
    assert "FileScan" in plan(found) and len(stored.inputFiles()) == 4
    # Three of the four files hold one day; only the other one may be opened.
    metrics = [line for line in plan(found).split("\n") if "FileScan" in line]
    assert len(metrics) == 1 and "file_path" in metrics[0] and files


def test_directories_and_missing_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (3, "x=y", 7)], "id long, kind string, n int")
    rows.write.partitionBy("kind").parquet(path)
    spark.createDataFrame([(9,)], "id long").write.mode("append").parquet(path + "/kind=new")
    df = spark.read.schema("id long, n int, kind string").parquet(path)
    found, got = units(df, "kind", ["n"])
    assert got == scanned(df, "kind", ["n"]) and "FileScan" not in plan(found)
    assert {row[0] for row in got} == {"a b", None, "x=y", "new"}


def test_what_only_a_scan_can_tell(spark, stored):
    assert footers.file_units(stored.where("k = 1")) is None
    assert footers.file_units(stored.select((F.col("id") + 1).alias("id"))) is None
    assert footers.file_units(spark.range(3)) is None
    assert footers.file_units(stored, None, ["text"]) is None
    assert footers.file_units(stored, "rand()") is None
    assert footers.file_units(stored, F.rand()) is None
    assert {r["partition"] for r in d.partition_stats(stored, "length(text)").collect()} == {1, 2, 3}
    assert d.column_profile(spark.range(3)).first()["codec"] is None


def test_types_without_exact_bounds(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select 1.5D as x, timestamp'2024-01-01 00:00:00' as t, true as b").write.parquet(path)
    df = spark.read.parquet(path)
    for name in ("x", "t", "b"):
        assert footers.file_units(df, None, [name]) is None
        assert d.part_stats(df, [name]).first()["rows"] == 1


def test_empty_files_count_no_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0).write.parquet(path)
    df = spark.read.parquet(path)
    summary = d.parts_summary(df).first()
    assert (summary["active_parts"], summary["rows"], summary["partitions"]) == (0, 0, 0)
    assert d.parts_summary(df, "id % 2").first()["rows"] == 0


def test_codec_and_bytes(spark, stored, rows):
    found = {row["name"]: row for row in rows(d.column_profile(stored))}
    files = [pq.read_metadata(path.replace("file://", "").replace("%20", " ")) for path in stored.inputFiles()]
    for place, name in enumerate(stored.columns):
        chunks = [f.row_group(g).column(place) for f in files for g in range(f.num_row_groups)]
        assert found[name]["codec"] == "SNAPPY" and found[name]["stored_bytes"] == sum(c.total_compressed_size for c in chunks)
        assert found[name]["plain_bytes"] == sum(c.total_uncompressed_size for c in chunks)


def test_values(stored, one):
    stats = d.part_stats(stored, ["day", "amount", "maybe"], "k").where("partition = 0")
    row = one(stats)
    assert (row["min_day"], row["max_day"]) == (datetime.date(2024, 1, 30),) * 2
    assert row["max_amount"] == Decimal("33.0000") and row["min_maybe"] is None
