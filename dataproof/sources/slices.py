"""Slices on shared storage: one complete partition as Parquet, with a JSON manifest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataproof.operators.uniqueness import scope_partition
from dataproof.spec import TableSpec

# Kinds of columns that are computed, not stored.
COMPUTED_KINDS = {"ALIAS", "MATERIALIZED", "EPHEMERAL"}

MANIFEST_SCHEMA = (
    "version INT, createdAt STRING, engine STRING, "
    "source STRUCT<table: STRING, partitionId: STRING, rows: BIGINT, bytesOnDisk: BIGINT>, "
    "local STRUCT<table: STRING, createStatement: STRING, dataFile: STRING, dataBytes: BIGINT>, "
    "proof STRUCT<sourceDuplicateRows: BIGINT, localDuplicateRows: BIGINT, matched: BOOLEAN>, "
    "_corrupt_record STRING"
)


def stored_columns(df: DataFrame, spec: TableSpec) -> list[str]:
    """Columns that can be written: computed ones are left out."""
    columns = [
        name
        for name in df.columns
        if spec.generated.get(name, ("", ""))[0].upper() not in COMPUTED_KINDS
    ]
    if not columns:
        raise ValueError(f"{spec.name} has no stored columns to copy")
    return columns


def slice_rows(df: DataFrame, spec: TableSpec, partition: str) -> DataFrame:
    """The stored columns of one whole partition."""
    scope = df
    if spec.partition is not None:
        value = F.expr(spec.partition) if isinstance(spec.partition, str) else spec.partition
        scope = scope_partition(df, value.cast("string"), partition)
    return scope.select(*stored_columns(df, spec))


def extract_slice(df: DataFrame, spec: TableSpec, partition: str, path: str) -> str:
    """Writes one partition to ``path/data.parquet``; an existing slice is never replaced."""
    target = f"{path.rstrip('/')}/data.parquet"
    slice_rows(df, spec, partition).write.mode("error").parquet(target)
    return target


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row: bytes of all files below a folder, from file listings alone."""
    if not _exists(spark, path):
        return spark.createDataFrame([(0,)], "bytes BIGINT")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def write_manifest(
    proof: DataFrame,
    stats: DataFrame,
    spec: TableSpec,
    partition: str,
    path: str,
    created_at: str | Column,
    data_bytes: int,
    ddl: str = "",
) -> str:
    """Writes the manifest row of a slice: where it came from and what was proven.

    ``proof`` is a ``slice_proof`` row and ``stats`` the ``slice_budget`` row of the
    partition. The manifest is written last, so a slice without one is incomplete.
    """
    created = F.lit(created_at) if isinstance(created_at, str) else created_at
    chosen = stats.select("rows", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
    empty = F.lit(None).cast("bigint")
    facts = (
        proof.select(
            "source_duplicate_rows", "slice_duplicate_rows", "matched",
            empty.alias("rows"), empty.alias("bytes"),
        )
        .unionByName(
            chosen.select(
                empty.alias("source_duplicate_rows"), empty.alias("slice_duplicate_rows"),
                F.lit(None).cast("boolean").alias("matched"), "rows", "bytes",
            )
        )
    )
    one = facts.agg(*[F.max(name).alias(name) for name in facts.columns])
    manifest = one.select(
        F.lit(1).alias("version"),
        created.cast("string").alias("createdAt"),
        F.lit("spark").alias("engine"),
        F.struct(
            F.lit(spec.name).alias("table"),
            F.lit(str(partition)).alias("partitionId"),
            "rows",
            F.col("bytes").alias("bytesOnDisk"),
        ).alias("source"),
        F.struct(
            F.lit(spec.bare_name).alias("table"),
            F.lit(ddl).alias("createStatement"),
            F.lit("data.parquet").alias("dataFile"),
            F.lit(data_bytes).cast("bigint").alias("dataBytes"),
        ).alias("local"),
        F.struct(
            F.col("source_duplicate_rows").alias("sourceDuplicateRows"),
            F.col("slice_duplicate_rows").alias("localDuplicateRows"),
            "matched",
        ).alias("proof"),
    )
    target = f"{path.rstrip('/')}/manifest.json"
    manifest.coalesce(1).write.mode("error").json(target)
    return target


def _complete(manifest: Mapping[str, str] | None = None) -> Column:
    required = [
        "createdAt", "engine", "source.table", "source.partitionId", "source.rows",
        "source.bytesOnDisk", "local.table", "local.createStatement", "local.dataFile",
        "local.dataBytes", "proof.sourceDuplicateRows", "proof.localDuplicateRows", "proof.matched",
    ]
    complete = F.col("_corrupt_record").isNull() & (F.col("version") == 1)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    return F.coalesce(complete & F.try_to_timestamp(F.col("createdAt")).isNotNull(), F.lit(False))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


CATALOG_SCHEMA = (
    "id STRING, state STRING, bytes BIGINT, created_at TIMESTAMP, "
    "source STRUCT<table: STRING, partitionId: STRING, rows: BIGINT, bytesOnDisk: BIGINT>, "
    "proof STRUCT<sourceDuplicateRows: BIGINT, localDuplicateRows: BIGINT, matched: BOOLEAN>"
)


def slice_catalog(spark: SparkSession, root: str) -> DataFrame:
    """All slices below a folder: ``valid``, ``corrupt`` or ``incomplete``, newest first.

    Slices lie in ``root/slice-*``. Sizes come from file listings; a slice without a
    manifest is incomplete, and one whose manifest does not fit the schema corrupt. A
    folder that does not exist yet has no slices.
    """
    if not _exists(spark, root):
        return spark.createDataFrame([], CATALOG_SCHEMA)
    slice_id = F.regexp_extract(F.col("file"), r"/(slice-[^/]*)/", 1)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(F.col("path").alias("file"), F.col("length"), F.col("modificationTime"))
        .withColumn("id", slice_id)
        .filter("id <> ''")
    )
    sizes = files.groupBy("id").agg(
        F.sum("length").alias("bytes"),
        F.max("modificationTime").alias("modified"),
        F.max(F.col("file").contains("/manifest.json")).alias("has_manifest"),
    )
    manifests = (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .json(root)
        .withColumn("file", F.col("_metadata.file_path"))
        .withColumn("id", slice_id)
        .filter(F.col("file").contains("/manifest.json"))
        .select("id", _complete().alias("valid"), "createdAt", "source", "proof")
    )
    per_slice = manifests.groupBy("id").agg(
        F.bool_and("valid").alias("valid"),
        F.max("createdAt").alias("createdAt"),
        F.max("source").alias("source"),
        F.max("proof").alias("proof"),
    )
    state = (
        F.when(F.coalesce("valid", F.lit(False)), "valid")
        .when(F.col("has_manifest"), "corrupt")
        .otherwise("incomplete")
    )
    created = F.coalesce(F.when(F.col("valid"), F.try_to_timestamp(F.col("createdAt"))), F.col("modified"))
    return (
        sizes.join(per_slice, "id", "left")
        .select(
            "id",
            state.alias("state"),
            "bytes",
            created.alias("created_at"),
            F.when(F.col("valid"), F.col("source")).alias("source"),
            F.when(F.col("valid"), F.col("proof")).alias("proof"),
        )
        .orderBy(F.desc("created_at"), "id")
    )
