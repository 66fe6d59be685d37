"""What the footers of Parquet files state: rows, bytes, value ranges, codecs. No data page is read.

The names of the files come from the file index that Spark has listed anyway; tasks open each file at its end. A
frame that is more than the rows of Parquet files, or a store that tasks cannot open, gives None, and callers scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ByteType, DataType, DateType, DecimalType, IntegerType, LongType, ShortType

from dataproof.spec import as_column

#: Types whose bounds in a footer are exact: no truncation, no NaN, no time zone.
EXACT = (ByteType, ShortType, IntegerType, LongType, DateType, DecimalType)
#: Files that one task opens.
FILES_EACH = 64
#: More files than this are scanned with the whole table instead of by name.
MOST_NAMED = 1000

_TRANSPARENT = {"SubqueryAlias", "View"}


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _relation(df: DataFrame):
    """The file relation that a frame shows as it is, perhaps with fewer columns; else None."""
    if not hasattr(df, "_jdf"):
        return None
    plan = df._jdf.queryExecution().analyzed()
    while True:
        kind = _kind(plan)
        if kind == "LogicalRelation":
            relation = plan.relation()
            plain = _kind(relation) == "HadoopFsRelation" and _kind(relation.fileFormat()) == "ParquetFileFormat"
            return relation if plain else None
        if kind == "Project":
            columns = plan.projectList()
            if any(_kind(columns.apply(k)) != "AttributeReference" for k in range(columns.size())):
                return None
        elif kind not in _TRANSPARENT:
            return None
        plan = plan.children().apply(0)


def data_files(df: DataFrame) -> list[str] | None:
    """The files whose rows the frame is, or None if it is anything else or tasks could not open them."""
    if _relation(df) is None:
        return None
    # Named as ``_metadata.file_path`` names them.
    files = [re.sub("^file:/+", "file:/", path) for path in df.inputFiles()]
    try:
        for path in files[:1]:
            _open(path)
    except Exception:  # noqa: BLE001 - whatever the store says, a scan can still read it
        return None
    return files


def _open(path: str) -> tuple[pq.FileMetaData, int]:
    if path.startswith("file:"):
        store, name = fs.LocalFileSystem(), unquote(path.removeprefix("file:"))
    else:
        store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        return pq.ParquetFile(file).metadata, file.size()


def _ranges(footer: pq.FileMetaData, name: str) -> tuple[object, object, int, bool]:
    """Least and greatest value, NULLs, and whether the footer states them, of one column. A missing column is all NULL."""
    place = next((k for k in range(footer.num_columns) if footer.schema.column(k).path == name), None)
    if place is None:
        return None, None, footer.num_rows, True
    low = high = None
    nulls = 0
    for group in range(footer.num_row_groups):
        stats = footer.row_group(group).column(place).statistics
        if stats is None or not stats.has_null_count:
            return None, None, 0, False
        nulls += stats.null_count
        if stats.has_min_max:
            low = stats.min if low is None else min(low, stats.min)
            high = stats.max if high is None else max(high, stats.max)
        elif stats.null_count < footer.row_group(group).num_rows:
            return None, None, 0, False
    return low, high, nulls, True


def _names(df: DataFrame, files: Sequence[str]) -> DataFrame:
    spark = df.sparkSession
    tasks = max(1, -(-len(files) // FILES_EACH))
    return spark.createDataFrame([(path,) for path in files], "part string").repartition(tasks, F.xxhash64("part"))


def file_footers(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame | None:
    """One row per data file: part (its path), bytes, rows and, for each column, ``low_``, ``high_``, ``nulls_`` and ``known_``."""
    files = data_files(df)
    kinds: dict[str, DataType] = {name: df.schema[name].dataType for name in columns}
    if files is None or not all(isinstance(kind, EXACT) for kind in kinds.values()):
        return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).to_pylist()
            footers = [_open(path) for path in parts]
            arrays = [batch.column(0), pa.array([size for _, size in footers], pa.int64()), pa.array([f.num_rows for f, _ in footers], pa.int64())]
            names = ["part", "bytes", "rows"]
            for name, kind in kinds.items():
                found = list(zip(*[_ranges(footer, name) for footer, _ in footers], strict=True)) or [[]] * 4
                of = to_arrow_type(kind)
                arrays += [pa.array(values, at) for values, at in zip(found, (of, of, pa.int64(), pa.bool_()), strict=True)]
                names += [f"low_{name}", f"high_{name}", f"nulls_{name}", f"known_{name}"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    bounds = [f"`low_{n}` {k.simpleString()}, `high_{n}` {k.simpleString()}, `nulls_{n}` long, `known_{n}` boolean" for n, k in kinds.items()]
    return _names(df, files).mapInArrow(read, ", ".join(["part string, bytes long, rows long", *bounds]))


def column_chunks(df: DataFrame) -> DataFrame | None:
    """One row per column: codecs, stored and plain bytes, summed over the column chunks of all files."""
    files = data_files(df)
    if files is None:
        return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                footer, _ = _open(path)
                for group in range(footer.num_row_groups):
                    chunks = [footer.row_group(group).column(k) for k in range(footer.num_columns)]
                    found += [(c.path_in_schema.split(".")[0], c.compression, c.total_compressed_size, c.total_uncompressed_size) for c in chunks]
            values = zip(*found, strict=True) if found else [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["name", "codec", "stored_bytes", "plain_bytes"]
            )

    chunks = _names(df, files).mapInArrow(read, "name string, codec string, stored_bytes long, plain_bytes long")
    return chunks.groupBy("name").agg(
        F.array_join(F.array_sort(F.collect_set("codec")), ", ").alias("codec"),
        F.sum("stored_bytes").alias("stored_bytes"), F.sum("plain_bytes").alias("plain_bytes"),
    )


def _referenced(df: DataFrame, expression: Column) -> list[str] | None:
    """The columns an expression reads, or None if it is not a plain function of columns of the frame."""
    try:
        selected = df.select(expression)._jdf.queryExecution().analyzed().projectList().apply(0)
    except AnalysisException:
        return None
    names = selected.references().toSeq()
    found = [names.apply(k).name() for k in range(names.size())]
    return found if selected.deterministic() and all(name in df.columns for name in found) else None


def _from_path(part: Column, name: str, kind: DataType) -> Column:
    """A partition column's value, as the directory names state it: escaped as a name, then as a part of a path."""
    text = F.regexp_extract(part, f"/{name}=([^/]*)/", 1)
    for _ in range(2):
        text = F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(text != "__HIVE_DEFAULT_PARTITION__", text).cast(kind)


def file_units(df: DataFrame, partition: Column | str | None = None, columns: Sequence[str] = ()) -> DataFrame | None:
    """partition, part, rows, bytes and ``min_``/``max_`` of columns for each data file and partition; None if only a scan can tell.

    A file's partition is known if the expression reads only directory columns and columns that hold one
    value in the file. Files of several partitions, or without the bounds asked for, are scanned alone.
    """
    relation = _relation(df)
    if relation is None:
        return None
    expression = as_column(partition) if partition is not None else F.lit("all")
    referenced = _referenced(df, expression)
    if referenced is None:
        return None
    by_path = [name for name in relation.partitionSchema().fieldNames() if name in df.columns]
    inside = [name for name in dict.fromkeys([*referenced, *columns]) if name not in by_path]
    footers = file_footers(df, inside)
    if footers is None or any(name in by_path for name in columns):
        return None
    for name in by_path:
        footers = footers.withColumn(name, _from_path(F.col("part"), name, df.schema[name].dataType))
    stated = F.lit(True)
    for name in inside:
        low, high, nulls, known = (F.col(f"`{x}_{name}`") for x in ("low", "high", "nulls", "known"))
        stated = stated & known
        if name in referenced:
            stated = stated & ((nulls == F.col("rows")) | ((nulls == 0) & (low == high)))
        footers = footers.withColumn(name, low)
    try:
        units = footers.where(F.col("rows") > 0).select(
            expression.alias("partition"), "part", "rows", "bytes", F.coalesce(stated, F.lit(False)).alias("stated"),
            *[F.col(f"`{bound}_{name}`").alias(f"{short}_{name}") for name in columns for bound, short in (("low", "min"), ("high", "max"))],
        )
    except AnalysisException:
        return None
    known = units.where("stated").drop("stated")
    if not inside:
        return known
    others = [row["part"] for row in units.where("not stated").select("part").limit(MOST_NAMED + 1).collect()]
    if not others:
        return known
    scanned = df if len(others) > MOST_NAMED else df.where(F.col("_metadata.file_path").isin(others))
    found = scan_units(scanned, expression, columns)
    return found if len(others) > MOST_NAMED else known.unionByName(found)


def scan_units(
    df: DataFrame, partition: Column, columns: Sequence[str] = (), part: Column | None = None, size: Column | None = None
) -> DataFrame:
    """The same from one scan of the partition's and the given columns."""
    part = F.col("_metadata.file_path") if part is None else part
    size = F.col("_metadata.file_size") if size is None else size
    bounds = [f(name).alias(f"{short}_{name}") for name in columns for f, short in ((F.min, "min"), (F.max, "max"))]
    return (
        df.select(partition.alias("partition"), part.alias("part"), size.alias("size"), *columns)
        .groupBy("partition", "part")
        .agg(F.count("*").alias("rows"), F.max("size").cast("bigint").alias("bytes"), *bounds)
    )
