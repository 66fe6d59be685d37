"""Token ids as flat binary files that training jobs map into memory.

A folder holds ``part-NNNNN.ids`` (unsigned integers, one after another), ``.offsets`` (64-bit, where
each document starts in its part, then the part's end), ``.docs`` (64-bit document ids) and
``index.json`` (integer type, end id and, for each part, documents, ids, and the ids before it).
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataproof.llm.pieces import PieceEncoder

#: Bytes of ids handed back at a time.
BYTES_AT_ONCE = 1 << 22


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_token_files(
    df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> dict:
    """Encode every whole text, end it with ``end_id`` and write the ids in ascending order of ids.

    Returns the index. Rows are dealt out by ranges of (id, text), so parts follow each other in
    order and one part is all that a task holds open; ids stream to the file batch by batch. A
    part appears by renaming when complete, so a task that runs again leaves the same file. The
    driver adds up one count for each part, never for each document.

    NULL and empty texts are documents of the end id alone. NULL ids come first. Rows with the same
    id follow each other by text; identical rows are written as often as they occur. An empty table
    gives an index without parts. The integers are 16-bit if the vocabulary and end id fit, else 32-bit.
    """
    size = max(PieceEncoder.load(tokenizer).size, end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    store(folder)[0].create_dir(store(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.load(tokenizer)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        where, base = store(folder)
        name = f"part-{part:05d}"
        kinds = ("ids", "offsets", "docs")
        temporary = {k: f"{base}/.{name}.{k}.{attempt}" for k in kinds}
        out = None
        written = documents = nulls = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = {k: where.open_output_stream(path) for k, path in temporary.items()}
                out["offsets"].write(np.zeros(1, dtype="<i8").tobytes())
            for ids, lengths in encoder.encoded(batch.column(1), end_id):
                out["ids"].write(ids.astype(kind, copy=False).data)
                out["offsets"].write((written + np.cumsum(lengths)).astype("<i8").tobytes())
                written += len(ids)
            doc_ids = batch.column(0).cast(pa.int64())
            nulls += doc_ids.null_count
            out["docs"].write(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            documents += batch.num_rows
        if out is None:
            return
        for k in kinds:
            out[k].close()
            where.move(temporary[k], f"{base}/{name}.{k}")
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "documents": [documents], "ids": [written], "null_ids": [nulls]}
        )

    order = [F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    parts = (
        df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
        .repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(*order)
        .mapInArrow(write, "part long, documents long, ids long, null_ids long")
        .collect()
    )
    parts = sorted((row.asDict() for row in parts), key=lambda part: part["part"])
    bases = itertools.accumulate((part["ids"] for part in parts), initial=0)
    index = {"type": kind, "end_id": end_id, "parts": [part | {"base": base} for part, base in zip(parts, bases)]}
    where, base = store(folder)
    with where.open_output_stream(str(PurePosixPath(base) / "index.json")) as out:
        out.write(json.dumps(index).encode())
    return index


def open_numbers(where: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The integers of a file: mapped where the store is a local or mounted one, else read."""
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if where.get_file_info(path).size else np.zeros(0, dtype=kind)
    with where.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype=kind)


def read_index(folder: str) -> dict:
    where, base = store(folder)
    with where.open_input_file(f"{base}/index.json") as file:
        return json.loads(file.read())


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files: its id, ``start`` (ids before it), ``n_tokens``, ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers. Every part is a task of its own.
    """
    count = len(read_index(folder)["parts"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = store(folder)
        index = None
        for batch in batches:
            for number in batch.column(0).to_pylist():
                index = index or read_index(folder)
                part = index["parts"][number]
                name = f"{base}/part-{part['part']:05d}"
                ids = open_numbers(where, f"{name}.ids", index["type"])
                offsets = np.asarray(open_numbers(where, f"{name}.offsets", "<i8"))
                docs = np.asarray(open_numbers(where, f"{name}.docs", "<i8"))
                first = 0
                while first < len(docs):
                    end = int(np.searchsorted(offsets, offsets[first] + BYTES_AT_ONCE // 4, side="right")) - 1
                    end = min(max(end, first + 1), len(docs))
                    cut = offsets[first:end + 1]
                    block = np.asarray(ids[cut[0]:cut[-1]]).astype("<u4")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[first:end], mask=np.arange(first, end) < part["null_ids"]),
                            pa.array(cut[:-1] + part["base"]),
                            pa.array(np.diff(cut)),
                            pa.array([block[a:b].tobytes() for a, b in itertools.pairwise(cut - cut[0])], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    first = end

    return spark.range(0, count, 1, max(1, count)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
