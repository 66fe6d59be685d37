"""Hard negatives for contrastive training, mined by a secondary-sort shuffle.

Every score of an anchor is a record whose packed key holds the anchor, the descending score and the id.
Records are dealt out by anchor and sorted by key within partitions, so a task reads each anchor's
scores from the highest down. A positive opens a window of scores; a negative is given for every open window
that it lies in. The task holds the few open windows and nothing else of an anchor.

Tasks hand over only records that can decide: of positives the first few of each task, of negatives the
first few of each task in each window. What a task leaves out stands behind enough of its own records.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataproof.sources.shared import drop_folder, keep_table, new_folder

#: Most anchors, and most bytes of their vectors, that the tasks are sent at once.
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20
#: Components of this size or more would lose digits in a sum of products.
LARGEST = 1 << 53

#: A record's key, in the order in which it is sorted. Numbers are stored so that bytes compare as they do.
KEY = np.dtype([("anchor", ">u8"), ("number", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8"), ("other", "u1")])
POSITIVE, NEGATIVE = 0, 1
_SIGN = np.uint64(1 << 63)


@dataclass(frozen=True)
class Mining:
    """How many of which: the first ``positives`` of the anchor's label; for each of them the first ``negatives`` of other labels
    whose score is between ``low`` and ``high`` percent of the positive's."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95

    def __post_init__(self):
        if not 0 <= self.low <= self.high <= 100:
            raise ValueError("a window lies between 0 and 100 percent of the positive's score")


def _ordered(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64).view(np.uint64) ^ _SIGN


def pack(anchor, number, score, kind, ids, other) -> pa.Array:
    """Packed keys of records."""
    rows = np.zeros(len(ids), dtype=KEY)
    rows["anchor"], rows["number"], rows["score"] = _ordered(anchor), number, ~_ordered(score)
    rows["kind"], rows["id"], rows["other"] = kind, _ordered(ids), other
    raw = rows.tobytes()
    return pa.array([raw[k:k + KEY.itemsize] for k in range(0, len(raw), KEY.itemsize)], pa.binary())


def unpacked(keys: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
    """(anchor, number, score, kind, id, other) of every key."""
    rows = np.frombuffer(b"".join(keys.to_pylist()), dtype=KEY)
    signed = [(x.astype(np.uint64) ^ _SIGN).view(np.int64) for x in (rows["anchor"], ~rows["score"].astype(np.uint64), rows["id"])]
    anchor, score, ids = (x.tolist() for x in signed)
    return list(zip(anchor, rows["number"].tolist(), score, rows["kind"].tolist(), ids, rows["other"].tolist(), strict=True))


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector that occurs in a column of integer lists."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, flat[starts[rows][:, None] + np.arange(length)]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; exact, or an OverflowError if one leaves 64 bits."""
    most = [max((abs(int(f(x))) for f in (np.min, np.max)), default=0) if x.size else 0 for x in (left, right)]
    if max(most) >= LARGEST:
        raise OverflowError("a component is too large for exact scores")
    if most[0] * most[1] * max(1, left.shape[1]) < LARGEST:
        return np.rint(left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    found = left.astype(object) @ right.astype(object).T
    if any(not -(1 << 63) <= x < 1 << 63 for x in found.flat):
        raise OverflowError("a score leaves 64 bits")
    return found.astype(np.int64)


def first_of(score: np.ndarray, ids: np.ndarray, other: np.ndarray, many: int) -> np.ndarray:
    """Places of the first ``many`` by descending score, then ascending id, then ``other``."""
    places = np.arange(len(score))
    if len(score) > many:
        places = np.flatnonzero(score >= np.partition(score, len(score) - many)[len(score) - many])
    return places[np.lexsort((other[places], ids[places], ~score[places]))[:many]]


@dataclass
class Block:
    """A bounded number of anchors: ids, numbers of their rows, labels, vectors and, once known, scores of their positives."""

    ids: np.ndarray
    numbers: np.ndarray
    labels: np.ndarray
    matrices: list[tuple[np.ndarray, np.ndarray]]
    scores: dict[int, list[int]]


def _scored(batch: pa.RecordBatch, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, scores, ids, whether the label is the anchor's, whether the row equals the anchor's) for a batch of rows."""
    ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    for rows, matrix in vectors(batch.column(2)):
        for anchors, own in block.matrices:
            if own.shape[1] != matrix.shape[1]:
                continue
            scores = products(own, matrix)
            for at, anchor in enumerate(anchors):
                same = labels[rows] == block.labels[anchor]
                equal = same & (ids[rows] == block.ids[anchor])
                equal[equal] = (matrix[equal] == own[at]).all(axis=1)
                yield int(anchor), scores[at], ids[rows], same, equal


class _Best:
    """The first few records of each list seen so far."""

    def __init__(self, many: int):
        self.many, self.held = many, {}

    def add(self, name, *record: np.ndarray) -> None:
        """Scores, ids and whether each is not the anchor's own row."""
        if name in self.held:
            record = tuple(np.concatenate(x) for x in zip(self.held[name], record, strict=True))
        places = first_of(*record, self.many)
        self.held[name] = tuple(x[places] for x in record)


def _records(block: Block, anchor: int, kind: int, score: np.ndarray, ids: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    owner = np.full(len(ids), block.ids[anchor]), np.full(len(ids), block.numbers[anchor])
    return pa.RecordBatch.from_arrays([pack(*owner, score, kind, ids, other)], names=["key"])


def _united(lists: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The records of overlapping lists, each as often as the list has it that has it most often."""
    often: Counter = Counter()
    for score, ids, _ in lists:
        often |= Counter(zip(score.tolist(), ids.tolist(), strict=True))
    found = np.array(list(often.elements()), dtype=np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1], np.ones(len(found), dtype=np.uint8)


def _gathered(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held, rows = [], 0
    for record in records:
        held.append(record)
        rows += record.num_rows
        if rows >= 1 << 16:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def secondary_sort(records: DataFrame) -> DataFrame:
    """The records dealt out by anchor and sorted by key within partitions."""
    return records.repartition(F.substring("key", 1, 16)).sortWithinPartitions("key")


def anchors_positives(keys: Iterator[pa.Array], many: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, number, score, id) of every anchor's first positives, read from sorted records; its own row is passed over once."""
    current, own, found = None, False, 0
    for batch in keys:
        for anchor, number, score, _, ids, other in unpacked(batch):
            if (anchor, number) != current:
                current, own, found = (anchor, number), False, 0
            if not other and not own:
                own = True
            elif found < many:
                found += 1
                yield anchor, number, score, ids


def windows(keys: Iterator[pa.Array], rule: Mining) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, score of the positive, of the negative), read from sorted records."""
    current, opened = None, []
    for batch in keys:
        for anchor, number, score, kind, ids, _ in unpacked(batch):
            if (anchor, number) != current:
                current, opened = (anchor, number), []
            if kind == POSITIVE:
                opened.append([score, ids, 0])
                continue
            for window in opened:
                if window[2] < rule.negatives and rule.low * window[0] <= 100 * score <= rule.high * window[0]:
                    window[2] += 1
                    yield anchor, window[1], window[2], ids, window[0], score
            opened = [w for w in opened if w[2] < rule.negatives and rule.low * w[0] <= 100 * score]


def hard_negatives(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = 256, rule: Mining = Mining(),
) -> DataFrame:
    """For every anchor and each of its first positives, the first negatives in the positive's window.

    ``anchors`` tells which rows are anchors. Components x become floor(scale * x); a score is the integer inner
    product. Higher scores come first, ties by smaller id. Result: anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.

    Rows with a NULL id, label or vector, or with a NULL, NaN or infinite component, take no part. Vectors of
    different lengths have no score with each other. Every row is a row of its own: a repeated anchor row gives
    its result again, and its twins are positives of it. An empty table, or one without anchors, gives an empty
    result. Columns of other names are not read, so they cannot clash. Scores beyond 64 bits raise OverflowError.

    Anchors go to the tasks in blocks of a fixed size; all rows are read twice for each block, once for positives
    and once for negatives. The driver sees the anchors of one block and the scores of their positives.
    """
    spark = df.sparkSession
    vector = F.transform(df[vector_col], lambda x: x.cast("double"))
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows, rows_path = keep_table(
        df.select(df[id_col].cast("long").alias("id"), df[label_col].cast("long").alias("label"), vector.alias("vector"), anchors.alias("anchor"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & usable)
        .select("id", "label", F.transform("vector", lambda x: F.floor(x * scale)).alias("vector"), "anchor"),
        "vectors",
    )
    chosen = rows.where("anchor").select("id", "label", "vector")
    size = chosen.agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("longest")).first()
    block_rows = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(1, size["longest"] or 1))))
    numbered, numbered_path = keep_table(
        chosen.repartition(max(1, -(-size["rows"] // block_rows))).select(F.monotonically_increasing_id().alias("number"), "*"), "anchors"
    )
    part, place = F.shiftright("number", 33), F.expr(f"(number & {(1 << 33) - 1}) div {block_rows}")
    blocks = numbered.select(part.alias("part"), place.alias("place")).distinct().collect()
    folder = new_folder(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    for block in sorted((b["part"], b["place"]) for b in blocks):
        rows_of = numbered.where((part == block[0]) & (place == block[1])).toArrow()
        _mine(rows.select("id", "label", "vector"), rows_of, rule, schema).write.mode("append").parquet(folder)
    for path in (rows_path, numbered_path):
        drop_folder(spark, path)
    return spark.read.schema(schema).parquet(folder)


def _mine(rows: DataFrame, chosen: pa.Table, rule: Mining, schema: str) -> DataFrame:
    """The result for one block of anchors."""
    context = rows.sparkSession.sparkContext
    chosen = chosen.combine_chunks()
    number, ids, labels = (chosen.column(c).to_numpy() for c in ("number", "id", "label"))
    block = Block(ids, number, labels, list(vectors(chosen.column("vector").combine_chunks())), {})
    sent = context.broadcast(block)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(rule.positives + 1)
        for batch in batches:
            for anchor, score, ids, same, equal in _scored(batch, sent.value):
                best.add(anchor, score[same], ids[same], (~equal[same]).astype(np.uint8))
        yield from _gathered(_records(sent.value, anchor, POSITIVE, *record) for anchor, record in best.held.items())

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(anchors_positives((batch.column(0) for batch in batches), rule.positives))
        anchor, number, score, ids = (np.array([row[k] for row in found], dtype=np.int64) for k in range(4))
        yield pa.RecordBatch.from_arrays(
            [pack(anchor, number, score, POSITIVE, ids, 1), pa.array(number), pa.array(score)], names=["key", "number", "score"]
        )

    kept, path = keep_table(
        secondary_sort(rows.mapInArrow(near, "key binary")).mapInArrow(firsts, "key binary, number long, score long"), "positives"
    )
    place = {int(x): k for k, x in enumerate(number)}
    scores: dict[int, list[int]] = {}
    for row in kept.select("number", "score").distinct().collect():
        scores.setdefault(place[row["number"]], []).append(row["score"])
    known = context.broadcast(Block(ids, number, labels, block.matrices, scores))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(rule.negatives)
        for batch in batches:
            for anchor, score, ids, same, _ in _scored(batch, known.value):
                for positive in known.value.scores.get(anchor, ()):
                    # Bounds as integers, so that no product of a score can leave 64 bits.
                    inside = (score >= -(-rule.low * positive // 100)) & (score <= rule.high * positive // 100) & ~same
                    if inside.any():
                        best.add((anchor, positive), score[inside], ids[inside], np.ones(int(inside.sum()), dtype=np.uint8))
        # A reader gives a record to every window that it lies in, so it goes out once.
        lists: dict[int, list] = {}
        for (anchor, _), record in best.held.items():
            lists.setdefault(anchor, []).append(record)
        yield from _gathered(_records(known.value, anchor, NEGATIVE, *_united(found)) for anchor, found in lists.items())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array([row[k] for row in found], pa.int32() if k == 2 else pa.int64()) for k in range(6)]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

        for row in windows((batch.column(0) for batch in batches), rule):
            found.append(row)
            if len(found) >= 1 << 16:
                yield batch_of()
                found.clear()
        yield batch_of()

    records = kept.select("key").union(rows.mapInArrow(far, "key binary"))
    return secondary_sort(records).mapInArrow(emit, schema)
