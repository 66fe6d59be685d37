"""Removal of passages that repeat across documents: a count-min prefilter, then exact grouping.

Every run of ``window`` words is a window. A count-min sketch tells which may occur in a second document. It
counts, for each document, not all of its windows but their leads: the run of half as many words with the
smallest hash in the window. Equal windows have equal leads, so what the sketch says of the lead is never less
than the number of documents with the window, and neighbouring windows share leads, so far fewer cells are touched.
Each partition hands over the cells it touched; merged, they give one bit for each cell that was counted twice or
more. A second pass groups exactly those windows whose lead has that bit in every row of the sketch.

Grouping needs one record for each chunk of documents and window, with the smallest document of the chunk,
so a passage in a third of all documents costs a row for each chunk. The chunk is told which of its windows a
document with a smaller id has elsewhere, and does the rest by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataproof.llm.words import gathered, hash_spans, mix, text_bytes, word_spans
from dataproof.sources.shared import keep_table

#: Bytes of texts in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 22
#: Rows of the sketch, and the fewest and most cells of a row as powers of two. With the most, all bits take 64 MB.
SKETCH_ROWS, FEWEST_BITS, MOST_BITS = 2, 16, 28
#: Cells of a slice of the sketch, as a power of two: places in it take two bytes.
SLICE_BITS = 16
#: Touched cells that a task gathers before it hands them over.
CELLS_AT_ONCE = 1 << 22
#: Buckets of windows for each shuffle partition.
BUCKETS_EACH = 4

#: A window's name: 64 bits of one hash and 32 of another.
NAME = np.dtype([("a", "<u8"), ("b", "<u4")])

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, count: int) -> np.ndarray:
    if len(_powers.get(base, ())) < count:
        steps = np.full(max(count, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:count]


def run_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of so many words, by where it starts: differences of prefix sums, shifted back."""
    count = len(words) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = _BASES[which]
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words * _powers_of(base, len(words)), dtype=np.uint64)))
    return mix((sums[length:] - sums[:-length]) * _powers_of(pow(base, -1, 1 << 64), count), 40 + which)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return values if reach == width else np.minimum(values[:-(width - reach)], values[width - reach:])


class Windows:
    """All windows of some texts: their starts among the words, texts and leads."""

    def __init__(self, texts: pa.Array, window: int, use: np.ndarray):
        self.data, self.at = text_bytes(texts)
        self.begin, self.end, self.words = word_spans(self.data, self.at)
        self.hashes = hash_spans(self.data, self.begin, self.end)
        self.window = window
        text = np.repeat(np.arange(len(self.at) - 1), np.diff(self.words))
        starts = np.arange(max(0, len(text) - window + 1))
        inside = (text[:len(starts)] == text[window - 1:]) & use[text[:len(starts)]] if len(starts) else np.zeros(0, dtype=bool)
        self.start = starts[inside]
        self.text = text[self.start]
        run = (window + 1) // 2
        leads = run_hashes(self.hashes, run)
        self.lead = least_of(leads, window - run + 1)[self.start] if len(self.start) else leads[:0]

    def names(self, chosen: np.ndarray) -> np.ndarray:
        """Names of the chosen windows."""
        found = np.zeros(int(chosen.sum()), dtype=NAME)
        for key, which in (("a", 0), ("b", 1)):
            words = self.hashes if which == 0 else mix(self.hashes, 41)
            found[key] = (run_hashes(words, self.window, which)[self.start[chosen]] >> np.uint64(32 * which)) if len(found) else 0
        return found

    def cells(self, bits: int) -> np.ndarray:
        """A cell in each row of the sketch for every window; rows follow each other."""
        return np.stack([(mix(self.lead, 50 + row) >> np.uint64(64 - bits)) + np.uint64(row << bits) for row in range(SKETCH_ROWS)])


def _with_chunks(df: DataFrame) -> DataFrame:
    """The rows (id, text) with the chunk that each is in, and its bytes."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = np.diff(text_bytes(batch.column(1))[1])
            chunks = np.zeros(len(sizes), dtype=np.int64)
            for k, size in enumerate(sizes):
                if held and held + size > CHUNK_BYTES:
                    chunk, held = chunk + 1, 0
                held += size
                chunks[k] = chunk
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks), pa.array(sizes)], names=["id", "text", "chunk", "size"])

    return df.mapInArrow(number, "id long, text string, chunk long, size long")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of batches that lie in one chunk."""
    for batch in batches:
        chunks = batch.column(2).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], chunks[1:] != chunks[:-1]))) if len(chunks) else []
        for a, b in zip(starts, [*starts[1:], len(chunks)], strict=True):
            yield int(chunks[a]), batch.slice(a, b - a)


# --- the sketch -------------------------------------------------------------------------


def sketch_bits(size: int) -> int:
    """Cells of a row, as a power of two: about one for eight bytes of text, within the bounds."""
    return min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(max(1, size / 8)))))


def _touched(window: int, bits: int, slice_bits: int):
    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[np.ndarray] = []
        held = 0

        def handed() -> pa.RecordBatch:
            cell, times = np.unique(np.concatenate(cells), return_counts=True)
            part = cell >> np.uint64(slice_bits)
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            place = (cell & np.uint64((1 << slice_bits) - 1)).astype("<u2")
            rows = []
            for a, b in zip(starts, [*starts[1:], len(cell)], strict=True):
                again = times[a:b] > 1
                rows.append((int(part[a]), place[a:b][~again].tobytes(), place[a:b][again].tobytes()))
            number, once, more = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(once), pa.array(more)], names=["slice", "once", "more"])

        for _, part in _parts(batches):
            found = Windows(part.column(1), window, part.column(0).is_valid().to_numpy(zero_copy_only=False))
            if not len(found.lead):
                continue
            # A lead counts once for each document, wherever in it its windows are.
            change = np.concatenate(([True], (found.lead[1:] != found.lead[:-1]) | (found.text[1:] != found.text[:-1])))
            lead, text = found.lead[change], found.text[change].astype(np.uint64)
            _, one = np.unique(mix(lead ^ mix(text, 42)), return_index=True)
            found.lead = lead[one]
            cells.append(found.cells(bits).ravel())
            held += cells[-1].size
            if held >= CELLS_AT_ONCE:
                yield handed()
                cells.clear()
                held = 0
        if cells:
            yield handed()

    return touch


def _merged(slice_bits: int):
    """Bits of the cells of each slice that were counted twice or more."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen, twice = None, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([np.packbits(twice).tobytes()])], names=["slice", "bits"])

        for batch in batches:
            for number, once, more in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if number != current:
                    if current is not None:
                        yield told()
                    current, seen, twice = number, np.zeros(1 << slice_bits, dtype=bool), np.zeros(1 << slice_bits, dtype=bool)
                one, two = np.frombuffer(once, "<u2"), np.frombuffer(more, "<u2")
                twice[one[seen[one]]] = True
                twice[two] = True
                seen[one] = seen[two] = True
        if current is not None:
            yield told()

    return merge


def repeated_cells(chunks: DataFrame, window: int, bits: int) -> np.ndarray:
    """One bit for each cell of the merged sketch: whether it counted two or more. Its size is bounded by MOST_BITS."""
    slices = (
        chunks.select("id", "text", "chunk").mapInArrow(_touched(window, bits, SLICE_BITS), "slice int, once binary, more binary")
        .repartition("slice").sortWithinPartitions("slice").mapInArrow(_merged(SLICE_BITS), "slice int, bits binary")
    )
    found = np.zeros((SKETCH_ROWS << bits) // 8, dtype=np.uint8)
    width = (1 << SLICE_BITS) // 8
    for row in slices.toLocalIterator():
        found[row["slice"] * width:(row["slice"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return found


def may_repeat(found: Windows, bits: int, cells: np.ndarray) -> np.ndarray:
    """The windows that the sketch estimates at two documents or more."""
    good = np.ones(len(found.lead), dtype=bool)
    for cell in found.cells(bits):
        good &= ((cells[cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)
    return good


# --- exact grouping -------------------------------------------------------------------------


def _grouped(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal names follow each other, and where each name starts in it."""
    order = np.lexsort((names["b"], names["a"]))
    ordered = names[order]
    return order, np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(names) else order


def _windows_by_bucket(window: int, bits: int, cells, buckets: int):
    """One record for each window that may repeat and chunk: its name and the smallest id with it, packed by bucket."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in _parts(batches):
            ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            found = Windows(part.column(1), window, part.column(0).is_valid().to_numpy(zero_copy_only=False))
            chosen = may_repeat(found, bits, cells.value)
            if not chosen.any():
                continue
            names = found.names(chosen)
            order, starts = _grouped(names)
            least = np.minimum.reduceat(ids[found.text[chosen]][order], starts)
            names = names[order][starts]
            # By document within a bucket: runs of equal ids take no room in a compressed shuffle.
            bucket = ((names["a"] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            dealt = np.lexsort((least, bucket))
            bucket, names, least = bucket[dealt], names[dealt], least[dealt]
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = [*starts[1:], len(bucket)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(len(starts), chunk)),
                    pa.array([names[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]),
                    pa.array([least[a:b].astype("<i8").tobytes() for a, b in zip(starts, ends, strict=True)]),
                ],
                names=["bucket", "chunk", "names", "ids"],
            )

    return emit


def _smaller_elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk, the names of its windows that a document with a smaller id has in another chunk."""

    def told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        names = np.concatenate([np.frombuffer(r[2], NAME) for r in rows])
        ids = np.concatenate([np.frombuffer(r[3], "<i8") for r in rows])
        chunks = np.repeat(np.array([r[1] for r in rows]), [len(r[2]) // NAME.itemsize for r in rows])
        order, starts = _grouped(names)
        ids, chunks, names = ids[order], chunks[order], names[order]
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(ids)]))
        least = np.minimum.reduceat(ids, starts)
        # A chunk that two tasks read counts with the smaller of its two records.
        place = np.lexsort((ids, chunks, group))
        first = np.concatenate(([True], (group[place][1:] != group[place][:-1]) | (chunks[place][1:] != chunks[place][:-1])))
        place = place[first]
        place = place[ids[place] > least[group[place]]]
        chunk = chunks[place]
        if not len(place):
            return
        sort = np.argsort(chunk, kind="stable")
        place, chunk = place[sort], chunk[sort]
        starts = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
        ends = [*starts[1:], len(chunk)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk[starts]), pa.array([names[place[a:b]].tobytes() for a, b in zip(starts, ends, strict=True)])], names=["chunk", "names"]
        )

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if held and row[0] != held[0][0]:
                yield from told(held)
                held = []
            held.append(row)
    if held:
        yield from told(held)


def _listed(names: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Whether each name is in a list sorted by its first part."""
    good = np.zeros(len(names), dtype=bool)
    if len(told):
        low, high = (np.searchsorted(told["a"], names["a"], side=side) for side in ("left", "right"))
        for step in range(int((high - low).max(initial=0))):
            at = np.minimum(low + step, len(told) - 1)
            good |= (low + step < high) & (told["b"][at] == names["b"])
    return good


def _kept(part: pa.RecordBatch, window: int, bits: int, cells: np.ndarray, told: np.ndarray) -> pa.RecordBatch:
    """The rows of a chunk with what is left of them; told: names that a smaller document has elsewhere."""
    ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    found = Windows(part.column(1), window, part.column(0).is_valid().to_numpy(zero_copy_only=False))
    chosen = may_repeat(found, bits, cells)
    covered = np.zeros(len(found.begin) + 1, dtype=np.int64)
    if chosen.any():
        names, owner, start = found.names(chosen), ids[found.text[chosen]], found.start[chosen]
        order, starts = _grouped(names)
        least = np.zeros(len(names), dtype=np.int64)
        least[order] = np.repeat(np.minimum.reduceat(owner[order], starts), np.diff([*starts, len(names)]))
        again = start[(owner > least) | _listed(names, told)]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + window, -1)
    gone = np.cumsum(covered)[:-1] > 0
    text = np.repeat(np.arange(part.num_rows), np.diff(found.words))
    removed = np.bincount(text, weights=gone, minlength=part.num_rows).astype(np.int64)
    # Kept words, each with the place before it, which is made a space; a text's first one is cut off.
    left = np.flatnonzero(~gone)
    sizes = found.end[left] - found.begin[left]
    raw = np.full(int(sizes.sum()) + len(left), 32, dtype=np.uint8)
    words, offsets = gathered(found.data, found.begin[left], found.end[left])
    raw[np.arange(len(words)) + np.repeat(np.arange(1, len(left) + 1), sizes)] = words
    where = np.concatenate(([0], offsets[1:] + np.arange(1, len(left) + 1)))
    first = np.searchsorted(text[left], np.arange(part.num_rows + 1))
    pieces = [raw[where[a] + 1:where[b]].tobytes() if b > a else b"" for a, b in zip(first[:-1], first[1:], strict=True)]
    # Runs of removed words.
    inside = np.concatenate(([False], gone))
    starts = np.flatnonzero(gone & ~(inside[:-1] & np.concatenate(([False], text[1:] == text[:-1])))) if len(gone) else left
    length = np.diff(np.concatenate((np.cumsum(gone)[starts] - 1, [gone.sum()]))) if len(starts) else starts
    spans = pa.StructArray.from_arrays([pa.array(starts - found.words[text[starts]]), pa.array(length.astype(np.int64))], names=["first_word", "n_words"])
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, found.words).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(np.diff(found.words)), pa.array(removed), pa.array(pieces, pa.binary()).cast(pa.string()), listed],
        names=["id", "n_words", "n_removed", "kept_text", "removed"],
    )


# --- the operator ----------------------------------------------------------------------------


def drop_repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per row: the id, ``n_words``, ``n_removed``, ``kept_text`` and ``removed``, the runs of removed words.

    A word goes if a window of ``window`` words covers it whose words also stand, in this order and together, in a
    document with a smaller id. Windows are judged on the texts as they came. Words are parted by white space and
    compared unchanged; kept ones are joined by one space.

    NULL, empty and short texts have no windows and lose nothing. A NULL id is smaller than none and no id is smaller
    than it, so such a row is kept whole and takes nothing from others. Rows that repeat an id are the same document:
    they take nothing from each other. An empty table gives an empty result. Other columns are not read, so their
    names cannot clash. Windows are compared by 96 bits of two hashes of their words' 64-bit hashes.

    Every text is read three times and shuffled once; the result is lazy and reads a copy of the texts in the shared folder. The sketch grows with the texts up to 64 MB for all bits; beyond
    that more windows pass it and are grouped, none is lost.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    spark = df.sparkSession
    context = spark.sparkContext
    chunks, _ = keep_table(_with_chunks(df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))), "chunks")
    bits = sketch_bits(chunks.agg(F.sum("size")).first()[0] or 0)
    cells = context.broadcast(repeated_cells(chunks, window, bits))
    buckets = BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = chunks.select("id", "text", "chunk")
    answers = (
        texts.mapInArrow(_windows_by_bucket(window, bits, cells, buckets), "bucket int, chunk long, names binary, ids binary")
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_smaller_elsewhere, "chunk long, names binary")
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, told, rows = None, [], []

        def finished() -> Iterator[pa.RecordBatch]:
            if rows:
                names = np.concatenate([np.frombuffer(x, NAME) for x in told]) if told else np.zeros(0, dtype=NAME)
                whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
                yield _kept(whole, window, bits, cells.value, np.sort(names, order=["a", "b"]))

        for chunk, part in _parts(batches):
            if chunk != current:
                yield from finished()
                current, told, rows = chunk, [], []
            told += part.column(3).drop_null().to_pylist()
            rows.append(part.filter(part.column(3).is_null()).select([0, 1]))
        yield from finished()

    both = texts.withColumn("names", F.lit(None).cast("binary")).union(
        answers.select(F.lit(None).cast("long"), F.lit(None).cast("string"), "chunk", "names")
    )
    schema = "id long, n_words long, n_removed long, kept_text string, removed array<struct<first_word:long,n_words:long>>"
    return both.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(keep, schema).withColumnRenamed("id", id_col)
