"""Jaccard join of word shingle sets by parity sketches, and the components its links form.

A set's sketch has one bit per position; every shingle flips the bit its hash names. Two sketches
differ in at most as many bits as the sets differ in shingles. Sets of n and m shingles with a Jaccard
similarity of at least 0.8 differ in at most (n + m) / 9 shingles, so if the positions are cut into more
blocks than that, two linked sets agree in a whole block: they meet by pigeonhole in a join on blocks.
Block lengths follow from the size band, so that a block holds a few shingles in every band.

The bits of a block are kept sparsely, as the XOR of a fingerprint of every flipped bit. Blocks without a
shingle agree by accident; a band has enough blocks to do without them, and a set with too many
empty ones in one partition of the positions is sketched again under another.

What shares a block is not paired all with all. Each set is first paired with a few that lead its blocks; links
that hold give components; only where a block still holds several components are sets of
different ones compared, by dense sketches, in bounded tiles. Every pair that survives is verified on
the whole texts. So no link between different components is lost, and copies cost one row each.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataproof.llm.components import Forest, components, merged
from dataproof.llm.words import hashed_words, mix, shingle_hashes
from dataproof.llm.workers import tidy
from dataproof.sources.shared import drop_folder, keep_table

SHINGLE = 5
#: The link rule as a ratio of integers: intersection / union >= 80 / 100.
SIMILAR = (80, 100)
#: Each band of smaller set sizes reaches this many times its start.
BAND_RATIO = 1.5
#: Partitions of the positions tried for a set with too many empty blocks.
PARTITIONS = 4
#: Buckets of blocks per shuffle partition, so that buckets even out.
BUCKETS_EACH = 16
#: Keys gathered before they are handed on.
KEYS_AT_ONCE = 1 << 19
#: One crowded block in so many is looked through first.
FIRST_BLOCKS = 32
#: Sets of a block compared with each other in one tile.
TILE = 1024
#: Rounds over these blocks.
FIRST_ROUNDS = 2
#: Nearest sets that each set names once blocks are looked through for good; the square of it times more in each round.
MORE = 16
#: First blocks of a set, by which two sets agree where they are named.
FIRSTS = 8
#: Nearest sets that a task remembers before it hands them over.
PAIRS_KEPT = 1 << 18
#: Tables of sets' ids and pairs are written by so many times fewer tasks than texts, though by one for each core.
FEWER = 8
#: Bits of the filter that picks the texts to verify; a false hit costs a row in a shuffle.
FILTER_BITS = 1 << 24

_ID_MASK = np.uint64((1 << 48) - 1)
_KEY_BYTES, _ID_BYTES = 5, 6


# --- sets and sketches --------------------------------------------------------------


def most_apart(n: np.ndarray | int, m: np.ndarray | int):
    """The most shingles in which linked sets of these sizes differ."""
    low, high = SIMILAR
    return (high - low) * (n + m) // (high + low)


def _empty_blocks(n: int, blocks: int) -> tuple[float, float]:
    """How many of the blocks n shingles leave empty: the mean, and three times the deviation."""
    one, two = (blocks * math.exp(n * math.log1p(-1 / blocks)), (blocks - 1) * math.exp(n * math.log1p(-2 / blocks)))
    return one, 3 * math.sqrt(max(0.0, one + blocks * two - one * one))


def bands() -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size, blocks, empty blocks allowed) of each band.

    A band takes pairs whose smaller set has a size from its start to before the next one's; the larger
    set then has at most 5/4 of that. Smaller sets than the first start have only equal partners.
    """
    found = []
    start = next(n for n in range(1, 99) if most_apart(n, n * SIMILAR[1] // SIMILAR[0]) > 0)
    while start < 1 << 36:
        after = max(start + 1, int(start * BAND_RATIO))
        largest = (after - 1) * SIMILAR[1] // SIMILAR[0]
        apart = int(most_apart(after - 1, largest))
        spare = 1
        while sum(_empty_blocks(start, apart + 1 + spare)) > spare:
            spare += max(1, spare // 32)
        found.append((start, largest, apart + 1 + spare, spare))
        start = after
    return found


_BANDS = bands()


def set_of(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of a text's words."""
    return np.unique(shingle_hashes(words, SHINGLE))


def identity(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    if not len(shingles):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(np.add.reduce(mix(shingles, 2))), int(np.bitwise_xor.reduce(mix(shingles, 3)))


def dense_sketch(shingles: np.ndarray) -> bytes:
    """Parity of the shingles at each of a power of two of positions, at least as many as shingles.

    Compared at the length of the smaller set, the sketches of unlike sets that are similar in size differ in about
    half of its positions, twice as many as the rule allows.
    """
    bits = 1 << max(6, int(len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles, 4) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch as if it had been made with fewer positions: bits that fall together are XORed."""
    bits = np.unpackbits(sketch)
    return np.packbits(np.bitwise_xor.reduce(bits.reshape(-1, size * 8), axis=0))


def block_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of all blocks by which the set can meet a linked one."""
    n = len(shingles)
    keys = []
    for band, (smallest, largest, blocks, spare) in enumerate(_BANDS):
        if smallest > n:
            break
        if largest < n:
            continue
        for partition in range(PARTITIONS):
            position = mix(shingles, 16 + band * PARTITIONS + partition)
            block = ((position >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            order = np.argsort(block, kind="stable")
            block = block[order]
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            bits = np.bitwise_xor.reduceat(mix(position[order], 5), starts)
            keys.append(mix(bits ^ mix(block[starts], 64 + band * PARTITIONS + partition), 6))
            if blocks - len(starts) <= spare:
                break
        else:
            keys.append(mix(np.array([band], dtype=np.uint64), 7))
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def short_id(first: Column) -> Column:
    """The part of a set's digest that keys carry; sets that share it are told apart when verified."""
    return F.col(first).bitwiseAND(F.lit(int(_ID_MASK)))


def text_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Number and set of every text of a batch."""
    for first, hashes, at in hashed_words(texts):
        for k in range(len(at) - 1):
            yield first + k, set_of(hashes[at[k]:at[k + 1]])


def set_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row: doc_id, n_shingles, two digests, and the dense sketch of a set that may have links."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), *identity(s), dense_sketch(s) if len(s) >= _BANDS[0][0] else None)
                    for _, s in text_sets(batch.column(1))]
            n, first, second, sketch = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()),
                    pa.array(np.array(first, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(second, dtype=np.uint64).view(np.int64)), pa.array(sketch, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"],
            )

    return df.select(df[id_col].cast("long"), df[text_col]).mapInArrow(
        tidy(sets), "doc_id long, n_shingles long, set_a long, set_b long, sketch binary"
    )


# --- candidates -----------------------------------------------------------------------


def _packed_keys(df: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """Keys and set ids of all blocks, packed by bucket: rows of (bucket, data)."""

    def pack(keys: list[np.ndarray], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        key, vertex = np.concatenate(keys), np.concatenate(ids)
        bucket = (key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.append(starts[1:], len(bucket))
        raw_keys = key[order].view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]
        raw_ids = vertex[order].view(np.uint8).reshape(-1, 8)[:, :_ID_BYTES]
        rows = np.concatenate([raw_keys, raw_ids], axis=1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[starts].astype(np.int32)),
                pa.array([rows[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
            ],
            names=["bucket", "data"],
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        seen: set[int] = set()
        for batch in batches:
            for _, shingles in text_sets(batch.column(0)):
                if len(shingles) < _BANDS[0][0]:
                    continue
                vertex = np.uint64(identity(shingles)[0]) & _ID_MASK
                # A copy of a set seen just now adds nothing.
                if int(vertex) in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(int(vertex))
                own = block_keys(shingles)
                keys.append(own)
                ids.append(np.full(len(own), vertex))
                held += len(own)
                if held >= KEYS_AT_ONCE:
                    yield from pack(keys, ids)
                    keys, ids, held = [], [], 0
        yield from pack(keys, ids)

    return df.select(df[text_col]).mapInArrow(tidy(emit), "bucket int, data binary")


def _unpacked(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(chunks), dtype=np.uint8).reshape(-1, _KEY_BYTES + _ID_BYTES)
    key, vertex = np.zeros((len(raw), 8), dtype=np.uint8), np.zeros((len(raw), 8), dtype=np.uint8)
    key[:, :_KEY_BYTES] = raw[:, :_KEY_BYTES]
    vertex[:, :_ID_BYTES] = raw[:, _KEY_BYTES:]
    return key.view(np.uint64).ravel(), vertex.view(np.uint64).ravel()


def _meetings(packed: DataFrame, partitions: int) -> DataFrame:
    """What meets in a block: of two sets (kind 0, one, other); of more, (kind 1, block, set) for each set and
    (kind 2, first, other) for each but the first."""

    def met(bucket: int, chunks: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, vertex = _unpacked(chunks)
        order = np.lexsort((vertex, key))
        key, vertex = key[order], vertex[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (vertex[1:] != vertex[:-1])))
        key, vertex = key[new], vertex[new]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        each, leader = np.repeat(sizes, sizes), np.repeat(vertex[starts], sizes)
        both = np.stack([leader, vertex])
        pairs, stars = (np.unique(both[:, (leader != vertex) & size], axis=1) for size in (each == 2, each > 2))
        crowded = each > 2
        blocks = mix(key[crowded] ^ np.uint64(bucket << 40), 8)
        kind = np.repeat(np.array([0, 1, 2], dtype=np.int32), [pairs.shape[1], len(blocks), stars.shape[1]])
        if len(kind):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kind),
                    pa.array(np.concatenate([pairs[0], blocks, stars[0]]).view(np.int64)),
                    pa.array(np.concatenate([pairs[1], vertex[crowded], stars[1]]).view(np.int64)),
                ],
                names=["kind", "a", "b"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, chunks = None, []
        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != bucket and chunks:
                    yield from met(bucket, chunks)
                    chunks = []
                bucket = own
                chunks.append(data)
        if chunks:
            yield from met(bucket, chunks)

    return (
        packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(tidy(meet), "kind int, a long, b long")
    )


def _first_pairs(met: DataFrame) -> DataFrame:
    """Each set with the set that leads most of its blocks, and with the smallest that leads one.

    These pairs only make components early; what they leave apart is looked through later.
    """
    often = met.where("kind <> 1").repartition("b").groupBy("b", "a").agg(F.count(F.lit(1)).alias("times"))
    leaders = often.groupBy("b").agg(F.max(F.struct("times", "a"))["a"].alias("most"), F.min("a").alias("least"))
    return leaders.select("b", F.explode(F.array_distinct(F.array("most", "least"))).alias("a"))


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs of set ids as pairs of sets whose sizes and dense sketches allow a link."""
    # They come by "b", so that side needs no shuffle of its own.
    for side in ("b", "a"):
        pairs = pairs.join(
            sets.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("doc", "n", "sketch")]), side
        )
    low, high = SIMILAR
    fits = (F.least("n_a", "n_b") * high >= F.greatest("n_a", "n_b") * low) & (F.col("doc_a") != F.col("doc_b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [[np.frombuffer(s, dtype=np.uint8) for s in batch.column(c).to_pylist()] for c in (4, 5)]
            sizes = [batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3)]
            allowed = most_apart(sizes[0], sizes[1])
            good = [apart(x, y) <= most for x, y, most in zip(*sketches, allowed, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1, 6, 7])

    return pairs.where(fits).select("doc_a", "doc_b", "n_a", "n_b", "sketch_a", "sketch_b", "a", "b").mapInArrow(
        tidy(near), "doc_a long, doc_b long, a long, b long"
    )


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many positions two sketches differ, at the smaller one's length."""
    size = min(len(x), len(y))
    x, y = (s if len(s) == size else folded(s, size) for s in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


# --- verification ----------------------------------------------------------------------


def _filter_words(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash of an id, as an array of a fixed size."""
    rows = (
        ids.select(F.pmod(F.xxhash64("doc"), F.lit(bits)).alias("place"))
        .select(F.expr("cast(place div 32 as int)").alias("word"), F.expr("shiftleft(1L, cast(place % 32 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).coalesce(_few_tasks(ids)).toPandas()
    )
    words = np.zeros(bits // 32, dtype=np.uint32)
    words[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return words


def _links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs of documents (a, b) with whether their whole texts are ``linked``, and whether the link ``joins`` what
    the task's earlier links do not.

    Only texts of documents in a pair are shuffled: a filter of a fixed size, made from their ids,
    sorts out the others where they lie, and the joins are exact.
    """
    spark = pairs.sparkSession
    wanted = pairs.select(F.col("doc_a").alias("doc")).union(pairs.select(F.col("doc_b").alias("doc")))
    bits = FILTER_BITS
    shared = spark.sparkContext.broadcast(_filter_words(wanted, bits))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (words[place >> 5] >> (place & 31).astype(np.uint32)) & 1
            yield batch.filter(pa.array(hit.astype(bool))).select([0, 1])

    # Texts are dealt once before the joins: where pairs are broadcast, a task that chooses texts would also verify
    # them, in two Python workers at a time, and both workers stay for the stages that follow.
    texts = (
        docs.select("doc", "text", F.pmod(F.xxhash64("doc"), F.lit(bits)).alias("place"))
        .mapInArrow(tidy(chosen), "doc long, text string").repartition(F.xxhash64("doc"))
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = SIMILAR
        forest = Forest()
        held: tuple[object, np.ndarray] = (None, np.zeros(0, dtype=np.uint64))
        for batch in batches:
            good, joins = [], []
            others = dict(text_sets(batch.column(3)))
            leaders = batch.column(0).to_pylist()
            for at, leader in enumerate(leaders):
                if (leader, batch.column(4)[at].as_py()) != held[0]:
                    held = (leader, batch.column(4)[at].as_py()), next(s for _, s in text_sets(batch.column(2).slice(at, 1)))
                own, other = held[1], others[at]
                common = len(np.intersect1d(own, other, assume_unique=True))
                # A repeated id can bring a text that is not the one whose sketch was met.
                meant = all(int(np.uint64(identity(x)[0]) & _ID_MASK) == batch.column(c)[at].as_py() for x, c in ((own, 4), (other, 5)))
                linked = meant and high * common >= low * (len(own) + len(other) - common)
                good.append(linked)
                joins.append(linked and forest.joins(leader, batch.column(1)[at].as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good), pa.array(joins)], names=["a", "b", "linked", "joins"])

    both = pairs.join(texts.select(F.col("doc").alias("doc_b"), F.col("text").alias("text_b")), "doc_b").join(
        texts.select(F.col("doc").alias("doc_a"), F.col("text").alias("text_a")), "doc_a"
    )
    return both.select("doc_a", "doc_b", "text_a", "text_b", "a", "b").mapInArrow(tidy(verify), "a long, b long, linked boolean, joins boolean")


# --- blocks that still hold several components --------------------------------------------


def _mixed(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (block, doc, ...) of blocks that hold more than one component, with their labels."""
    labelled = blocks.select("block", "doc").join(labels, "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component")
    mixed = labelled.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
    mixed = mixed.where("low <> high").select("block", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    return labelled.join(mixed, "block")


def nearest(owner: np.ndarray, differ: np.ndarray, many: int) -> np.ndarray:
    """Places of the ``many`` smallest differences of each owner."""
    order = np.lexsort((differ, owner))
    owner = owner[order]
    return order[np.arange(len(owner)) - np.searchsorted(owner, owner) < many]


def near_pairs(left: tuple, right: tuple, once: bool) -> np.ndarray:
    """(row, column, differ) of the sets of two tiles with different labels whose sizes and sketches allow a link.

    A tile is (sketches, labels, sizes). Sets of one label are never compared, so a block in which one component
    prevails costs as much as the others have members. ``once``: both are the same tile, a pair counts once.
    """
    (sketches, labels, counts), (others, other_labels, other_counts) = left, right
    low, high = SIMILAR
    found = [np.zeros((0, 3), dtype=np.int64)]
    for label in np.unique(labels):
        rows = np.flatnonzero(labels == label)
        columns = np.flatnonzero(other_labels > label if once else other_labels != label)
        swapped = len(rows) > len(columns)
        few, many = (columns, rows) if swapped else (rows, columns)
        of_few, of_many = (others, sketches[rows]) if swapped else (sketches, others[columns])
        count_few, count_many = (other_counts, counts[rows]) if swapped else (counts, other_counts[columns])
        for x in few:
            differ = np.bitwise_count(of_many ^ of_few[x]).sum(axis=1, dtype=np.int64)
            small, large = np.minimum(count_many, count_few[x]), np.maximum(count_many, count_few[x])
            good = np.flatnonzero((differ <= most_apart(small, large)) & (small * high >= large * low))
            if len(good):
                own = np.full(len(good), x)
                found.append(np.stack([*((many[good], own) if swapped else (own, many[good])), differ[good]], axis=1))
    return np.concatenate(found)


def near_folded(left: tuple, right: tuple, once: bool) -> np.ndarray:
    """``near_pairs`` of tiles whose sketches, a list of bytes, have different lengths: a pair is compared at its smaller one's."""
    found = [np.zeros((0, 3), dtype=np.int64)]
    lengths = [np.array([len(x) for x in tile[0]], dtype=np.int64) for tile in (left, right)]
    for x, y in itertools.product(*map(np.unique, lengths)):
        if once and y < x:
            continue
        places = [np.flatnonzero(own == length) for own, length in zip(lengths, (x, y), strict=True)]
        parts = []
        for (sketches, labels, counts), at in zip((left, right), places, strict=True):
            arrays = [np.frombuffer(sketches[k], np.uint8) for k in at]
            size = int(min(x, y))
            parts.append((np.array([a if len(a) == size else folded(a, size) for a in arrays]), labels[at], counts[at]))
        pairs = near_pairs(*parts, once=once and x == y)
        found.append(np.stack([places[0][pairs[:, 0]], places[1][pairs[:, 1]], pairs[:, 2]], axis=1))
    return np.concatenate(found)


def _nearest_apart(mixed: DataFrame, sets: DataFrame, many: int) -> DataFrame:
    """For each set the ``many`` nearest sets of other components that share a block with it: doc, other, differ.

    A block's sets are dealt into tiles of about TILE; every pair of tiles is a group of its own, so a
    crowded block is spread over tasks and none holds more than two tiles. A task keeps the nearest of each set.
    """
    tile = F.pmod(F.hash("doc"), F.col("tiles"))
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    firsts = mixed.groupBy("doc").agg(F.slice(F.array_sort(F.collect_set("block")), 1, FIRSTS).alias("firsts"))
    dealt = (
        mixed.join(sets.select("doc", "n", "sketch"), "doc").join(firsts, "doc")
        .withColumn("tile", tile).withColumn("other", F.explode(others))
        .select(
            "block", F.least("tile", "other").alias("row_tile"), F.greatest("tile", "other").alias("column_tile"),
            "tile", "doc", "label", "n", "sketch", "firsts",
        )
    )

    def compare(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        row, column = rows[0][1], rows[0][2]
        docs, tiles, blocks = [], [], []
        for t in (row, column):
            side = [r for r in rows if r[3] == t]
            numbers = [np.array([r[k] for r in side], dtype=np.int64) for k in (4, 5, 6)]
            docs.append(numbers[0])
            tiles.append(([r[7] for r in side], *numbers[1:]))
            blocks.append([r[8] for r in side])
        pairs = near_folded(*tiles, once=row == column)
        # A pair that shares first blocks is named in the first of them only; one that shares none, wherever it meets.
        here = [min(set(blocks[0][i]).intersection(blocks[1][j]), default=rows[0][0]) == rows[0][0] for i, j, _ in pairs.tolist()]
        pairs = pairs[np.array(here, dtype=bool)]
        first, second, differ = docs[0][pairs[:, 0]], docs[1][pairs[:, 1]], pairs[:, 2]
        owner, other, differ = np.concatenate([first, second]), np.concatenate([second, first]), np.concatenate([differ, differ])
        for k in nearest(owner, differ, many):
            yield int(owner[k]), int(other[k]), int(differ[k])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}

        def told() -> pa.RecordBatch:
            found = [(doc, other, differ) for doc, pairs in best.items() for differ, other in pairs]
            best.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], pa.int64()) for k in range(3)], names=["doc", "other", "differ"]
            )

        def add(rows: list[tuple]) -> None:
            for doc, other, differ in compare(rows) if len(rows) > 1 else ():
                pairs = best.setdefault(doc, [])
                if (differ, other) not in pairs and (len(pairs) < many or (differ, other) < pairs[-1]):
                    pairs.append((differ, other))
                    pairs.sort()
                    del pairs[many:]

        held: list[tuple] = []
        for batch in batches:
            for values in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if held and values[:3] != held[0][:3]:
                    add(held)
                    held = []
                    if len(best) * many > PAIRS_KEPT:
                        yield told()
                held.append(values)
        if held:
            add(held)
        yield told()

    keys = ["block", "row_tile", "column_tile"]
    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(groups), "doc long, other long, differ long")
    found = found.repartition("doc").distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("differ", "other"))).where(F.col("rank") <= many)


def _join_blocks(blocks: DataFrame, sets: DataFrame, texts: DataFrame, labels: DataFrame, whole: bool) -> DataFrame:
    """The labels after links between sets that share one of the blocks; after all of them if ``whole``.

    In every round each set names its nearest of other components; those that no earlier round has tried are verified, and
    links join components. First rounds name one for each set and are few. If ``whole``, sets name more in each
    round, until none has named as many as it may: then all that could link has been tried. A set that has named fewer
    has named all of its own, so later rounds deal only sets that have not, and pairs of these.
    """
    mixed, path = _kept_small(_mixed(blocks, labels), "mixed")
    refused, many = None, MORE if whole else 1
    for done in itertools.count(1) if whole else range(1, FIRST_ROUNDS + 1):
        if mixed.isEmpty():
            break
        named, _ = _kept_small(_nearest_apart(mixed, sets, many), "nearest")
        new = named.select(F.least("doc", "other").alias("doc_a"), F.greatest("doc", "other").alias("doc_b")).distinct()
        if refused is not None:
            new = new.join(refused, ["doc_a", "doc_b"], "left_anti")
        new, _ = _kept_small(_with_ids(new, sets), "pairs")
        full = named.where(F.col("rank") == many).select("doc")
        more = whole and not full.isEmpty()
        if new.isEmpty() and not more:
            break
        tried, _ = keep_table(_links(new, texts), "links")
        bad = tried.where("not linked").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))
        refused = bad if refused is None else refused.union(bad)
        links = tried.where("joins").select("a", "b")
        joined = not links.isEmpty()
        if joined:
            labels = merged(labels, links)
        if not more and (whole or not joined or done == FIRST_ROUNDS):
            break
        before = path
        mixed, path = _kept_small(_mixed(mixed.join(full, "doc", "left_semi") if whole else mixed, labels), "mixed")
        drop_folder(blocks.sparkSession, before)
        many *= MORE * MORE if whole else 1
    return labels


def _with_ids(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of documents with the short ids of their sets: doc_a, doc_b, a, b."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc").alias(f"doc_{side}"), F.col("id").alias(side)), f"doc_{side}")
    return pairs.select("doc_a", "doc_b", "a", "b")


# --- the operator ------------------------------------------------------------------------


def parity_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Words are lower-cased in A-Z. A set holds the distinct shingles of five words, or the whole
    sequence of a shorter text. NULL, empty and white-space texts have no set, link with nothing and are
    their own component. Equal sets are one vertex, however many rows have them, so copies and repeated
    rows cost a row each and never a pair. An id names a document: rows that repeat one are in one component.
    A row with a NULL id belongs where a row with the same set and an id does; if there is none it links
    with nothing and its component is NULL. An empty table gives an empty result. Other
    columns are not read, so their names cannot clash.

    Shingles are compared as 64-bit hashes.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    rows, _ = keep_table(set_table(docs, "doc_id", "text"), "shingle-sets")
    filled = rows.where("n_shingles > 0")
    sets = filled.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch"))
    sets, _ = keep_table(
        sets.select(short_id("set_a").alias("id"), "set_a", "set_b", F.col("n_shingles").alias("n"), "doc", "sketch"),
        "distinct-sets",
    )
    # A set that only rows without an id have cannot be named in a pair.
    named = sets.where("doc is not null and sketch is not null")

    met, met_path = keep_table(_meetings(_packed_keys(docs, "text", partitions * BUCKETS_EACH), partitions), "meetings")
    texts = docs.withColumnRenamed("doc_id", "doc")
    first, _ = keep_table(_links(_kept_small(_plausible(_first_pairs(met), named), "pairs")[0], texts), "links")
    final = components(first.where("joins").select("a", "b"))
    of = named.select(F.col("id").alias("b"), "doc")
    crowded = met.where("kind = 1").join(of, "b").select(F.col("a").alias("block"), "doc").distinct()
    # Two sets that met alone are a block of their own.
    alone_met = met.where("kind = 0").select("a", "b").distinct()
    alone_met = alone_met.select(F.xxhash64("a", "b").alias("block"), F.explode(F.array("a", "b")).alias("b")).join(of, "b").select("block", "doc")
    # Near sets share most of their blocks: a few blocks join them, and the other blocks then pass them over.
    few = F.pmod(F.col("block"), F.lit(FIRST_BLOCKS)) == 0
    final = _join_blocks(crowded.where(few), named, texts, final, whole=False)
    final = _join_blocks(crowded.union(alone_met), named, texts, final, whole=True)
    drop_folder(spark, met_path)
    classes = sets.join(final.withColumnRenamed("component", "found"), "doc", "left").select(
        "set_a", "set_b", F.coalesce("found", "doc").alias("component_id")
    )
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = filled.join(classes, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
    return joined.union(alone).withColumnRenamed("doc_id", id_col)


def _few_tasks(df: DataFrame) -> int:
    """Tasks for what is far smaller than the texts; they follow the number of shuffle partitions."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // FEWER)


def _kept_small(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table without texts or sketches, kept in few files: later joins then know that it is small."""
    return keep_table(df.coalesce(_few_tasks(df)), name)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay if every component keeps the document with its smallest id; all columns.

    An id names a document: of rows that repeat an id one stays, the first by text. Rows
    with a NULL id all stay.
    """
    classes = parity_join(df, id_col, text_col)
    stay = classes.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("stay")).distinct()
    named = df.where(df[id_col].isNotNull()).join(stay, F.col(id_col) == F.col("stay"), "left_semi")
    mark = next(x for x in (f"rank_{i}" for i in range(len(df.columns) + 1)) if x not in df.columns)
    first = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
    named = named.withColumn(mark, F.row_number().over(first)).where(F.col(mark) == 1).select(*df.columns)
    return named.unionByName(df.where(df[id_col].isNull()))
