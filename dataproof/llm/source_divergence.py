"""How far the sources of a language lie apart in the words they use: an audit over K²-trees.

Counts of terms by group form a matrix, nearly all of it zero. A K²-tree halves rows and columns again and
again and keeps one bit for each quadrant: whether anything in it is not zero. Two groups are compared by
going down both trees together. Where both quadrants are all zero, every pair of their rows differs
by one known amount in each column, so the quadrant is priced by its width and not entered; leaves that
are reached are compared term by term.

Rows are cut into tiles and columns into stripes; a pair of tiles over one stripe is a group of its own, so no
task holds more than two tiles of a stripe whatever the number of sources and terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataproof.llm.words import gathered, hash_spans, lowered, mix, text_chunks, word_spans
from dataproof.sources.shared import drop_folder, keep_table

#: Groups in a tile, a power of two, and terms in a stripe.
TILE, STRIPE = 64, 1024
#: Shares are given in parts of this.
UNIT = 1_000_000_000

#: Bytes that are no part of a term: of the first 128 all but letters.
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[:128] = True
_BETWEEN[[*range(65, 91), *range(97, 123)]] = False


@dataclass(frozen=True)
class Audit:
    """Terms in ``min_documents`` documents of their language or more; shares smoothed by ``smoothing``; ``top`` terms of a group."""

    min_documents: int = 30
    smoothing: int = 5
    top: int = 50


# --- counts -----------------------------------------------------------------------------


def term_counts(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, source, term, count and documents; a row with a NULL term stands for each group.

    Counted by chunk of texts first, so a term or group in a third of all rows is one row for each chunk.
    """
    schema = pa.schema([("lang", pa.large_string()), ("source", pa.large_string()), ("term", pa.large_string()), ("count", pa.int64()), ("documents", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in (1, 2)], strict=True))
            known = {name: number for number, name in enumerate(dict.fromkeys(names))}
            group = np.array([known[name] for name in names], dtype=np.int64)
            lang, source = (pa.array([name[k] for name in known], pa.large_string()) for k in (0, 1))
            none = pa.array([0] * len(known), pa.int64())
            yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(known), pa.large_string()), none, none], schema=schema)
            for first, _, data, at in text_chunks(batch.column(0)):
                data = lowered(data)
                begin, end, words = word_spans(data, at, _BETWEEN)
                if not len(begin):
                    continue
                text = np.repeat(np.arange(len(at) - 1), np.diff(words))
                hashes = hash_spans(data, begin, end)
                # Occurrences in each text, then of each group.
                _, one, times = np.unique(mix(hashes ^ mix(text.astype(np.uint64), 1)), return_index=True, return_counts=True)
                owner = group[first + text[one]]
                _, start, inverse = np.unique(mix(hashes[one] ^ mix(owner.astype(np.uint64), 2)), return_index=True, return_inverse=True)
                counts = np.bincount(inverse, weights=times).astype(np.int64)
                documents = np.bincount(inverse).astype(np.int64)
                raw, offsets = gathered(data, begin[one[start]], end[one[start]])
                terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw))
                which = pa.array(owner[start])
                yield pa.RecordBatch.from_arrays([lang.take(which), source.take(which), terms, pa.array(counts), pa.array(documents)], schema=schema)

    columns = [F.coalesce(df[c].cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    found = df.select(*columns).mapInArrow(count, "lang string, source string, term string, count long, documents long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def share(count: str, total: str, terms: str, smoothing: int):
    """1 + floor(UNIT * (count + smoothing) / (total + smoothing * terms)) in whole numbers; NULL without terms."""
    wide = "decimal(20,0)"
    above = f"cast({UNIT} as decimal(10,0)) * cast({count} + {smoothing} as {wide})"
    below = f"cast({total} as {wide}) + cast({smoothing} as decimal(5,0)) * cast({terms} as decimal(12,0))"
    return F.expr(f"case when {terms} > 0 then 1 + (({above}) div ({below})) end")


# --- trees --------------------------------------------------------------------------------


def tree(cells: np.ndarray) -> list[np.ndarray]:
    """The bits of a K²-tree over each square of the matrix, from its cells up to the squares."""
    levels = [cells]
    while len(levels[-1]) > 1:
        rows, columns = levels[-1].shape
        levels.append(levels[-1].reshape(rows // 2, 2, columns // 2, 2).any(axis=(1, 3)))
    return levels


def compared(left: np.ndarray, right: np.ndarray, zero_left: np.ndarray, zero_right: np.ndarray) -> tuple[np.ndarray, int]:
    """For each row of one matrix and of the other: the sum of absolute differences over all columns, and how many columns were priced.

    A 0 in a matrix stands for the row's value in ``zero_...``; other cells hold their value. Rows are a power of two,
    columns a multiple of that.
    """
    trees = tree(left != 0), tree(right != 0)
    price = np.abs(zero_left[:, None] - zero_right[None, :])
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    height = len(trees[0]) - 1
    corners = np.stack(np.meshgrid([0, 1], [0, 1], [0, 1], indexing="ij"), axis=-1).reshape(-1, 3)
    for square in range(trees[0][-1].shape[1]):
        at = np.array([[0, 0, square]])
        for level in range(height, -1, -1):
            empty = ~(trees[0][level][at[:, 0], at[:, 2]] | trees[1][level][at[:, 1], at[:, 2]])
            width = 1 << level
            columns = np.zeros((len(left) // width, len(right) // width), dtype=np.int64)
            np.add.at(columns, (at[empty, 0], at[empty, 1]), width)
            total += columns.repeat(width, axis=0).repeat(width, axis=1) * price
            at = at[~empty]
            if level:
                at = (2 * at[:, None, :] + corners).reshape(-1, 3)
        a, b = left[at[:, 0], at[:, 2]], right[at[:, 1], at[:, 2]]
        differ = np.abs(np.where(a != 0, a, zero_left[at[:, 0]]) - np.where(b != 0, b, zero_right[at[:, 1]]))
        np.add.at(total, (at[:, 0], at[:, 1]), differ)
    return total, left.shape[1]


def _matrix(rows: list[str], columns: dict[str, int], cells: list[tuple[str, str, int]], height: int) -> np.ndarray:
    place = {name: k for k, name in enumerate(rows)}
    found = np.zeros((height, -(-max(1, len(columns)) // height) * height), dtype=np.int64)
    for source, term, value in cells:
        found[place[source], columns[term]] = value
    return found


# --- the operator -----------------------------------------------------------------------------


def _pair_sums(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """lang, source, other and value of all pairs of sources of a language."""
    numbered = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    tiled = numbered.select(
        "lang", "source", "terms", "zero", F.expr(f"cast(place div {TILE} as int)").alias("tile"),
        F.expr(f"cast((sources + {TILE - 1}) div {TILE} as int)").alias("tiles"),
        F.expr(f"cast((terms + {STRIPE - 1}) div {STRIPE} as int)").alias("stripes"),
    )

    def dealt(rows: DataFrame, stripe) -> DataFrame:
        """Rows once for each pair of tiles that their own is in."""
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        return rows.select("*", stripe.alias("stripe"), other.alias("other")).select(
            "lang", "stripe", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"),
            "tile", "source", "term", "value", "terms",
        )

    # A language without terms has one stripe without cells.
    every = F.explode(F.sequence(F.lit(0), F.greatest(F.col("stripes"), F.lit(1)) - 1))
    heads = dealt(tiled.withColumns({"term": F.lit(None).cast("string"), "value": F.coalesce("zero", F.lit(0))}), every)
    cells = dealt(
        entries.where("count > 0").join(tiled, ["lang", "source"]).withColumn("value", F.col("share")),
        F.pmod(F.xxhash64("term"), F.col("stripes").cast("long")).cast("int"),
    )

    def compare(rows: list[tuple]) -> Iterator[tuple]:
        lang, _, tile_a, tile_b = rows[0][:4]
        heads = [{r[5]: r[7] for r in rows if r[6] is None and r[4] == tile} for tile in (tile_a, tile_b)]
        columns = {term: k for k, term in enumerate(dict.fromkeys(r[6] for r in rows if r[6] is not None))}
        height = 1 << max(len(h) - 1 for h in heads).bit_length()
        sides = []
        for tile, zeros in zip((tile_a, tile_b), heads, strict=True):
            names = list(zeros)
            cells = [(r[5], r[6], r[7]) for r in rows if r[6] is not None and r[4] == tile]
            zero = np.array([*zeros.values(), *[0] * (height - len(names))], dtype=np.int64)
            sides.append((names, _matrix(names, columns, cells, height), zero))
        (left, a, zero_a), (right, b, zero_b) = sides
        total, priced = compared(a, b, zero_a, zero_b)
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                if tile_a != tile_b or x < y:
                    yield lang, x, y, int(total[i, j]), priced, abs(int(zero_a[i] - zero_b[j])), rows[0][8]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple]) -> pa.RecordBatch:
            found = list(compare(rows))
            kinds = [pa.string()] * 3 + [pa.int64()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)],
                names=["lang", "source", "other", "part", "priced", "price", "terms"],
            )

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if held and row[:4] != held[0][:4]:
                    yield told(held)
                    held = []
                held.append(row)
        if held:
            yield told(held)

    keys = ["lang", "stripe", "tile_a", "tile_b"]
    parts = heads.union(cells).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        pairs, "lang string, source string, other string, part long, priced long, price long, terms long"
    )
    # Columns that no stripe had are zero for both; columns that only fill a square up were priced as such.
    value = F.sum("part") + (F.max("terms") - F.sum("priced")) * F.max("price")
    sums = parts.groupBy("lang", "source", "other").agg(value.alias("value"))
    return sums.union(sums.select("lang", "other", "source", "value"))


def source_divergence(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", audit: Audit = Audit()
) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source of a language is from each other one, and its own terms.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those in
    ``min_documents`` of its documents or more. The share of a term in a group or language is
    1 + floor(UNIT * (count + s) / (N + s * V)), N the sum of its counts and V the number of kept terms. Part ``pair``: item
    is another source, value the sum of absolute differences of shares over all kept terms. Part ``term``: item is a
    kept term of the group with a larger share there than in the language, value the difference, the first ``top``.
    Ranks go by value descending, then item in the order of its bytes.

    NULL texts, languages and sources are empty strings, and '' is a language and source like any other. Groups
    without terms take part in pairs; without kept terms values are 0. Repeated rows count as often as they occur.
    An empty table gives an empty result. Columns of other names are not read, so they cannot clash. Within a
    chunk of texts, terms are told apart by 64-bit hashes.

    Copies and hot groups are counted by chunk before the shuffle. The pairs of a language's sources are its result,
    so work grows with their square, and with terms only as far as one of the two has them.
    """
    counted, counted_path = keep_table(term_counts(df, text_col, lang_col, source_col), "term-counts")
    kept = (
        counted.where("term is not null").groupBy("lang", "term")
        .agg(F.sum("documents").alias("documents"), F.sum("count").alias("lang_count")).where(F.col("documents") >= audit.min_documents)
    )
    entries = counted.where("term is not null").join(kept.select("lang", "term", "lang_count"), ["lang", "term"])
    entries, entries_path = keep_table(entries.select("lang", "source", "term", "count", "lang_count"), "term-entries")
    vocabulary = entries.select("lang", "term", "lang_count").groupBy("lang", "term").agg(F.first("lang_count").alias("n"))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    sums = entries.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    names = counted.where("term is null").select("lang", "source")
    sources = names.groupBy("lang").agg(F.count("*").alias("sources"))
    groups, groups_path = keep_table(
        names.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").join(sources, "lang")
        .na.fill(0, ["total", "terms", "lang_total"])
        .withColumn("zero", share("0", "total", "terms", audit.smoothing)),
        "groups",
    )
    shared = entries.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"]).select(
        "lang", "source", "term", "count", share("count", "total", "terms", audit.smoothing).alias("share"),
        share("lang_count", "lang_total", "terms", audit.smoothing).alias("lang_share"),
    )
    own = shared.where("count > 0 and share > lang_share").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("lang_share")).alias("value")
    )
    pairs = _pair_sums(groups.select("lang", "source", "terms", "sources", "zero"), shared.select("lang", "source", "term", "count", "share"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).union(
        own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= audit.top)
    )
    result, _ = keep_table(ranked, "divergence")
    for path in (counted_path, entries_path, groups_path):
        drop_folder(df.sparkSession, path)
    return result
