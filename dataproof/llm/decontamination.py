"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a run of words: where it has a 0, the word is ignored, so that a replaced
word there does not hide a match. Hashes of all masked runs of the test items are joined with those of
the training texts; around each hit the two texts are compared word by word, replaced words allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dataproof.llm.words import hashed_words, mix
from dataproof.llm.workers import tidy

#: Fixed masks; 1: the word counts, 0: it is ignored. Every run with 8 equal words or more that are 75 percent of
#: its words or more is hit: of 20 words or more one half passes as well, and a mask fits each shorter run.
MASKS = (
    "111111", "11011011", "1100101011", "101001100101",
    "110100000111", "11100111", "110101011", "11010001011", "1101011001",
)

#: Characters of test items that are sent to the tasks at once. More items are searched in blocks.
BLOCK_CHARS = 14_000_000
#: From so many pairs of places of one run in a text and in the items on, places are taken as evenly spaced rows.
CROWDED = 1 << 10
#: Bits of the table that sorts out most runs before the exact look-up.
TABLE_BITS = 22


@dataclass(frozen=True)
class OverlapRule:
    """An overlap is a run with ``min_matched`` equal words or more that are ``min_percent`` of its words or more."""

    min_matched: int = 8
    min_percent: int = 75


class SeedIndex:
    """The hashed runs of a block of test items."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.names = [name for name, _ in items]
        self.words: list[np.ndarray] = []
        for _, hashes, at in hashed_words(pa.array([text for _, text in items], pa.string())):
            self.words += [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        hashed, owner, place = [], [], []
        for number, words in enumerate(self.words):
            for seed in range(len(MASKS)):
                runs = seed_hashes(words, seed)
                hashed.append(runs)
                owner.append(np.full(len(runs), number))
                place.append(np.arange(len(runs)))
        empty = [np.zeros(0, dtype=np.uint64)]
        hashed, owner, place = (np.concatenate([x.astype(np.uint64) for x in parts] or empty) for parts in (hashed, owner, place))
        order = np.argsort(hashed, kind="stable")
        self.hashes, self.owner, self.place = hashed[order], owner[order].astype(np.int64), place[order].astype(np.int64)
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[(self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def diagonals(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, shifts) of all hits in a chunk of texts; with a shift, the item's word k meets the text's k + shift.

        Where a run stands many times in a text and in the items, its places are taken as evenly spaced rows, so that
        texts and items of repeated words cost what they are long and not the product.
        """
        found, marks = [], {}
        for seed, mask in enumerate(MASKS):
            runs = seed_hashes(words, seed)
            start = np.flatnonzero(self.table[(runs >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            text = np.searchsorted(at, start, side="right") - 1
            inside = start + len(mask) <= at[text + 1]
            start, text = start[inside], text[inside]
            low = np.searchsorted(self.hashes, runs[start], side="left")
            many = np.searchsorted(self.hashes, runs[start], side="right") - low
            start, text, low, many = (x[many > 0] for x in (start, text, low, many))
            group = np.lexsort((start, low, text))
            first = np.flatnonzero(np.concatenate(([True], (np.diff(low[group]) != 0) | (np.diff(text[group]) != 0)))) if len(group) else group
            times = np.diff(np.append(first, len(group)))
            crowded = times * many[group[first]] > CROWDED
            for k in np.flatnonzero(crowded):
                members = group[first[k]:first[k] + times[k]]
                entries = slice(low[members[0]], low[members[0]] + many[members[0]])
                self._mark(marks, int(text[members[0]]), start[members] - at[text[members[0]]], entries, at)
            single = group[~np.repeat(crowded, times)]
            start, text, low, many = (x[single] for x in (start, text, low, many))
            entry = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            text, start = np.repeat(text, many), np.repeat(start - at[text], many)
            found.append(np.stack([text, self.owner[entry], start - self.place[entry]], axis=1))
        rows = np.unique(np.concatenate(found), axis=0)
        new = np.flatnonzero((np.diff(rows[:, :2], axis=0, prepend=-1) != 0).any(axis=1))
        for a, b in zip(new, np.append(new, len(rows))[1:], strict=True):
            text, item, shifts = int(rows[a, 0]), int(rows[a, 1]), rows[a:b, 2]
            if (text, item) in marks:
                marks[text, item][shifts + len(self.words[item])] = True
            else:
                yield text, item, shifts
        for (text, item), mark in marks.items():
            yield text, item, np.flatnonzero(mark) - len(self.words[item])

    def _mark(self, marks: dict, text: int, places: np.ndarray, entries: slice, at: np.ndarray) -> None:
        """Marks the shifts between all places of a run in a text and in the items."""
        owners, others = self.owner[entries], self.place[entries]
        mine = even_rows(places)
        for item in np.unique(owners):
            length = len(self.words[item])
            mark = marks.setdefault((text, int(item)), np.zeros(length + int(at[text + 1] - at[text]) + 1, dtype=bool))
            for first, step, count in mine:
                for other, other_step, other_count in even_rows(np.sort(others[owners == item])):
                    low = first - other - (other_count - 1) * other_step + length
                    if step == other_step or min(count, other_count) == 1:
                        step_of_both = other_step if count == 1 else step
                        mark[low:low + (count + other_count - 2) * step_of_both + 1:step_of_both] = True
                    elif count < other_count:
                        for k in range(count):
                            mark[low + k * step:low + k * step + (other_count - 1) * other_step + 1:other_step] = True
                    else:
                        for k in range(other_count):
                            mark[low + k * other_step:low + k * other_step + (count - 1) * step + 1:step] = True


def even_rows(places: np.ndarray) -> list[tuple[int, int, int]]:
    """Sorted distinct places as (first, step, count) of evenly spaced ones."""
    found, at, places = [], 0, places.tolist()
    while at < len(places):
        end = at + 1
        step = places[end] - places[at] if end < len(places) else 1
        while end < len(places) and places[end] - places[end - 1] == step:
            end += 1
        found.append((places[at], step, end - at))
        at = end
    return found


def seed_hashes(words: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of all runs under a mask, by where they start."""
    mask = MASKS[seed]
    count = len(words) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(count, seed, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, counts in enumerate(mask):
            if counts == "1":
                total = total * np.uint64(0xD6E8FEB86659FD93) + words[k:k + count]
    return mix(total, 32)


def longest_run(equal: np.ndarray, min_percent: int) -> tuple[int, int]:
    """Start and end of the first of the longest runs with a large enough share of equal words, without unequal ends.

    No run with that share has more equal words: one with m of them can be widened to the whole diagonal or to
    100 * m // min_percent words, and from that length on the share alone demands m equal words.
    """
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 100 - min_percent, -min_percent))))
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    end = int(np.argmax(np.arange(len(sums)) - starts))
    places = np.flatnonzero(equal[starts[end]:end]) + int(starts[end])
    return (int(places[0]), int(places[-1]) + 1) if len(places) else (0, 0)


def best_overlap(own: np.ndarray, test: np.ndarray, shifts: np.ndarray, rule: OverlapRule) -> tuple[int, int, int] | None:
    """(equal words, minus the first word, words) of the best overlap on some diagonals, or None.

    The longest diagonals are walked first; one that is too short to hold a better overlap is not walked.
    """
    begins = np.maximum(0, -shifts)
    stops = np.minimum(len(test), len(own) - shifts)
    order = np.lexsort((shifts, begins - stops))
    best = None
    for shift, begin, stop in zip(shifts[order].tolist(), begins[order].tolist(), stops[order].tolist(), strict=True):
        if best and stop - begin < best[0] or stop - begin < rule.min_matched:
            break
        if best and stop - begin == best[0] and begin + shift >= -best[1]:
            continue
        equal = own[begin + shift:stop + shift] == test[begin:stop]
        if np.count_nonzero(equal) < (best[0] if best else rule.min_matched):
            continue
        a, b = longest_run(equal, rule.min_percent)
        found = (int(equal[a:b].sum()), -(begin + shift + a), b - a)
        if found[0] >= rule.min_matched and (best is None or found > best):
            best = found
    return best


def overlaps(texts: pa.Array, index: SeedIndex, rule: OverlapRule) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, first word, words, equal words) of the best overlap of each text and item."""
    for first, words, at in hashed_words(texts):
        for text, item, shifts in index.diagonals(words, at):
            best = best_overlap(words[at[text]:at[text + 1]], index.words[item], shifts, rule)
            if best:
                yield first + text, item, -best[1], best[2], best[0]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    """The test items, in blocks of about BLOCK_CHARS, dealt by their texts."""
    items = benchmark.select(benchmark[item_col].alias("item"), benchmark[text_col].alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-size // BLOCK_CHARS)
    for number in range(count):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == number)
        yield [(row["item"], row["text"]) for row in block.collect()]


def contaminated(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", rule: OverlapRule = OverlapRule(),
) -> DataFrame:
    """One row per document row and test item that overlap: ids, ``first_word``, ``n_words``, ``n_matched``.

    ``coverage`` is the share of the item's words that the overlap has. Of several overlaps with an item
    the one with the most equal words is given, of equal ones the first. Words are lower-cased in A-Z.
    No overlap is missed under the given rule or a stricter one; a looser one may miss some without a hit.

    The items go to the tasks in blocks of a fixed size and the documents are read once for each block;
    nothing is shuffled. Item ids can be of any type. NULL and empty texts, and items with
    fewer words than the shortest mask or the rule needs, overlap with nothing. Repeated rows and items, and
    NULL ids, are reported as they come. An empty table on either side gives an empty result. Other
    columns are not read, so their names cannot clash.
    """
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    id_kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"`{id_col}` {id_kind}, `{item_col}` {item_kind}, first_word long, n_words long, n_matched long, coverage double"
    result = df.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, item_col, item_text_col):
        index = df.sparkSession.sparkContext.broadcast(SeedIndex(items))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = sorted(overlaps(batch.column(1), index.value, rule))
                text, item, start, length, matched = zip(*rows, strict=True) if rows else ((),) * 5
                names = [index.value.names[number] for number in item]
                share = [m / len(index.value.words[number]) for m, number in zip(matched, item, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(text, pa.int64())), pa.array(names, item_type),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(matched, pa.int64()),
                        pa.array(share, pa.float64()),
                    ],
                    names=[id_col, item_col, "first_word", "n_words", "n_matched", "coverage"],
                )

        result = result.union(docs.mapInArrow(tidy(search), schema))
    return result


def drop_contaminated(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rule: OverlapRule = OverlapRule(),
) -> DataFrame:
    """The rows, with all columns, that overlap with no test item. Edge cases as in ``contaminated``."""
    at = df.columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text_col):
        index = df.sparkSession.sparkContext.broadcast(SeedIndex(items))

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, dtype=bool)
                good[[row[0] for row in overlaps(batch.column(at), index.value, rule)]] = False
                yield batch.filter(pa.array(good))

        df = df.mapInArrow(tidy(clean), df.schema)
    return df
