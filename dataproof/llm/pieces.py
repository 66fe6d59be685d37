"""Encoding with a tokenizer file, for many texts that share most of their words."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from dataproof.llm.words import hash_pieces, text_chunks

#: Bits of the table of remembered parts; when it is a quarter full, or their ids are so many, remembering starts anew.
TABLE_BITS, MOST_IDS = 22, 1 << 24
#: Marks that byte-level splitting cuts off the letters before them.
MARKS = b".,;:!?"


def _bytes(*ranges: range) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    for some in ranges:
        found[list(some)] = True
    return found


_PRINTED = _bytes(range(0x21, 0x7F))
_LETTER = _bytes(range(65, 91), range(97, 123))
_MARK = _bytes(MARKS)
#: First bytes of characters of two, three and four bytes, in ranges that have no white space.
_TWO, _THREE, _FOUR = _bytes(range(0xC3, 0xE0)), _bytes(range(0xE4, 0xEE)), _bytes(range(0xF0, 0xF5))
_LEADS = _PRINTED | _TWO | _THREE | _FOUR

_LOADED: dict[str, PieceEncoder] = {}


def part_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where byte-level splitting surely cuts: before each text, before a space between characters that are no white
    space, and before a mark behind an unaccented letter."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[at] = True
    if len(data) > 2:
        before = np.zeros(len(data), dtype=bool)
        before[1:] = _PRINTED[data[:-1]]
        for width, leads in ((2, _TWO), (3, _THREE), (4, _FOUR)):
            before[width:] |= leads[data[:-width]]
        cut[:-2] |= (data[:-1] == 32) & before[:-1] & _LEADS[data[1:]]
        cut[1:-1] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    return np.flatnonzero(cut[:-1])


class PieceEncoder:
    """Ids of whole texts under a byte-level tokenizer file, as the tokenizers library gives them.

    Texts are cut into parts that byte-level splitting would cut apart as well. The library encodes every new part
    once; a text's ids are its parts' ids in order. Parts are looked up by 64-bit hashes of their bytes. Only
    files without a normalizer and with a plain byte-level splitter can be cut in this way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        splitter = self.tokenizer.pre_tokenizer
        cut_apart = any(
            re.search(r"[A-Za-z][.,;:!?]|\s", token.content) or token.lstrip or token.rstrip
            for token in self.tokenizer.get_added_tokens_decoder().values()
        )
        if self.tokenizer.normalizer is not None or type(splitter).__name__ != "ByteLevel" or splitter.add_prefix_space or cut_apart:
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._forget()

    @staticmethod
    def load(path: str) -> PieceEncoder:
        """One encoder for each file and Python worker."""
        if path not in _LOADED:
            _LOADED[path] = PieceEncoder(path)
        return _LOADED[path]

    def _forget(self) -> None:
        """Remembered parts: their hashes and numbers in a table, and the place and number of each one's ids."""
        self._hashes = np.zeros(1 << TABLE_BITS, dtype=np.uint64)
        self._numbers = np.zeros(1 << TABLE_BITS, dtype=np.int32)
        self._ids = np.zeros(1 << 16, dtype=self.type)
        self._at = np.zeros(1 << 12, dtype=np.int64)
        self._parts = 0

    def _found(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each part, -1 for new ones: its place in the table, or the first free one behind."""
        mask = np.uint64((1 << TABLE_BITS) - 1)
        place = hashes & mask
        there = self._hashes[place]
        found = np.where(there == hashes, self._numbers[place], -1)
        open_ = np.flatnonzero((there != hashes) & (there != 0))
        while len(open_):
            place[open_] = (place[open_] + np.uint64(1)) & mask
            there = self._hashes[place[open_]]
            hit = there == hashes[open_]
            found[open_[hit]] = self._numbers[place[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return found

    def _remember(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """Adds distinct new parts."""
        first, count = self._parts, len(ids)
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        new = np.array(array("I", [x for part in ids for x in part]), dtype=self.type)
        used = int(self._at[first])
        if used + len(new) > len(self._ids):
            self._ids = np.concatenate([self._ids[:used], np.zeros(max(len(new), used, 1 << 16) + len(new), dtype=self.type)])
        self._ids[used:used + len(new)] = new
        if first + count + 1 > len(self._at):
            self._at = np.concatenate([self._at[:first + 1], np.zeros(2 * (first + count), dtype=np.int64)])
        self._at[first + 1:first + count + 1] = used + np.cumsum(lengths)
        self._parts += count
        mask = np.uint64((1 << TABLE_BITS) - 1)
        left, place = np.arange(count), hashes & mask
        while len(left):
            # Of parts that want one free place the first gets it, the others go on.
            free = self._hashes[place[left]] == 0
            _, one = np.unique(place[left[free]], return_index=True)
            taken = left[free][one]
            self._hashes[place[taken]] = hashes[taken]
            self._numbers[place[taken]] = first + taken
            left = np.setdiff1d(left, taken, assume_unique=True)
            place[left] = (place[left] + np.uint64(1)) & mask

    def parts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a chunk of texts: the number of every part, and at which part each text starts (and the last ends)."""
        if self._parts > 1 << (TABLE_BITS - 2) or len(self._ids) > MOST_IDS:
            self._forget()
        starts = part_starts(data, at)
        hashes = hash_pieces(data, starts)
        numbers = self._found(hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            _, one = np.unique(hashes[new], return_index=True)
            one = new[one]
            ends = np.append(starts, len(data))[one + 1]
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[one].tolist(), ends.tolist(), strict=True)]
            encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            self._remember(hashes[one], [x.ids for x in encoded])
            numbers[new] = self._found(hashes[new])
        return numbers, np.searchsorted(starts, at)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of every text; 0 for NULL."""
        found = np.zeros(len(texts), dtype=np.int64)
        for first, end, data, at in text_chunks(texts):
            numbers, part = self.parts(data, at)
            sums = np.concatenate(([0], np.cumsum(np.diff(self._at[:self._parts + 1])[numbers])))
            found[first:end] = np.diff(sums[part])
        return found

    def encoded(self, texts: pa.Array, end_id: int | None = None):
        """Chunks of (ids of all texts one after another, the number of each text's ids); NULL is an empty text.

        With ``end_id`` every text ends with it; the integers are then wide enough for it as well.
        """
        kind = self.type if end_id is None or end_id <= np.iinfo(self.type).max else np.dtype("<u4")
        for _, _, data, at in text_chunks(texts):
            numbers, part = self.parts(data, at)
            many = np.diff(self._at[:self._parts + 1])[numbers]
            sums = np.concatenate(([0], np.cumsum(many)))
            place = np.arange(sums[-1])
            ids = self._ids[np.repeat(self._at[numbers] - sums[:-1], many) + place].astype(kind, copy=False)
            counts = np.diff(sums[part])
            if end_id is not None:
                whole = np.full(len(ids) + len(counts), end_id, dtype=kind)
                whole[place + np.repeat(np.arange(len(counts)), counts)] = ids
                ids, counts = whole, counts + 1
            yield ids, counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; none for None."""
        found = []
        for ids, counts in self.encoded(pa.array(texts, pa.string())):
            found += [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]
        return found
