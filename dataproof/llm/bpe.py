"""Byte-pair encoding of words, and decoding, from a tokenizer file's vocabulary and merges."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dataproof.llm.workers import tidy

TEXTS_AT_ONCE = 256
#: Chunks remembered in a worker, and the longest that is; when there are more, those are kept that come again before there
#: are as many others.
MOST_KEPT = 125_000
LONGEST_KEPT = 64

#: White space as Unicode's property has it, which Python's own splitting widens by \x1c-\x1f.
_BLANK = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_BLANKS = re.compile(f"[{_BLANK}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")

_LOADED: dict[str, WordBpe] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(byte) if byte in plain else chr(next(spare)) for byte in range(256)]


class WordBpe:
    """A tokenizer file with lower-cased words, merges and a mark at the end of each word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        normal = [step["type"] for step in content["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or normal != ["NFC", "Replace", "Lowercase"] or content["decoder"] is not None:
            raise ValueError(f"{path} is not a word BPE tokenizer of the kind known here")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {token["content"]: token["id"] for token in content["added_tokens"]}
        self.strings = {number: string for string, number in (self.vocabulary | self.special).items()}
        pairs = (pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"])
        self.merges = {
            (self.vocabulary[a], self.vocabulary[b]): (rank, self.vocabulary[a + b])
            for rank, (a, b) in enumerate(pairs)
        }
        pattern = content["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"\s", _BLANK), regex.V0)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.characters = byte_characters()
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    @staticmethod
    def load(path: str) -> WordBpe:
        """One encoder for each file and Python worker."""
        if path not in _LOADED:
            _LOADED[path] = WordBpe(path)
        return _LOADED[path]

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges by rank, leftmost first, to a doubly linked list of symbols.

        The queue holds every pair that could be merged when it was adjacent; an entry whose
        symbols have changed since is stale and skipped.
        """
        merges = self.merges
        last = len(symbols) - 1
        before = list(range(-1, last))
        after = list(range(1, last + 2))
        queue = []
        for at in range(last):
            found = merges.get((symbols[at], symbols[at + 1]))
            if found is not None:
                queue.append((found[0], at, symbols[at], symbols[at + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, at, left, right, merged = heapq.heappop(queue)
            follower = after[at]
            if symbols[at] != left or follower > last or symbols[follower] != right:
                continue
            symbols[at] = merged
            symbols[follower] = -1
            after[at] = beyond = after[follower]
            if beyond <= last:
                before[beyond] = at
                found = merges.get((merged, symbols[beyond]))
                if found is not None:
                    heapq.heappush(queue, (found[0], at, merged, symbols[beyond], found[1]))
            earlier = before[at]
            if earlier >= 0:
                found = merges.get((symbols[earlier], merged))
                if found is not None:
                    heapq.heappush(queue, (found[0], earlier, symbols[earlier], merged, found[1]))
        return [symbol for symbol in symbols if symbol >= 0]

    def _word(self, word: str) -> list[int]:
        """The ids of one piece of the splitting pattern."""
        letters = [self.characters[byte] for byte in word.encode("utf-8", "surrogatepass")]
        letters[-1] += self.suffix
        return self.merge([self.vocabulary[letter] for letter in letters if letter in self.vocabulary])

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a run without white space."""
        ids = [number for word in self.pattern.findall(chunk) for number in self._word(word)]
        return b"".join(number.to_bytes(4, "little") for number in ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return self._encode_plain(text)
        return b"".join(
            self.special[part].to_bytes(4, "little") if part in self.special else self._encode_plain(part)
            for part in self.special_pattern.split(text)
        )

    def _encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            # Lower case letter by letter: the sigma that ends a word stays as any other.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        lowered = text.lower()
        chunks = lowered.split() if _SEPARATORS.search(lowered) is None else _BLANKS.split(lowered)
        known = self._known
        try:
            return b"".join([known[chunk] for chunk in chunks])
        except KeyError:
            pass
        if len(known) > MOST_KEPT:
            self._before, self._known = known, {}
            known = self._known
        before = self._before
        found = []
        for chunk in chunks:
            ids = known.get(chunk)
            if ids is None:
                ids = before.get(chunk)
                if ids is None:
                    ids = self._chunk(chunk)
                if len(chunk) <= LONGEST_KEPT:
                    known[chunk] = ids
            found.append(ids)
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, joined as the library joins them without a decoder."""
        return " ".join([self.strings[number] for number in memoryview(ids).cast("I")])


def bpe_round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again: the id, ``n_tokens``, ``ids`` and ``decoded``.

    ``ids`` are little-endian unsigned 32-bit integers. One narrow pass; a text's cost grows with its
    length, and equal words cost a look-up. NULL and empty texts, and texts of white space, have no
    ids and an empty decoding. Ids may be NULL or repeat: every row is encoded by itself, equal texts
    alike. An empty table gives an empty result. Other columns are not read, so they cannot clash.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                ids = [bpe.encode(text or "") for text in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([bpe.decode(x) for x in ids], pa.string()),
                    ],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col], df[text_col]).mapInArrow(
        tidy(encode), f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string"
    )
