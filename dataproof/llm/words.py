"""Words of whole texts as 64-bit hashes, computed for a batch of texts at once.

A word is a run of characters other than space and ``\\x09-\\x0D``; A-Z are lower-cased first.
Everything works on the bytes of an Arrow string array, so no text becomes a Python string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=np.uint64)


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all bits and on the salt."""
    x = values ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def gathered(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, and where each starts (and the last ends)."""
    at = np.concatenate(([0], np.cumsum(end - begin)))
    return data[np.repeat(begin - at[:-1], end - begin) + np.arange(at[-1])], at


def _powers(longest: int) -> np.ndarray:
    """Powers of the base, as many as the longest word seen needs."""
    global _POWERS
    if len(_POWERS) < longest:
        steps = np.full(max(longest, 2 * len(_POWERS)), _BASE, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text starts and the last ends. Nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset:]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]], at - at[0]


def text_chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First text, end text, bytes and text offsets of chunks of about CHUNK_BYTES."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, at = text_bytes(texts)
    first = 0
    while first < len(at) - 1:
        end = int(np.searchsorted(at, at[first] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(at) - 1)
        yield first, end, data[at[first]:at[end]], at[first:end + 1] - at[first]
        first = end


def word_spans(
    data: np.ndarray, at: np.ndarray, between: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and at which word each text starts (and the last ends).

    ``between`` tells for each byte whether it lies between words; without it, white space does.
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(at), dtype=np.int64)
    inside = ~between[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < len(data)]
    starts[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | starts[1:]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, at)


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and do not overlap."""
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    length = end - begin
    total = int(length.sum())
    offset = np.cumsum(length) - length
    place = np.arange(total, dtype=np.int64) - np.repeat(offset, length)
    taken = data[np.repeat(begin, length) + place]
    terms = (taken.astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[place]
    return mix(np.add.reduceat(terms, offset) + length.astype(np.uint64))


def hash_pieces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash, never 0, of each piece of the bytes; a piece ends where the next one starts."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    length = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, length)
    terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[place]
    return mix(np.add.reduceat(terms, starts) + length.astype(np.uint64)) | np.uint64(1)


def hashed_words(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of texts: the first text's number, all word hashes, and where each text's words start."""
    for first, _, data, at in text_chunks(texts):
        lowered = _LOWER[data]
        begin, end, words = word_spans(lowered, at)
        yield first, hash_spans(lowered, begin, end), words


def text_words(text: str | None) -> list[bytes]:
    """The words of one text as lower-cased bytes; bytes.split and bytes.lower know ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of a shorter text its whole sequence, of none nothing."""
    if not len(words):
        return words
    width = min(size, len(words))
    with np.errstate(over="ignore"):
        rolled = np.full(len(words) - width + 1, np.uint64(width), dtype=np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[k:k + len(rolled)]
    return mix(rolled, 1)
