"""Token files, byte-pair encoding and length histograms against the tokenizers library."""

from __future__ import annotations

import struct
import zlib

import public_tokenizers
import pytest
from messy import ROWS, empty, messy
from tokenizers import Tokenizer

from dataproof.llm import bpe
from dataproof.llm.bpe import WordBpe, bpe_round_trip
from dataproof.llm.length_histogram import encoded_lengths, length_histogram, quantiles, totals_at
from dataproof.llm.pieces import PieceEncoder
from dataproof.llm.queries import QUERIES
from dataproof.llm.token_files import open_numbers, read_index, read_token_files, store, write_token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a  b", " x", "x ", "İstanbul ΣΑΣ ς Σ", "<|endoftext|>hi <|startoftext|> x<|endoftext|>", "é ﬁ Å",
    "a\x1cb\x1d c", "it's we'll I'D 12345 ½ ²", "日本語 テスト😀😀 ​ x　y\xa0z\x85w", "\t\n a\n\n  b \r\n c", "don't  stop",
    "foo   \n\n bar", "  lead", "trail  ", "\x00\x01\x7f", "᠎ q", "x" * 3000, "the the the", "a <|endoftext|> b",
]


@pytest.fixture(scope="module")
def library():
    return {path: Tokenizer.from_file(path) for path in (BYTE, WORD)}


def ids_of(encoded: bytes) -> list[int]:
    return list(memoryview(encoded).cast("I"))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, text):
    bpe = WordBpe.load(WORD)
    expected = library[WORD].encode(text, add_special_tokens=False).ids
    assert ids_of(bpe.encode(text)) == expected
    assert bpe.decode(bpe.encode(text)) == library[WORD].decode(expected, skip_special_tokens=False)
    assert ids_of(PieceEncoder.load(BYTE).encode([text])[0]) == library[BYTE].encode(text, add_special_tokens=False).ids


def test_bpe_rows(spark, library):
    rows = bpe_round_trip(messy(spark), WORD).collect()
    assert len(rows) == len(ROWS)
    got = sorted((row["doc_id"] or -1, ids_of(row["ids"]), row["decoded"]) for row in rows)
    expected = []
    for number, text, _ in ROWS:
        ids = library[WORD].encode(text or "", add_special_tokens=False).ids
        expected.append((number or -1, ids, library[WORD].decode(ids, skip_special_tokens=False)))
    assert got == sorted(expected)
    assert bpe_round_trip(empty(spark), WORD).count() == 0


def test_token_files(spark, library, tmp_path):
    folder = str(tmp_path / "tokens")
    index = write_token_files(messy(spark), folder, BYTE, end_id=2)
    assert index == read_index(folder) and index["type"] == "<u2"
    rows = sorted(read_token_files(spark, folder).collect(), key=lambda row: row["start"])
    order = sorted(ROWS, key=lambda row: (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or ""))
    at = 0
    for row, (number, text, _) in zip(rows, order, strict=True):
        ids = library[BYTE].encode(text or "", add_special_tokens=False).ids + [2]
        assert (row["doc_id"], row["start"], row["n_tokens"], ids_of(row["ids"])) == (number, at, len(ids), ids)
        at += len(ids)
    where, base = store(folder)
    flat = sum(len(open_numbers(where, f"{base}/part-{part['part']:05d}.ids", index["type"])) for part in index["parts"])
    assert flat == at


def test_no_documents(spark, tmp_path):
    folder = str(tmp_path / "none")
    assert write_token_files(empty(spark), folder, BYTE, end_id=2)["parts"] == []
    assert read_token_files(spark, folder).count() == 0


def test_registered_token_files(spark, sf_dir, library):
    rows = QUERIES["op2_token_files"](spark, sf_dir).collect()
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    at = 0
    for row in sorted(rows):
        ids = library[BYTE].encode(texts[row["doc_id"]], add_special_tokens=False).ids + [2]
        assert tuple(row) == (row["doc_id"], at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert len(rows) == len(texts)


def test_histogram(spark, sf_dir, library):
    rows = QUERIES["op9_token_counts"](spark, sf_dir).collect()
    texts = [row["text"] for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    lengths = [len(x.ids) for x in library[BYTE].encode_batch(texts, add_special_tokens=False)]
    assert sorted(row["length"] for row in rows) == sorted(set(lengths))
    for row in rows:
        n = row["length"]
        assert row["n_docs"] == lengths.count(n) and row["n_tokens"] == n * row["n_docs"]
        assert row["docs_at_least"] == sum(x >= n for x in lengths) and row["docs_up_to"] == sum(x <= n for x in lengths)
        assert row["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert row["truncated_tokens"] == sum(min(x, n) for x in lengths) and row["all_docs"] == len(lengths)


def test_limits_and_quantiles(spark):
    lengths = [0, 1, 1, 2, 5000, 5000, 70000, None]
    whole = [x or 0 for x in lengths]
    histogram = length_histogram(spark.createDataFrame([(x,) for x in lengths], "length long"))
    for row in totals_at(histogram, [1, 2, 4096, 10**6]).collect():
        limit = row["context_limit"]
        assert row["docs_cut"] == sum(x > limit for x in whole) and row["tokens"] == sum(whole)
        assert row["tokens_kept"] == sum(min(x, limit) for x in whole)
    found = {row["share"]: row["length"] for row in quantiles(histogram, [0.25, 0.5, 1.0]).collect()}
    assert found == {0.25: 0, 0.5: 1, 1.0: 70000}
    assert length_histogram(encoded_lengths(empty(spark), BYTE)).count() == 0
    assert encoded_lengths(messy(spark), BYTE).count() == len(ROWS)


def test_remembered_chunks(monkeypatch):
    """What an encoder remembers is bounded, what comes again stays, and ids do not depend on it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"often word{k} and w{k * 7}x again" for k in range(60)] * 2
    free = WordBpe(path)
    want = [free.encode(text) for text in texts]
    monkeypatch.setattr(bpe, "MOST_KEPT", 20)
    tight = WordBpe(path)
    assert [tight.encode(text) for text in texts] == want
    assert len(tight._known) + len(tight._before) <= 2 * 20 + 10
    assert "often" in tight._known | tight._before
