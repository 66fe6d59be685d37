"""Repeated passages against a search of all windows, and the sketch's one-sided error."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from messy import ROWS, empty, messy
from oracle import both

from dataproof.llm import repeated_passages as rp


def brute(rows, size):
    """(id, words, removed, kept text) of each row."""
    texts = [(doc, (text or "").encode().split()) for doc, text in rows]
    least = {}
    for doc, words in texts:
        for i in range(len(words) - size + 1 if doc is not None else 0):
            key = tuple(words[i:i + size])
            least[key] = min(doc, least.get(key, doc))
    found = []
    for doc, words in texts:
        gone = set()
        for i in range(len(words) - size + 1 if doc is not None else 0):
            if least[tuple(words[i:i + size])] < doc:
                gone |= set(range(i, i + size))
        found.append((doc, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(found, key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()), key=repr)


def test_registered(spark, sf_dir):
    got, expected = both(spark, "op13_repeated_passages", sf_dir)
    assert got == expected and any(row[2] for row in got)


@pytest.mark.parametrize("size, bits", [(1, 16), (2, 16), (7, 16), (7, 3), (50, 16)])
def test_shared_passages(spark, monkeypatch, size, bits):
    """Copies, shared and overlapping passages, repeats inside one text, over many chunks; also when every cell is full."""
    monkeypatch.setattr(rp, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(rp, "BUCKETS_EACH", 1)
    monkeypatch.setattr(rp, "sketch_bits", lambda _: bits)
    monkeypatch.setattr(rp, "SLICE_BITS", min(bits, 16))
    draw = random.Random(size)
    passages = [[f"p{draw.randrange(30)}" for _ in range(draw.randrange(1, 130))] for _ in range(6)]
    rows = []
    for doc in draw.sample(range(-40, 400), 120):
        text = []
        for _ in range(draw.randrange(4)):
            text += [f"w{draw.randrange(2000)}" for _ in range(draw.randrange(40))] + draw.choice(passages)
        rows.append((doc, "\n".join(text[:9]) + "  " + "\t".join(text[9:])))
    rows += rows[:20] + [(doc + 1000, text) for doc, text in rows[:20]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(rp.drop_repeated_passages(df, window=size)) == brute(rows, size)


def test_removed_runs(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (2, f"a b {passage} c {passage}"), (3, f"{passage} end"), (4, passage)]
    found = {r["doc_id"]: r for r in rp.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(map(tuple, found[k]["removed"])) for k in (1, 2, 3, 4)] == [(), ((2, 60), (63, 60)), ((0, 60),), ((0, 60),)]
    assert [found[k]["kept_text"] for k in (2, 3, 4)] == ["a b c", "end", ""]


def test_sketch_only_overestimates():
    """No window of two documents is missed, and a lead is found again wherever the window stands."""
    draw = np.random.default_rng(2)
    shared = [f"s{x}" for x in draw.integers(0, 50, 55)]
    texts = [" ".join([*(f"a{x}" for x in draw.integers(0, 999, n)), *shared, *(f"b{x}" for x in draw.integers(0, 999, 30))]) for n in (0, 1, 17)]
    parts = [rp.Windows(pa.array([text]), 50, np.ones(1, dtype=bool)) for text in texts]
    leads = [set(part.lead[n:n + 6].tolist()) for part, n in zip(parts, (0, 1, 17), strict=True)]
    assert leads[0] == leads[1] == leads[2]
    names = [set(part.names(np.ones(len(part.start), dtype=bool)).tolist()) for part in parts]
    assert len(names[0] & names[1] & names[2]) == 6
    assert rp.sketch_bits(0) == rp.FEWEST_BITS and rp.sketch_bits(1 << 60) == rp.MOST_BITS


def test_messy_rows(spark):
    assert rows_of(rp.drop_repeated_passages(messy(spark), window=5)) == brute([row[:2] for row in ROWS], 5)
    assert rp.drop_repeated_passages(empty(spark)).count() == 0
