"""The classifier on held-out labels, and the language model against enumerated segmentations."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from messy import ROWS, empty, messy

from dataproof.llm import subword_classifier as sc
from dataproof.llm.lattice_lm import MARK, Lattice, lattice_scores, vocabulary
from dataproof.llm.queries import QUERIES

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    scores = {r["doc_id"]: r for r in QUERIES["op5_quality_classifier"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert len(scores) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = [(scores[r["doc_id"]]["predicted"], r["quality"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40 and sum(p == q for p, q in held) >= 0.95 * len(held)
    for number, row in scores.items():
        assert row["held_out"] == (zlib.crc32(str(number).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.3)


def test_batches_score_as_single_texts():
    pull = np.random.default_rng(1).normal(size=sc.BUCKETS)
    texts = ["", None, "a", "ab cd ab cd", "same same same", "Ünï çødé", " ", "x" * 3000, "ab cd ab cd"]
    together = sc.mean_pull(pa.array(texts), pull)
    for text, mean in zip(texts, together, strict=True):
        buckets, shares = sc.features(text)
        assert sc.mean_pull(pa.array([text], pa.string()), pull)[0] == pytest.approx(mean)
        assert mean == pytest.approx(float(shares @ pull[buckets]) if len(buckets) else 0.0)


def test_classifier_on_messy_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 1), (8, None), (None, 1), (9, 5)], "doc_id long, quality long")
    model = sc.fit(messy(spark), labels)
    rows = sc.scored(messy(spark), model, score_col="score2").collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score2"] <= 1 for r in rows)
    assert len({r["score2"] for r in rows if r["text"] in (None, "")}) == 1
    assert sc.scored(empty(spark), model, keep=["doc_id"]).count() == 0
    none = sc.fit(empty(spark), labels)
    assert {r["score"] for r in sc.scored(messy(spark), none, keep=["doc_id"]).collect() } and not none.weights.any()


def test_all_segmentations():
    known = vocabulary(PIECES)
    lattice = Lattice(known, {i: (i * 7919) % 1000 for i in range(known.size)})

    def brute(word):
        letters = MARK + word

        @cache
        def ways(at):
            if at == len(letters):
                return 1.0
            total = math.exp(sum(lattice.bytes[b] for b in letters[at].encode())) * ways(at + 1)
            for end in range(at + 1, len(letters) + 1):
                if letters[at:end] in lattice.pieces and MARK not in letters[max(1, at):end]:
                    total += math.exp(lattice.pieces[letters[at:end]]) * ways(end)
            return total

        return math.log(ways(0))

    for word in ("the", "thnderstion", "é", "日本", "a▁b", "▁", "x" * 30, "don't,"):
        assert lattice.word(word) == pytest.approx(brute(word), rel=1e-9)
    assert sum(map(math.exp, lattice.log.values())) == pytest.approx(1)
    assert math.isfinite(lattice.word("x" * 50_000))


def test_base_scores_and_sums(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op7_lattice_lm"](spark, sf_dir).collect()
    words = {number: text.encode().lower().split() for number, text in docs.items()}
    train = [number for number in docs if zlib.crc32(str(number).encode()) % 7 != 2]
    counts = Counter(word for number in train for word in words[number])
    tokens, types = sum(counts.values()) + len(train), len(counts) + 1
    known = vocabulary(PIECES)
    pieces = Counter({known.end: len(train)})
    for word, n in counts.items():
        for i in known.cut([word.decode()])[0]:
            pieces[i] += n
    lattice = Lattice(known, pieces)
    assert len(rows) == len(docs)
    for row in rows:
        own = words[row["doc_id"]]
        base = sum(math.log10((c + 1) / (tokens + types + 1)) for c in [*(counts[w] for w in own), len(train)])
        score = (sum(lattice.word(w.decode()) for w in own) + lattice.end) / math.log(10)
        assert row["base_score"] == pytest.approx(base) and row["score"] == pytest.approx(score)
        assert row["n_known"] == sum(counts[w] > 0 for w in own) + 1 and row["train_tokens"] == tokens
        assert row["n_tokens"] == len(own) + 1 and row["held_out"] == (row["doc_id"] not in train)


def test_lattice_on_messy_rows(spark):
    rows = lattice_scores(messy(spark), PIECES).collect()
    assert len(rows) == len(ROWS) and all(math.isfinite(r["score"]) for r in rows)
    ends = [r for r in rows if r["doc_id"] in (3, 4, 5)]
    assert {r["n_tokens"] for r in ends} == {1} and len({(r["score"], r["base_score"]) for r in ends}) == 1
    twice = [r for r in rows if r["doc_id"] == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert lattice_scores(empty(spark), PIECES).count() == 0
