"""The audit against plain counting in fractions, and the trees against all cells."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from messy import empty, messy
from oracle import both

from dataproof.llm import source_divergence as sd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, audit):
    """All result rows of (text, lang, source)."""
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(words)
        documents[lang].update(set(words))
        groups[lang].add(source)
    found = []
    for lang, sources in groups.items():
        kept = [term for term, n in documents[lang].items() if n >= audit.min_documents]
        whole = Counter()
        for source in sources:
            whole.update({term: counts[lang, source][term] for term in kept})

        def shares(own, kept=kept):
            total = sum(own[term] for term in kept)
            return {term: 1 + 10**9 * (own[term] + audit.smoothing) // (total + audit.smoothing * len(kept)) for term in kept}

        p, q = {source: shares(counts[lang, source]) for source in sources}, shares(whole)
        for source in sources:
            pairs = [(-sum(abs(p[source][t] - p[other][t]) for t in kept), other.encode(), other) for other in sources - {source}]
            own = [(q[t] - p[source][t], t.encode(), t) for t in kept if counts[lang, source][t] and p[source][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(own)[:audit.top])):
                found += [(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(items, 1)]
    return sorted(found)


def test_registered(spark, sf_dir):
    got, expected = both(spark, "op12_source_divergence", sf_dir)
    assert got == expected and got


@pytest.mark.parametrize("tile, stripe", [(64, 1024), (2, 8), (4, 3)])
def test_tiles_and_stripes(spark, monkeypatch, tile, stripe):
    """Many sources over several tiles and stripes, sources without terms, a language without kept terms."""
    monkeypatch.setattr(sd, "TILE", tile)
    monkeypatch.setattr(sd, "STRIPE", stripe)
    draw = random.Random(2)
    rows = [
        (" ".join(draw.choice("abcdefghij") + draw.choice(["", "É", "x", "Q"]) for _ in range(draw.randrange(9))), draw.choice(["en", "fr"]), f"s{draw.randrange(9)}")
        for _ in range(200)
    ]
    rows += [(None, "en", "silent"), ("9 9", "en", None), ("once", "xx", "a"), ("twice", "xx", "b"), ("alone", None, None)]
    audit = sd.Audit(min_documents=3, smoothing=5, top=4)
    got = sd.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string"), audit=audit).collect()
    assert sorted(map(tuple, got)) == brute(rows, audit)


def test_trees():
    """Pairs of trees give the sums of all cells, whatever is empty."""
    draw = np.random.default_rng(1)
    for filled in (0.0, 0.02, 0.3, 1.0):
        left, right = (np.where(draw.random((8, 24)) < filled, draw.integers(1, 99, (8, 24)), 0) for _ in range(2))
        zeros = draw.integers(1, 9, 8), draw.integers(1, 9, 8)
        total, priced = sd.compared(left, right, *zeros)
        a, b = (np.where(m != 0, m, z[:, None]) for m, z in zip((left, right), zeros, strict=True))
        assert priced == 24 and (total == np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2)).all()
    assert [level.shape for level in sd.tree(np.ones((4, 8), dtype=bool))] == [(4, 8), (2, 4), (1, 2)]


def test_messy_rows(spark):
    audit = sd.Audit(min_documents=2)
    rows = [(r["text"], r["host"], r["lang"]) for r in messy(spark).collect()]
    got = sd.source_divergence(messy(spark), lang_col="host", source_col="lang", audit=audit).collect()
    assert sorted(map(tuple, got)) == brute(rows, audit) and got
    assert sd.source_divergence(empty(spark), source_col="host").count() == 0


def test_large_counts(spark):
    """Shares stay exact where a product would leave 64 bits."""
    df = spark.createDataFrame([(10**13 + 7, 3 * 10**14, 10**6)], "n long, total long, terms long")
    assert df.select(sd.share("n", "total", "terms", 5)).first()[0] == 1 + 10**9 * (10**13 + 12) // (3 * 10**14 + 5 * 10**6)
