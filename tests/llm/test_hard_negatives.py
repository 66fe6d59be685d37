"""Hard negatives against a plain search, and the stream on its own."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from oracle import both
from pyspark.sql import functions as F

from dataproof.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score long, number long, key string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, "k", 3) for row in rows], SCHEMA)


def brute(rows, every, rule=hn.Mining(), scale=256):
    """All result rows, by lists."""
    usable = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for at, (anchor, own, label) in enumerate(usable):
        if anchor % every:
            continue
        scored = [
            (-sum(a * b for a, b in zip(own, v, strict=True)), i, other == label)
            for k, (i, v, other) in enumerate(usable) if k != at and len(v) == len(own)
        ]
        scored.sort(key=lambda x: x[:2])
        for p, positive, _ in [x for x in scored if x[2]][:rule.positives]:
            inside = [(n, i) for n, i, same in scored if not same and rule.low * -p <= 100 * -n <= rule.high * -p]
            found += [(anchor, positive, k, i, -p, -n) for k, (n, i) in enumerate(inside[:rule.negatives], 1)]
    return sorted(found)


def test_registered(spark, sf_dir):
    got, expected = both(spark, "op11_hard_negatives", sf_dir)
    assert got == expected and got


def test_ties_repeats_and_blocks(spark, monkeypatch):
    """Few distinct vectors, so most scores tie; repeated rows; small blocks of anchors."""
    monkeypatch.setattr(hn, "BLOCK_ROWS", 25)
    draw = random.Random(4)
    kinds = [[draw.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(3)] for _ in range(5)]
    rows = [(draw.randrange(40), draw.choice(kinds), draw.randrange(3)) for _ in range(160)]
    rows += rows[:30] + [(8, kinds[0], 1)] * 20
    for rule in (hn.Mining(), hn.Mining(positives=2, negatives=9, low=0, high=100)):
        got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 4 == 0, rule=rule).collect()
        assert sorted(map(tuple, got)) == brute(rows, 4, rule)


def test_messy_rows(spark):
    rows = [
        (None, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, None, 1), (3, [1.0, None], 2), (4, [float("nan"), 1.0], 2),
        (5, [float("inf"), 1.0], 2), (6, [1.0, 0.5], None), (7, [0.9, 0.8], 2), (8, [], 2), (10, [], 3), (11, [1.0] * 5, 1), (20, [1.0] * 5, 1),
        (21, [0.7] * 5, 2), (-10, [-1.0, -1.0], 1),
    ]
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10) and len(got) > 1
    assert hn.hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(frame(spark, rows), F.col("vec_id") == 99).count() == 0


def test_exact_products():
    left, right = np.array([[1 << 40, 3]]), np.array([[1 << 20, 5], [-7, 1]])
    assert hn.products(left, right).tolist() == [[(1 << 60) + 15, -7 * (1 << 40) + 3]]
    with pytest.raises(OverflowError):
        hn.products(np.array([[1 << 50]]), np.array([[1 << 50]]))
    with pytest.raises(ValueError):
        hn.Mining(low=90, high=50)


def test_stream_holds_windows_only():
    """Keys sort as their fields do, and a window closes when it is full or the scores have left it."""
    records = [(5, 1, 100, hn.POSITIVE, 7, 1), (5, 1, 0, hn.POSITIVE, 9, 1), *[(5, 1, s, hn.NEGATIVE, 20 + s, 1) for s in (-3, 0, 40, 60, 70, 96)]]
    keys = pa.concat_arrays([hn.pack(*[np.array([x]) for x in record]) for record in records])
    keys = pa.array(sorted(keys.to_pylist()))
    assert [r[2] for r in hn.unpacked(keys)] == [100, 96, 70, 60, 40, 0, 0, -3]
    assert list(hn.windows(iter([keys.slice(0, 3), keys.slice(3)]), hn.Mining())) == [
        (5, 7, 1, 90, 100, 70), (5, 7, 2, 80, 100, 60), (5, 9, 1, 20, 0, 0),
    ]
