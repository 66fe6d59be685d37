"""The parity-sketch join against all pairs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from messy import ROWS, empty, messy

from dataproof.llm import components as co
from dataproof.llm import parity_join as pj
from dataproof.llm import workers
from dataproof.llm.components import components
from dataproof.llm.queries import QUERIES


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    """doc_id: (set size, smallest id reachable)."""
    sets = {number: shingles(text) for number, text in rows}
    where = defaultdict(list)
    for number, own in sets.items():
        for shingle in own:
            where[shingle].append(number)
    parent = {number: number for number in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for number, own in sets.items():
        for other, common in Counter(y for s in own for y in where[s] if y > number).items():
            if 100 * common >= 80 * (len(own) + len(sets[other]) - common):
                a, b = find(number), find(other)
                parent[max(a, b)] = min(a, b)
    return {number: (len(own), find(number)) for number, own in sets.items()}


def test_registered(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op6_ngram_jaccard"](spark, sf_dir).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("size", [*range(4, 30), 60, 151, 400])
def test_linked_sets_meet(size):
    """Sets that differ as much as the rule allows share a key, and their sketches tell."""
    draw = np.random.default_rng(size)
    for _ in range(40):
        own = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
        larger = int(draw.integers(size, size * 5 // 4 + 1))
        most = int(pj.most_apart(size, larger))
        gone = (most - (larger - size)) // 2
        if gone < 0:
            continue
        other = np.unique(np.concatenate([own[gone:], draw.integers(0, 1 << 63, larger - size + gone).astype(np.uint64)]))
        assert len(np.intersect1d(pj.block_keys(own), pj.block_keys(other)))
        sketches = [np.frombuffer(pj.dense_sketch(x), np.uint8) for x in (own, other)]
        assert pj.apart(*sketches) <= most
        assert all(8 * len(sketch) < max(65, 2 * len(x)) for sketch, x in zip(sketches, (own, other), strict=True))


@pytest.mark.parametrize("once", [True, False])
def test_pairs_of_unlike_lengths(once):
    """Sketches of all lengths in one tile: what is compared is what the two sketches alone say."""
    draw = np.random.default_rng(3)
    base = np.unique(draw.integers(0, 1 << 63, 400).astype(np.uint64))
    sets = [np.concatenate([base[:n], draw.integers(0, 1 << 63, 3).astype(np.uint64)]) for n in draw.integers(200, 380, 80)]
    sketches = [pj.dense_sketch(x) for x in sets]
    labels, counts = draw.integers(0, 9, 80), np.array([len(x) for x in sets])
    halves = [np.arange(80)] * 2 if once else [np.arange(30), np.arange(30, 80)]
    tiles = [([sketches[k] for k in half], labels[half], counts[half]) for half in halves]
    got = {(*sorted((int(halves[0][i]), int(halves[1][j]))), differ) for i, j, differ in pj.near_folded(*tiles, once).tolist()}
    want = set()
    for i in halves[0].tolist():
        for j in halves[1].tolist():
            differ = pj.apart(*[np.frombuffer(sketches[k], np.uint8) for k in (i, j)])
            fits = min(counts[i], counts[j]) * 100 >= max(counts[i], counts[j]) * 80
            if labels[i] != labels[j] and fits and differ <= pj.most_apart(counts[i], counts[j]):
                want.add((min(i, j), max(i, j), differ))
    assert got == want and len(want) > 20


def test_later_rounds_deal_what_is_open(spark, monkeypatch):
    """Sets that have named all of theirs are not dealt to their blocks again."""
    draw = random.Random(7)

    def prose(n):
        return [f"w{draw.randrange(4000)}" for _ in range(n)]

    rows, passage = [], prose(60)
    for _ in range(3):
        base = prose(200)
        for _ in range(14):
            base[draw.randrange(200)] = f"changed{draw.randrange(999)}"
            rows.append((len(rows), " ".join(base)))
    rows += [(len(rows) + k, " ".join(prose(100) + passage + prose(100))) for k in range(40)]
    rounds, real = [], pj._nearest_apart

    def watched(mixed, sets, many):
        named = real(mixed, sets, many)
        full = {r["doc"] for r in named.where(named["rank"] == many).collect()}
        rounds.append(({r["doc"] for r in mixed.collect()}, full))
        return named

    monkeypatch.setattr(pj, "_nearest_apart", watched)
    monkeypatch.setattr(pj, "_first_pairs", lambda met: met.where("kind = 9").select("a", "b"))
    monkeypatch.setattr(pj, "FIRST_ROUNDS", 0)
    monkeypatch.setattr(pj, "MORE", 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in pj.parity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert rounds and any(doc >= 42 for doc in rounds[0][0]) and rounds[0][1]
    for (_, full), (dealt, _) in zip(rounds, rounds[1:], strict=False):
        assert dealt <= full

def test_groups_and_shared_passages(spark):
    """Copies, near copies of near copies, and texts that only share a passage."""
    draw = random.Random(5)

    def prose(n):
        return [f"w{draw.randrange(400)}" for _ in range(n)]

    rows, passage = [], prose(60)
    for group in range(12):
        base = prose(draw.choice([7, 20, 90, 300]))
        for _ in range(12):
            base = list(base)
            if draw.random() < 0.7:
                for _ in range(max(1, len(base) // 60)):
                    base[draw.randrange(len(base))] = "changed" + str(draw.randrange(9))
            rows.append((len(rows), " ".join(base)))
    rows += [(len(rows) + k, " ".join(prose(150) + passage + prose(150))) for k in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in pj.parity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_messy_rows(spark):
    rows = pj.parity_join(messy(spark)).collect()
    assert len(rows) == len(ROWS)
    found = sorted(((r["doc_id"], r["component_id"]) for r in rows), key=str)
    assert found == sorted([
        (1, 1), (1, 1), (2, 1), (None, 1), (None, None), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 8), (10, 10),
    ], key=str)
    assert pj.parity_join(empty(spark)).count() == 0
    stay = pj.one_of_each(messy(spark))
    assert stay.columns == messy(spark).columns
    assert sorted((r["doc_id"] or 0) for r in stay.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8, 10]


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r["doc"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("at_once", [1 << 17, 7])
def test_few_links_take_no_rounds(spark, monkeypatch, at_once):
    """Links that fit a task are contracted there, in one table; more of them, in rounds, give the same, also on top of labels."""
    kept, real = [], co.keep_table
    monkeypatch.setattr(co, "keep_table", lambda df, name: kept.append(name) or real(df, name))
    monkeypatch.setattr(co, "AT_ONCE", at_once)
    links = [(k + 1, k) for k in range(300, 340)] + [(k, k + 500) for k in range(1, 30)]
    labels = co.merged(None, spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {r["doc"]: r["component"] for r in labels.collect()} == {
        **{k: 300 for k in range(300, 341)}, **{k: k for k in range(1, 30)}, **{k + 500: k for k in range(1, 30)},
    }
    assert at_once == 7 or kept == ["labels"]
    more = [(340, 529), (1, 2), (2, 3), (900, 901)]
    got = {r["doc"]: r["component"] for r in co.merged(labels, spark.createDataFrame(more, "a long, b long")).collect()}
    assert got == {
        **{k: 29 for k in (*range(300, 341), 29, 529)}, **{k: 1 for k in (1, 2, 3, 501, 502, 503)}, 900: 900, 901: 900,
        **{k: k for k in range(4, 29)}, **{k + 500: k for k in range(4, 29)},
    }
    assert at_once == 7 or kept == ["labels"] * 2


def python_steps(plan, above=0):
    """The most Python steps that one task runs at a time."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return python_steps(plan.inputPlan(), above)
    own = 0 if "Exchange" in name else above + (name == "MapInArrow")
    below = plan.children()
    return max([own, *(python_steps(below.apply(k), own) for k in range(below.size()))])


def test_links_are_verified_in_tasks_of_their_own(spark):
    """Few pairs are broadcast; even then no task chooses texts and verifies them in two Python workers at a time."""
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, text + f" t{k}" * (k % 3)) for k in range(40)] + [(99, "other words"), (None, text)], "doc long, text string")
    rows = {r["doc"]: np.uint64(pj.identity(next(s for _, s in pj.text_sets(pa.array([r["text"]]))))[0]) & pj._ID_MASK for r in docs.collect()}
    pairs = [(a, b, int(rows[a]), int(rows[b])) for a, b in ((1, 2), (1, 4), (5, 99))]
    found = pj._links(spark.createDataFrame(pairs, "doc_a long, doc_b long, a long, b long"), docs)
    assert python_steps(found._jdf.queryExecution().executedPlan()) == 1
    linked = {(r["a"], r["b"]): (r["linked"], r["joins"]) for r in found.collect()}
    assert linked == {(1, 2): (True, True), (1, 4): (True, True), (5, 99): (False, False)}


def test_steps_hand_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(workers.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: given.append(True)))
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    steps = workers.tidy(lambda batches: (b for b in batches))(iter([batch, batch]))
    assert next(steps) is batch and not given
    assert list(steps) == [batch] and given == [True]
