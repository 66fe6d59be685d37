"""Spaced seeds against a search of all word runs."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pyarrow as pa
from messy import PROSE, empty, messy

from dataproof.llm.decontamination import OverlapRule, SeedIndex, contaminated, drop_contaminated, longest_run, overlaps
from dataproof.llm.queries import QUERIES


def test_whole_items(spark, sf_dir):
    def words(text):
        return text.lower().split()

    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    expected = set()
    for doc, own in docs.items():
        runs = {tuple(own[i:i + 8]) for i in range(len(own) - 7)}
        expected |= {(doc, item) for item, test in items.items() if any(tuple(test[i:i + 8]) in runs for i in range(len(test) - 7))}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontamination"](spark, sf_dir).collect()}
    assert got == expected and expected


def test_replaced_words(spark):
    draw = random.Random(3)
    item = [f"term{i}" for i in range(40)]
    filler = [f"other{i}" for i in range(500)]
    docs = []
    for number in range(20):
        copy = [f"new{number}" if i % 7 == number % 7 else word for i, word in enumerate(item)]
        at = draw.randrange(400)
        docs.append((number, " ".join(filler[:at] + copy + filler[at:]), "en"))
    docs.append((99, " ".join(filler + item[:6] + filler), "en"))
    benchmark = spark.createDataFrame([(5, " ".join(item)), (6, None), (7, "too short")], "item_id long, text string")
    rows = contaminated(messy(spark, docs), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(number, 5) for number in range(20)}
    assert all(r["n_matched"] >= 30 and 30 <= r["n_words"] <= 40 for r in rows)
    assert [r["doc_id"] for r in drop_contaminated(messy(spark, docs), benchmark).collect()] == [99]


def test_longest_run():
    """An overlap is found if and only if some run passes the rule, and none that passes has more equal words."""
    draw = np.random.default_rng(5)
    for _ in range(400):
        equal = draw.random(draw.integers(1, 60)) < draw.choice([0.5, 0.7, 0.8])
        for percent in (60, 75, 100):
            most = max((
                int(equal[a:b].sum()) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1)
                if equal[a:b].sum() * 100 >= percent * (b - a)
            ), default=0)
            a, b = longest_run(equal, percent)
            assert equal[a:b].sum() == most and equal[a:b].sum() * 100 >= percent * (b - a)


def test_shorter_run_inside(spark):
    """The whole copy is under the share, a part of it is not."""
    item = [f"term{i}" for i in range(61)]
    copy = [word if i % 13 < 9 else f"new{i}" for i, word in enumerate(item)]
    docs = [(1, " ".join(["start", *copy, "end"]), "en"), (2, " ".join(copy[:9]), "en")]
    benchmark = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    rows = {r["doc_id"]: r for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string, lang string"), benchmark).collect()}
    assert {doc: (r["first_word"], r["n_words"], r["n_matched"]) for doc, r in rows.items()} == {1: (1, 48, 36), 2: (0, 9, 9)}


def test_every_short_overlap_has_a_hit():
    """All runs of 8 to 19 words that pass the rule; of a longer one, one half passes too."""
    items, texts = [], []
    for length in range(8, 20):
        for count in range(length - max(8, -(-75 * length // 100)) + 1):
            for replaced in itertools.combinations(range(1, length - 1), count):
                number = len(items)
                items.append((number, " ".join(f"w{number}x{k}" for k in range(length))))
                texts.append(" ".join(f"new{k}" if k in replaced else f"w{number}x{k}" for k in range(length)))
    found = {(text, item) for text, item, *_ in overlaps(pa.array(texts), SeedIndex(items), OverlapRule())}
    assert found == {(number, number) for number in range(len(items))}


def test_messy_rows(spark):
    benchmark = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, PROSE), (2, ""), (3, None)], "item_id long, text string")
    rows = contaminated(messy(spark), benchmark).collect()
    # Four rows have the passage, each with three items of the same text.
    assert len(rows) == 12 and {r["doc_id"] for r in rows} == {1, 2, None}
    assert contaminated(empty(spark), benchmark).count() == 0
    assert contaminated(messy(spark), benchmark.limit(0)).count() == 0
    kept = drop_contaminated(messy(spark), benchmark)
    assert kept.columns == messy(spark).columns and kept.count() == messy(spark).count() - 4
    assert drop_contaminated(messy(spark), benchmark.limit(0)).count() == messy(spark).count()


def brute_overlaps(text, item, rule=OverlapRule()):
    """(first word, words, equal words) over all diagonals and runs."""
    best = None
    for shift in range(-len(item) + 1, len(text)):
        begin, stop = max(0, -shift), min(len(item), len(text) - shift)
        equal = np.array([text[k + shift] == item[k] for k in range(begin, stop)], dtype=bool)
        a, b = longest_run(equal, rule.min_percent)
        found = (int(equal[a:b].sum()), -(begin + shift + a), b - a)
        if found[0] >= rule.min_matched and (best is None or found > best):
            best = found
    return best and (-best[1], best[2], best[0])


def test_repeated_words_against_all_diagonals(monkeypatch):
    """Texts and items of few words, repeated in periods; with every run taken as crowded and with none."""
    draw = random.Random(8)

    def lines(n):
        found = []
        for _ in range(n):
            phrase = [draw.choice("ab") for _ in range(draw.randrange(1, 4))]
            body = (phrase * 60)[:draw.randrange(4, 60)]
            for _ in range(draw.randrange(3)):
                body[draw.randrange(len(body))] = draw.choice("abc")
            found.append([f"x{k}" for k in range(draw.randrange(4))] + body + [f"y{draw.randrange(5)}"] + phrase * draw.randrange(5))
        return found

    items, texts = lines(12), lines(25)
    expected = {(t, i): found for t, text in enumerate(texts) for i, item in enumerate(items) if (found := brute_overlaps(text, item))}
    for crowded in (0, 40, 1 << 40):
        monkeypatch.setattr("dataproof.llm.decontamination.CROWDED", crowded)
        index = SeedIndex([(k, " ".join(item)) for k, item in enumerate(items)])
        got = {(t, i): (a, n, m) for t, i, a, n, m in overlaps(pa.array([" ".join(text) for text in texts]), index, OverlapRule())}
        assert got == expected
    assert len(expected) > 50


def test_many_repeated_words_are_cheap():
    """20,000 equal words against 100 items of 40 to 1,000 equal words."""
    index = SeedIndex([(k, "ha " * (40 + k * 960 // 99)) for k in range(100)])
    started = time.process_time()
    found = list(overlaps(pa.array(["ha " * 20_000, "la di " * 10_000]), index, OverlapRule()))
    assert time.process_time() - started < 20
    assert sorted(found) == [(0, k, 0, 40 + k * 960 // 99, 40 + k * 960 // 99) for k in range(100)]


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("d", PROSE)], "doc_id string, text string")
    for kind in ("smallint", "decimal(9,2)", "date", "boolean"):
        benchmark = spark.sql(f"select cast(null as {kind}) as item_id, '{PROSE}' as text")
        row = contaminated(docs, benchmark).first()
        assert row["doc_id"] == "d" and row["item_id"] is None
