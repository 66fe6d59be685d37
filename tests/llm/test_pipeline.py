"""The pipeline stage by stage, each on what the one before kept."""

from __future__ import annotations

from collections import defaultdict

import public_tokenizers
import pytest
from messy import empty, messy
from test_parity_join import brute
from tokenizers import Tokenizer

import corpus_pipeline


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    """Rows after every stage, each written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], sf_dir).write.parquet(f"{folder}/{number}")
        tables.append(spark.read.parquet(f"{folder}/{number}"))
    return tables


def test_columns(kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding",
    ]
    for table in kept[1:-1]:
        assert table.columns == kept[0].columns
    assert corpus_pipeline.ORACLE_SQL is None


def test_cleaning_follows_labels(spark, sf_dir, kept):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    words = {r["doc_id"]: len(r["text"].split()) for r in kept[0].collect()}
    after = {r["doc_id"] for r in kept[2].collect()}
    for number, quality in labels.items():
        assert (number in after) == (quality == 1 and words[number] >= 50)


def test_one_document_of_each_group_stays(kept):
    groups = brute([(r["doc_id"], r["text"]) for r in kept[2].collect()])
    assert sorted(r["doc_id"] for r in kept[3].collect()) == sorted(n for n, (_, group) in groups.items() if n == group)


def test_passages_of_items_go(spark, sf_dir, kept):
    runs = defaultdict(set)
    for row in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = row["text"].lower().split()
        for i in range(len(words) - 7):
            runs[tuple(words[i:i + 8])].add(row["item_id"])
    clean = []
    for row in kept[3].collect():
        words = row["text"].lower().split()
        if not any(tuple(words[i:i + 8]) in runs for i in range(len(words) - 7)):
            clean.append(row["doc_id"])
    assert sorted(r["doc_id"] for r in kept[4].collect()) == sorted(clean)


def test_ids(kept):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    rows = kept[5].collect()
    assert len(rows) == len(texts) > 0
    for row in rows:
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert list(memoryview(bytes(row["ids"])).cast("I")) == ids and row["n_tokens"] == len(ids)
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_messy_rows(spark, sf_dir):
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        found, none = stage(spark, messy(spark), sf_dir), stage(spark, empty(spark), sf_dir)
        assert none.count() == 0 and found.count() <= messy(spark).count()
        if number < len(corpus_pipeline.STAGES):
            assert found.columns == messy(spark).columns
