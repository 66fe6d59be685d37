"""From raw documents to token ids: stages that each judge all that the one before kept.

Every stage reads a table with the columns of ``documents`` and returns such a table; the last returns ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataproof.llm.bpe import bpe_round_trip
from dataproof.llm.decontamination import drop_contaminated
from dataproof.llm.line_rules import clean_documents
from dataproof.llm.parity_join import one_of_each
from dataproof.llm.subword_classifier import fit, scored
from dataproof.sources.shared import drop_folder, keep_table

#: From this score on a document counts as good.
GOOD = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that break a rule are removed from the texts; documents that lose too much go."""
    return clean_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for bad go.

    It is fitted on labelled documents as they came, since those that the rules reject are what a bad
    document is learned from; held-out labels are never used.
    """
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = next(x for x in (f"score_{i}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    return scored(docs, model, score_col=name).where(F.col(name) >= GOOD).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets, the one with the smallest id stays."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a test item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and what they decode to."""
    return bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: The classifier and the encoder have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again for the next."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs, path = keep_table(docs, "stage")
            if done:
                drop_folder(spark, done)
            done = path
    return docs
