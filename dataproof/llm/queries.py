"""Registered queries of the corpus operators: each runs one over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataproof.llm.bpe import bpe_round_trip
from dataproof.llm.decontamination import contaminated
from dataproof.llm.hard_negatives import hard_negatives
from dataproof.llm.html_extraction import extract_text
from dataproof.llm.lattice_lm import lattice_scores
from dataproof.llm.length_histogram import encoded_lengths, length_histogram
from dataproof.llm.line_rules import line_rules
from dataproof.llm.oracles import ORACLES
from dataproof.llm.parity_join import parity_join
from dataproof.llm.repeated_passages import drop_repeated_passages
from dataproof.llm.source_divergence import source_divergence
from dataproof.llm.subword_classifier import fit, held_out, scored
from dataproof.llm.token_files import read_token_files, write_token_files
from dataproof.llm.url_templates import Rule, judge_urls
from dataproof.sources.shared import new_folder

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_quality_rules(spark, sf_dir):
    """Measures of every document and the verdict of the line rules."""
    return line_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_lines_kept", "kept_chars",
    )


@query
def op2_token_files(spark, sf_dir):
    """Where every document lies in the token files, and a checksum of its ids as read back."""
    folder = new_folder(spark, "token-files")
    write_token_files(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2
    )
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_bpe(spark, sf_dir):
    """Digests of every document's ids and of what they decode to."""
    found = bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_token_counts(spark, sf_dir):
    """The histogram of encoded lengths with its suffix sums, over all documents."""
    lengths = encoded_lengths(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return length_histogram(lengths)


@query
def op1_decontamination(spark, sf_dir):
    """Every document and benchmark item that overlap, with where and how much."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_ngram_jaccard(spark, sf_dir):
    """The component of every document under links of similar shingle sets."""
    return parity_join(table(spark, sf_dir, "documents"))


#: From this score on a document counts as good.
GOOD = 0.3


@query
def op5_quality_classifier(spark, sf_dir):
    """The quality score of every document, from a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


@query
def op7_lattice_lm(spark, sf_dir):
    """The log probability of every document over all segmentations, and its smoothed word score."""
    return lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


URL_RULES = [
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
]


@query
def op10_url_filters(spark, sf_dir):
    """The verdict on every page's url, by rule or else by its template."""
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op3_html_text(spark, sf_dir):
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of every fiftieth vector; the label of every seventh is taken for another one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


@query
def op12_source_divergence(spark, sf_dir):
    """How far all sources of a language lie apart, and the terms that set each one off."""
    return source_divergence(table(spark, sf_dir, "documents"))


@query
def op13_repeated_passages(spark, sf_dir):
    """What is left of every document without the passages that a document with a smaller id has."""
    found = drop_repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
