"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors of its hashed words, word pairs and character n-grams; a
softmax over two classes reads it. Vectors and output weights are learned together by stochastic
gradient descent in numpy, on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataproof.llm.words import hash_spans, mix, text_chunks, word_spans
from dataproof.llm.workers import tidy

#: Vectors that n-grams are hashed to, and their length.
BUCKETS = 1 << 16
DIMENSIONS = 16
CHARACTER_RUNS = (3, 4)
#: Labelled documents of each class that the model is fitted on, at most. A bound of the fit alone.
SAMPLE_EACH = 800
#: Steps of gradient descent, one document each.
STEPS = 8000
RATE = 4.0


@dataclass(frozen=True)
class Model:
    """Vectors of all buckets, weights of the two classes, and their biases."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def pull(self) -> np.ndarray:
        """What one n-gram of each bucket adds to the log odds of class 1, before averaging."""
        return self.vectors @ (self.weights[1] - self.weights[0])

    def score(self, mean: np.ndarray) -> np.ndarray:
        odds = np.clip(mean + (self.bias[1] - self.bias[0]), -500, 500)
        return 1 / (1 + np.exp(-odds))


def ngram_buckets(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: buckets in text order, and where each text's n-grams start and end."""
    begin, end, words = word_spans(data, at)
    hashes = hash_spans(data, begin, end)
    bounds = np.stack([words[:-1], words[1:]])
    yield (hashes % np.uint64(BUCKETS)).astype(np.int64), bounds
    if len(hashes) > 1:
        pairs = mix(hashes[:-1] ^ (hashes[1:] << np.uint64(1)), 41)
        # A word said twice in a row is one n-gram, whatever the word.
        pairs[hashes[:-1] == hashes[1:]] = 0
        yield (pairs % np.uint64(BUCKETS)).astype(np.int64), _shortened(bounds, 1)
    codes = data.astype(np.uint32)
    for length in CHARACTER_RUNS:
        count = len(data) - length + 1
        if count <= 0:
            continue
        runs = np.full(count, length, dtype=np.uint32)
        for k in range(length):
            runs = runs * np.uint32(0x01000193) ^ codes[k:k + count] * np.uint32(0x9E3779B1)
        runs ^= runs >> np.uint32(15)
        yield (runs % np.uint32(BUCKETS)).astype(np.int64), _shortened(np.stack([at[:-1], at[1:]]), length - 1)


def _shortened(bounds: np.ndarray, by: int) -> np.ndarray:
    """Bounds of runs that must end inside the text."""
    return np.stack([bounds[0], np.maximum(bounds[0], bounds[1] - by)])


def mean_pull(texts: pa.Array, pull: np.ndarray) -> np.ndarray:
    """For each text, the mean over all its n-grams of what their buckets add; 0 without n-grams."""
    means = np.zeros(len(texts))
    for first, end, data, at in text_chunks(texts):
        total, count = np.zeros(end - first), np.zeros(end - first)
        for buckets, (start, stop) in ngram_buckets(data, at):
            sums = np.concatenate(([0.0], np.cumsum(pull[buckets])))
            last = len(buckets)
            total += sums[np.minimum(stop, last)] - sums[np.minimum(start, last)]
            count += np.minimum(stop, last) - np.minimum(start, last)
        means[first:end] = total / np.maximum(count, 1)
    return means


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their shares of its n-grams."""
    found = [np.zeros(0, dtype=np.int64)]
    for _, _, data, at in text_chunks(pa.array([text], pa.string())):
        found += [buckets[start[0]:stop[0]] for buckets, (start, stop) in ngram_buckets(data, at)]
    buckets, counts = np.unique(np.concatenate(found), return_counts=True)
    return buckets, counts / max(1, counts.sum())


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS, rate: float = RATE, seed: int = 7) -> Model:
    """Stochastic gradient descent over (buckets, shares, class); the rate falls to 0 in a line.

    Every vector of a document moves by the gradient of the average, so that rare n-grams learn as
    fast as frequent ones. Without examples all scores are one half.
    """
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    weights, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    done = 0
    while done < steps and examples:
        for number in draw.permutation(len(examples))[:steps - done]:
            buckets, shares, label = examples[number]
            step = rate * (1 - done / steps)
            done += 1
            hidden = shares @ vectors[buckets] if len(buckets) else np.zeros(DIMENSIONS)
            logits = weights @ hidden + bias
            chance = np.exp(logits - logits.max())
            error = chance / chance.sum()
            error[label] -= 1
            back = error @ weights
            weights -= 0.1 * step * np.outer(error, hidden)
            bias -= 0.01 * step * error
            if len(buckets):
                vectors[buckets] -= step * np.minimum(1.0, 50 * shares)[:, None] * back * 0.1
    return Model(vectors, weights, bias)


def held_out(id_col: str, folds: int = 5):
    """Rows that are never learned from: crc32 of the id as text divides by ``folds``, or the id is NULL."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_each: int = SAMPLE_EACH,
) -> Model:
    """Fit on at most ``sample_each`` labelled documents of each class that are not held out.

    The sample is drawn by a hash of the id from all labels, so it does not depend on order or
    layout. Labels other than 0 and 1, NULL labels and NULL ids are not used. What reaches the driver are
    the n-gram shares of the sample, bounded by its size and the number of buckets.
    """
    usable = labels.select(F.col(id_col).alias("labelled"), F.col(label_col).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & ~held_out("labelled")
    )
    order = [F.xxhash64("labelled"), F.col("labelled")]
    chosen = usable.where("label = 0").orderBy(*order).limit(sample_each).union(
        usable.where("label = 1").orderBy(*order).limit(sample_each)
    )
    # The sample's size bounds what is broadcast.
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text")).join(
        F.broadcast(chosen), F.col("id") == F.col("labelled")
    )

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                buckets, share = features(batch.column(1)[at].as_py())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, 1), batch.column(2).slice(at, 1),
                        pa.array([buckets.astype("<u2").tobytes()], pa.binary()),
                        pa.array([share.astype("<f4").tobytes()], pa.binary()),
                    ],
                    names=["id", "label", "buckets", "shares"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    rows = texts.select("id", "text", "label").mapInArrow(tidy(shares), f"id {kind}, label int, buckets binary, shares binary")
    found = rows.limit(2 * sample_each).collect()
    found.sort(key=lambda row: (row["id"], row["label"], row["buckets"]))
    return train([
        (np.frombuffer(row["buckets"], "<u2").astype(np.int64), np.frombuffer(row["shares"], "<f4").astype(float), row["label"])
        for row in found
    ])


def scored(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The rows, with the columns ``keep`` (all by default), and the score of class 1 of every whole text.

    NULL and empty texts get the score of the bias alone. Rows are scored one by one, so NULLs elsewhere,
    ties and repeated rows change nothing; an empty table gives an empty result.
    """
    columns = df.columns if keep is None else keep
    pull, bias = df.sparkSession.sparkContext.broadcast(model.pull()), (model.bias[1] - model.bias[0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.clip(mean_pull(batch.column(batch.num_columns - 1), pull.value) + bias, -500, 500)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(1 / (1 + np.exp(-odds)))], names=[*columns, score_col]
            )

    given = df.select(*columns, df[text_col].alias(f"{text_col}_scored"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(tidy(score), f"{fields}, `{score_col}` double")
