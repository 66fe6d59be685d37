"""Language-model scores: the probability of a text over all its segmentations into vocabulary pieces.

The pieces are those of an existing vocabulary file, their probabilities come from training documents. A
text is its words, each behind a word mark, and an end; its probability is the sum over all ways to cut
it into pieces, by a forward recursion in log space. No piece crosses a word mark, so a text's
sum is the product of its words' sums and each distinct word is worked out once in the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataproof.llm.words import text_words
from dataproof.sources.shared import drop_folder, keep_table

#: Distinct words counted in a task before the counts are handed on.
WORDS_AT_ONCE = 400_000
#: The most frequent words are looked up where the texts lie; the bound of what is broadcast.
FREQUENT = 1 << 16
LONGEST_FREQUENT = 64
#: Scored documents, and rare words of them, handed on at a time.
ROWS_AT_ONCE = 50_000

MARK = "▁"


class Vocabulary:
    """Pieces of a vocabulary file and how it cuts words; bytes stand in for what no piece has."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.processor.get_piece_size()
        ids = range(self.size)
        self.bytes = [self.processor.piece_to_id(f"<0x{byte:02X}>") for byte in range(256)]
        self.end = self.processor.eos_id()
        plain = (i for i in ids if not (self.processor.is_control(i) or self.processor.is_unknown(i)
                                        or self.processor.is_byte(i) or self.processor.is_unused(i)))
        # A mark only begins a piece: words are cut before it.
        self.pieces = {
            piece: i for i, piece in ((i, self.processor.id_to_piece(i)) for i in plain) if piece and MARK not in piece[1:]
        }
        self.longest = max(map(len, self.pieces))

    def cut(self, words: list[str]) -> list[list[int]]:
        """The file's own segmentation of each word, of which pieces are first counted."""
        return self.processor.encode(words, num_threads=1)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


class Lattice:
    """Natural logarithms of the probabilities of pieces, and sums over segmentations."""

    def __init__(self, known: Vocabulary, counts: dict[int, int]):
        # One is added to every piece, so that none is impossible.
        all_ids = {*known.pieces.values(), *known.bytes, known.end}
        total = sum(counts.get(i, 0) for i in all_ids) + len(all_ids)
        self.log = {i: math.log((counts.get(i, 0) + 1) / total) for i in all_ids}
        self.pieces = {piece: self.log[i] for piece, i in known.pieces.items()}
        self.bytes = [self.log[i] for i in known.bytes]
        self.end = self.log[known.end]
        self.longest = known.longest

    def word(self, word: str) -> float:
        """The logarithm of the probability of a word behind its mark, over all segmentations.

        Position by position, the sum of what reaches it: log-sum-exp over the pieces, or the bytes of
        one character, that end there.
        """
        return self._forward(MARK + word, MARK if MARK in word else None)

    def _forward(self, letters: str, inner: str | None) -> float:
        """``inner``: a letter that no piece may have after the first place, as it is not a word's mark there."""
        pieces, longest = self.pieces, self.longest
        reached = [0.0]
        for end in range(1, len(letters) + 1):
            last = letters[end - 1]
            arcs = [reached[end - 1] + sum(self.bytes[byte] for byte in last.encode("utf-8", "surrogatepass"))]
            for start in range(max(0, end - longest), end):
                part = letters[start:end]
                if inner is not None and inner in letters[max(1, start):end]:
                    continue
                score = pieces.get(part)
                if score is not None:
                    arcs.append(reached[start] + score)
            most = max(arcs)
            reached.append(most if len(arcs) == 1 else most + math.log(sum([math.exp(arc - most) for arc in arcs])))
        return reached[-1]


def held_out(id_col: str, folds: int = 7, remainder: int = 2) -> Column:
    """Rows that are not learned from: crc32 of the id as text leaves ``remainder``, or the id is NULL."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == remainder, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """Every distinct word of (text, held_out): ``n_train`` and ``n_all``. Counts are combined in the tasks."""

    def told(train: Counter, every: Counter) -> pa.RecordBatch:
        words = list(every)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64()),
                pa.array([every[w] for w in words], pa.int64()),
            ],
            names=["word", "n_train", "n_all"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, every = Counter(), Counter()
        for batch in batches:
            for text, held in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = text_words(text.as_py())
                every.update(words)
                if not held:
                    train.update(words)
                if len(every) > WORDS_AT_ONCE:
                    yield told(train, every)
                    train, every = Counter(), Counter()
        yield told(train, every)

    return (
        docs.select("text", "held_out").mapInArrow(count, "word binary, n_train long, n_all long")
        .groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))
    )


def piece_counts(words: DataFrame, path: str) -> dict[int, int]:
    """How often each piece is used in all training words; bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        totals = np.zeros(known.size, dtype=np.int64)
        for batch in batches:
            texts = [word.decode("utf-8", "replace") for word in batch.column(0).to_pylist()]
            for ids, weight in zip(known.cut(texts), batch.column(1).to_pylist(), strict=True):
                for i in ids:
                    totals[i] += weight
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used])], names=["piece", "n"])

    rows = (
        words.where("n_train > 0").select("word", "n_train").mapInArrow(count, "piece long, n long")
        .groupBy("piece").agg(F.sum("n").alias("n")).collect()
    )
    return {row["piece"]: row["n"] for row in rows}


def scored_words(words: DataFrame, lattice: Lattice, tokens: int, types: int) -> DataFrame:
    """The words with ``known``, ``base`` (log10 of the smoothed share) and ``score`` (log10 over segmentations)."""
    shared = words.sparkSession.sparkContext.broadcast(lattice)
    scale = tokens + types + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            counts = batch.column(1).to_numpy(zero_copy_only=False)
            marginal = [model.word(word.decode("utf-8", "surrogatepass")) for word in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array((counts > 0).astype(np.int64)),
                    pa.array(np.log10((counts + 1) / scale)), pa.array(np.array(marginal, dtype=float) / math.log(10)),
                ],
                names=["word", "n_all", "known", "base", "score"],
            )

    return words.select("word", "n_train", "n_all").mapInArrow(
        score, "word binary, n_all long, known long, base double, score double"
    )


def lattice_scores(
    df: DataFrame, vocabulary_path: str, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row: the id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows that ``held`` does not mark. Words are lower-cased in A-Z; the end of
    a text is a token. ``base_score`` sums log10((c + 1) / (N + V + 1)) over the tokens, ``score`` is log10 of
    the probability over all segmentations. Without training documents N and V are 0.

    NULL and empty texts consist of the end. Rows are told apart by a number given to them, so NULL and
    repeated ids and repeated rows are scored one by one, equal texts alike. An empty table gives an empty
    result. Other columns are not read, so their names cannot clash.

    Distinct words are counted in the tasks, then summed. A bounded table of the most frequent words
    goes to the tasks; only other words, at most one row per text and word, are joined in a shuffle.
    """
    spark = df.sparkSession
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text")).withColumn(
        "held_out", held_out("id") if held is None else held
    )
    words, words_path = keep_table(word_counts(docs), "words")
    ends = docs.where(~F.col("held_out")).count()
    totals = words.agg(F.sum("n_train").alias("tokens"), F.count(F.when(F.col("n_train") > 0, 1)).alias("types")).first()
    tokens, types = (totals["tokens"] or 0) + ends, totals["types"] + (ends > 0)

    known = vocabulary(vocabulary_path)
    lattice = Lattice(known, piece_counts(words, vocabulary_path) | {known.end: ends})
    table, table_path = keep_table(scored_words(words, lattice, tokens, types), "scored-words")
    drop_folder(spark, words_path)

    frequent = (
        table.where(F.length("word") <= LONGEST_FREQUENT).orderBy(F.desc("n_all"), "word").limit(FREQUENT)
        .select("word", "known", "base", "score").collect()
    )
    end = (int(ends > 0), math.log10((ends + 1) / (tokens + types + 1)), lattice.end / math.log(10))
    shared = spark.sparkContext.broadcast({bytes(row["word"]): (row["known"], row["base"], row["score"]) for row in frequent})
    kind = df.schema[id_col].dataType.simpleString()
    fields = ["row", "id", "held_out", "n_tokens", "word", "n", "known", "base", "score"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with the sums of its frequent words, and one for each other word in it."""
        table = shared.value

        def told(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), id_type, pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=fields)

        rows: list[tuple] = []
        for batch in batches:
            id_type = batch.column(1).type
            given = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for row, own, held_row, text in zip(*given, batch.column(2), strict=True):
                words = text_words(text.as_py())
                n_known, base, score = end
                for word, n in Counter(words).items():
                    found = table.get(word)
                    if found is None:
                        rows.append((row, None, None, None, word, n, None, None, None))
                    else:
                        n_known += n * found[0]
                        base += n * found[1]
                        score += n * found[2]
                rows.append((row, own, held_row, len(words) + 1, None, None, n_known, base, score))
                if len(rows) >= ROWS_AT_ONCE:
                    yield told(rows, id_type)
                    rows = []
        if rows:
            yield told(rows, id_type)

    parts, _ = keep_table(
        docs.select(F.monotonically_increasing_id().alias("row"), "id", "text", "held_out").mapInArrow(
            split,
            f"row long, id {kind}, held_out boolean, n_tokens long, word binary, n long, known long, base double, score double",
        ),
        "parts",
    )
    rare = (
        parts.where("word is not null").select("row", "word", "n")
        .join(table.select("word", F.col("known").alias("k"), F.col("base").alias("b"), F.col("score").alias("s")), "word")
        .select("row", *[(F.col("n") * F.col(c)).alias(name) for c, name in (("k", "known"), ("b", "base"), ("s", "score"))])
        .groupBy("row").agg(*[F.sum(c).alias(f"rare_{c}") for c in ("known", "base", "score")])
    )
    whole = parts.where("word is null").join(rare, "row", "left")
    added = {c: F.col(c) + F.coalesce(F.col(f"rare_{c}"), F.lit(0)) for c in ("known", "base", "score")}
    return whole.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", added["known"].alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), added["base"].alias("base_score"), added["score"].alias("score"),
    )
