"""Quality rules against SQL and against cases written out."""

from __future__ import annotations

import pytest
from messy import LONG, PROSE, ROWS, empty, messy
from oracle import both
from pyspark.sql import functions as F

from dataproof.llm.line_rules import clean_documents, failed_line, line_rules, LineRules


def test_sql_agrees(spark, sf_dir):
    got, expected = both(spark, "op8_quality_rules", sf_dir)
    assert got == expected


@pytest.mark.parametrize(("line", "fails"), [
    ("Home | News | About | Contact", True),
    ("All rights reserved.", True),
    ("WIN!! NOW!! OR!! NEVER!!", True),
    ("a### b$$$ c%%% d&&&", True),
    ("word " * 25, True),
    ("This is an ordinary sentence, with some punctuation.", False),
    ("A title without any", False),
    ("Profit rose 5% to $3 and A&B paid, as the long report on the second page says in the end.", False),
])
def test_lines(spark, line, fails):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(failed_line(F.col("line"), LineRules())).first()[0] is fails


def test_messy_rows(spark):
    found = line_rules(messy(spark)).collect()
    assert len(found) == len(ROWS)
    by_id = {row["doc_id"]: row for row in found}
    for number in (3, 4, 5):
        assert by_id[number]["n_words"] == 0 and by_id[number]["base_failed"] and not by_id[number]["kept"]
    assert by_id[6]["n_words"] == len(LONG.split()) and by_id[6]["kept"]
    assert by_id[1]["n_repeat_words"] == by_id[1]["n_words"] == 4 * len(PROSE.split())
    assert line_rules(empty(spark)).count() == 0


def test_repeated_words(spark):
    texts = ["a b c x a b c", "a a a a", "a b", "", "a b c d e f a b", "p q r p q r p q r"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {row["doc_id"]: row["n_repeat_words"] for row in line_rules(df).collect()}
    for number, text in enumerate(texts):
        words, covered = text.split(), set()
        runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        for i, run in enumerate(runs):
            if runs.count(run) > 1:
                covered |= {i, i + 1, i + 2}
        assert got[number] == len(covered)


def test_cleaned_texts(spark):
    lines = [" ".join(f"word{n}x{i}" for i in range(12)) + "." for n in range(8)]
    body = "\n".join(lines)
    text = f"Home | News | About\n{body}\nAll rights reserved.\n{lines[3]}"
    df = messy(spark, [(1, text, "en"), (2, "Home | News\n" * 40, "en")])
    rows = clean_documents(df).collect()
    assert [(row["doc_id"], row["text"]) for row in rows] == [(1, body)]
    assert clean_documents(df).columns == df.columns
    assert clean_documents(empty(spark)).count() == 0
