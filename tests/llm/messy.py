"""A table with every awkward case: NULLs, empty and very long texts, ties, repeats, clashing names."""

from __future__ import annotations

PROSE = "the quick brown fox, as told here, jumps over the lazy dog and runs home again before dark. "
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000)) + "."
ROWS = [
    (1, PROSE * 4, "en"), (1, PROSE * 4, "en"), (2, PROSE * 4, None), (None, PROSE * 4, "en"), (None, None, None),
    (3, None, "en"), (4, "", "en"), (5, " \n\t ", "en"), (6, LONG, "en"), (7, "Ünï ▁ \x1c 　 <|endoftext|> \U0001f600 ÉTÉ", "fr"),
    (8, "one two", "en"), (9, "ONE  two\n", "en"), (10, "x" * 5000, "en"),
]


def messy(spark, rows=ROWS, id_name="doc_id", text_name="text"):
    """The rows, with columns named as operators name theirs."""
    schema = (
        f"{id_name} long, {text_name} string, lang string, score double, kept boolean, n_tokens long, id long, word string, "
        "row long, ids binary, held_out boolean, component_id long, host string, verdict string, html2 string"
    )
    return spark.createDataFrame([(*row, 0.5, None, 1, 2, "w", None, None, None, 3, "h", None, None) for row in rows], schema)


def empty(spark):
    return messy(spark, [])
