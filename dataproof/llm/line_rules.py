"""Quality rules, line first: judge every line, remove those that fail, then judge what is left.

DataFrame functions only: one narrow pass over the texts, no shuffle, nothing gathered. All
measures are taken inside a row, so a hot source or a group of copies is like any other rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataproof.functions.binding import let, rows_of

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: Wording of licences, notices and page furniture.
BOILERPLATE = (
    r"(?i)all rights reserved|licen[sc]ed under|released under the|general public license|creative commons"
    r"|copyright \(c\)|terms of (use|service)|privacy policy|cookie|enable javascript|lorem ipsum"
    r"|subscribe to our|click here|read more|sign up for|share this"
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; every ratio is an integer percentage of the line's words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: Symbols of SYMBOL in a line.
    max_symbol_percent: int = 50
    #: Runs of two or more exclamation or question marks in a line.
    max_shout_percent: int = 25
    #: Words that are nothing but menu separators: ``|``, ``>``, ``»`` or ``·``.
    max_separator_percent: int = 15
    #: Longer lines are not taken as boilerplate, whatever wording they quote.
    max_boilerplate_words: int = 25
    #: A line of so many words has some punctuation.
    unpunctuated_words: int = 20
    #: A document keeps at least this share of the characters in its words.
    min_kept_percent: int = 50


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def failed_line(line: Column, rules: LineRules) -> Column:
    """Whether one line that has a word breaks a rule."""

    def judged(n_words: Column) -> Column:
        def above(pattern: str, percent: int) -> Column:
            return _count(line, pattern) * 100 > n_words * percent

        # Plain searches spare ordinary lines the counting.
        shouts = reduce(or_, [F.contains(line, F.lit(pair)) for pair in ("!!", "!?", "?!", "??")])
        return reduce(or_, [
            line.rlike(SYMBOL) & above(SYMBOL, rules.max_symbol_percent),
            shouts & above(r"[!?]{2,}", rules.max_shout_percent),
            line.rlike(r"[|>»·]") & above(
                r"(?:^|[\x20\x09-\x0D])[|>»·]+(?=$|[\x20\x09-\x0D])", rules.max_separator_percent
            ),
            (n_words <= rules.max_boilerplate_words) & line.rlike(BOILERPLATE),
            (n_words >= rules.unpunctuated_words) & ~line.rlike(r"[.,;:!?]"),
        ])

    blanks = [F.when(line.rlike(edge), 1).otherwise(0) for edge in (r"^[\x20\x09-\x0D]", r"[\x20\x09-\x0D]\z")]
    return let((F.size(F.split(line, SPACE)) - blanks[0] - blanks[1]).cast("long"), judged)


def repeated_words(words: Column) -> Column:
    """How many words lie in a run of three words that the text has at least twice."""

    def twice(ordered: Column, key: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
        last = F.size(ordered) - 1

        def found(run: Column, at: Column) -> Column:
            before = F.when(at > 0, key(ordered[at - 1]) == key(run)).otherwise(False)
            return before | F.when(at < last, key(ordered[at + 1]) == key(run)).otherwise(False)

        return found

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2))))).cast("long")

    def few(runs: Column, repeated: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(runs) - 1), lambda i: F.array_contains(repeated, runs[i]))
        return covered(at)

    def many(runs: Column) -> Column:
        ordered = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda x: covered(F.transform(F.filter(x, twice(x, lambda r: r["h"])), lambda r: r["i"])))

    def counted(runs: Column) -> Column:
        # Sorting bare hashes finds what repeats; only texts with much of it also sort the places.
        repeated = let(F.sort_array(runs), lambda x: F.array_distinct(F.filter(x, twice(x, lambda h: h))))
        return let(repeated, lambda hashes: F.when(F.size(hashes) == 0, F.lit(0).cast("long"))
                   .when(F.size(hashes) <= 16, few(runs, hashes)).otherwise(many(runs)))

    runs = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    )
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(runs, counted))


def measures(text: Column, rules: LineRules = LineRules()) -> Column:
    """All measures of one text, its verdict and what the rules leave of it, as a struct."""

    def verdict(lines: Column, different: Column, words: Column, word_chars: Column, n_symbols: Column) -> Column:
        def judged(repeat: Column, good: Column) -> Column:
            base = (F.size(words) < rules.min_words) | (
                repeat * 100 > F.size(words).cast("long") * rules.max_repeat_percent
            )
            left = F.when(F.size(good) == F.size(lines), word_chars).otherwise(_without(F.array_join(good, ""), SPACE))
            enough = left * 100 >= word_chars * rules.min_kept_percent
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                word_chars.alias("word_chars"),
                n_symbols.alias("n_symbols"),
                (F.size(lines) - F.size(different)).cast("long").alias("n_dup_lines"),
                repeat.alias("n_repeat_words"),
                base.alias("base_failed"),
                (~base & enough).alias("kept"),
                F.size(lines).cast("long").alias("n_lines"),
                F.size(good).cast("long").alias("n_lines_kept"),
                left.alias("kept_chars"),
                F.array_join(good, "\n").alias("cleaned"),
            )

        good = F.filter(different, lambda line: ~failed_line(line, rules))
        return let(repeated_words(words), lambda repeat: let(good, lambda found: judged(repeat, found)))

    def split(whole: Column) -> Column:
        lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        words = F.filter(F.split(whole, SPACE), lambda word: word != "")
        sizes = [words, _without(whole, SPACE), _without(whole, r"[^#*$%&|<>]+")]
        return let(lines, lambda own: _bind([F.array_distinct(own), *sizes], lambda *rest: verdict(own, *rest)))

    return let(F.coalesce(text, F.lit("")), split)


def _bind(values: list[Column], body: Callable[..., Column], bound: tuple[Column, ...] = ()) -> Column:
    """``let`` for several values."""
    if not values:
        return body(*bound)
    return let(values[0], lambda value: _bind(values[1:], body, (*bound, value)))


def line_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()
) -> DataFrame:
    """Measures and verdict of every row: the id and the fields of ``measures``.

    A NULL text counts as empty. Without words everything is 0, the row fails the base rules
    and ``cleaned`` is empty. Ids may be NULL or repeat: each row is judged alone, equal texts alike.
    Of equal lines the first stays. An empty table gives an empty result. Other columns are not
    read, so their names cannot clash.
    """
    found = measures(df[text_col], rules)
    return df.select(df[id_col].alias(id_col), rows_of(found, lambda x: x))


def clean_documents(df: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The kept rows with all their columns, their texts without the removed lines.

    Edge cases are as in ``line_rules``; a column ``n_chars`` follows the new text.
    """
    name = next(x for x in (f"verdict_{i}" for i in range(len(df.columns) + 1)) if x not in df.columns)
    judged = df.select(
        *[df[column] for column in df.columns],
        rows_of(measures(df[text_col], rules), lambda x: F.struct(F.struct(x["kept"], x["cleaned"]).alias(name))),
    ).where(F.col(name)["kept"])
    new = {text_col: F.col(name)["cleaned"]}
    if "n_chars" in df.columns:
        new["n_chars"] = F.length(new[text_col]).cast(df.schema["n_chars"].dataType)
    return judged.select(*[new.get(column, judged[column]).alias(column) for column in df.columns])
