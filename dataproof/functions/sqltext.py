"""Triage of SQL texts as column expressions.

Comments and literals are found by one alternation, so neither is searched inside the other. Quantifiers are
possessive, so texts of any length match without recursion. What decides about a statement is its word line: its words,
numbers and marks in upper case, one blank between them, each literal shrunk to a mark that tells how it begins.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from dataproof.functions.binding import let

# Functions that reach outside the database.
EXTERNAL_FUNCTIONS = [
    "azureBlobStorage", "azureBlobStorageCluster", "cluster", "clusterAllReplicas",
    "deltaLake", "executable", "executablePool", "file", "filesystem", "gcs", "hdfs",
    "hdfsCluster", "hudi", "iceberg", "jdbc", "mongodb", "mysql", "odbc", "postgresql",
    "redis", "remote", "remoteSecure", "s3", "s3Cluster", "sqlite", "url", "urlCluster",
]
# Spark functions that run arbitrary JVM code.
JVM_FUNCTIONS = ["java_method", "reflect", "try_reflect"]
# Functions that hide a column from range pruning when wrapped around it.
WRAPPING_FUNCTIONS = [
    "lower", "upper", "toString", "toDate", "toDateTime", "formatDateTime", "substring", "cast",
]
# Names (or patterns) of functions that answer differently each time.
UNSTABLE_FUNCTIONS = [
    "rand[A-Za-z0-9]*", "now64", "now", "today", "yesterday", "generateUUID[A-Za-z0-9]*",
    "uuid", "current_timestamp", "current_date", "localtimestamp",
]

_BLANKS = " \t\r\n\f\x0b\u00a0\ufeff"


def _literal(quote: str, backslash: bool, begin: str = "") -> str:
    """A quoted text up to its closing quote or the end; doubling escapes a quote."""
    plain = rf"[^{quote}\\]*+" if backslash else rf"[^{quote}]*+"
    escape = rf"(?:\\(?:.|\z)|{quote}{quote})" if backslash else rf"(?:{quote}{quote})"
    return rf"{quote}{begin}{plain}(?:{escape}{plain})*+(?:{quote}|\z)"


_STRINGS = f"{_literal(chr(39), True)}|{_literal(chr(34), True)}"
_QUOTED = f"(?s){_STRINGS}|{_literal('`', True)}"
_BEGINNINGS = f"(?s){_literal(chr(39), True, '(%?)')}|{_literal(chr(34), True, '(%?)')}|{_literal('`', True)}"
_KEPT = f"{_STRINGS}|{_literal('`', False)}"
_BLOCK = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z)"
_MASK_TOKENS = rf"{_QUOTED}|[^'\"`]++|."
_PAREN_TOKENS = r"[()]|[^()]++"
_CLOSED_STRING = rf"(?s)'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'"
_LINE_TOKENS = r"[A-Z_][A-Z0-9_]*+|[0-9][A-Z0-9_.]*+|'%?'|\S"
#: Stands for a comment until literals are told from it.
_HOLE = "\ue000"


def _tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _filled(token: Column) -> Column:
    return F.repeat(F.lit(" "), F.length(token))


def _without_comments(sql: Column) -> Column:
    """Line comments go; block comments become a blank. Every match leaves what it keeps and, at a block, a hole."""
    lines = F.regexp_replace(sql, rf"(?s)({_KEPT}|{_BLOCK})|--[^\n]*+", "$1")
    holes = F.regexp_replace(lines, rf"(?s)({_KEPT})|{_BLOCK}", "$1" + _HOLE)
    # The hole right behind a closing quote is the literal's own.
    return F.translate(F.regexp_replace(holes, rf"(?<=['\"`]){_HOLE}", ""), _HOLE, " ")


def clean_sql(sql: Column) -> Column:
    """The statement without comments, outer blanks and a closing semicolon.

    Comment marks inside quoted text stay. A block comment leaves one blank, so the
    words around it do not merge.
    """
    commented = sql.contains("--") | sql.contains("/*")
    kept = F.when(commented, _without_comments(sql)).otherwise(sql)
    trimmed = F.btrim(kept, F.lit(_BLANKS))
    return F.btrim(F.regexp_replace(trimmed, r";\z", ""), F.lit(_BLANKS))


def mask_literals(sql: Column) -> Column:
    """Quoted text blanked out, length kept, so words in it never match."""
    masked = F.transform(
        _tokens(sql, _MASK_TOKENS),
        lambda token: F.when(F.instr(F.lit("'\"`"), F.substring(token, 1, 1)) > 0, _filled(token)).otherwise(token),
    )
    return F.array_join(masked, "")


def drop_literals(sql: Column, mark: str = " ") -> Column:
    """Quoted text replaced by one character.

    What is left is as short as the statement proper, which keeps all further
    matching cheap where literals are long.
    """
    return F.regexp_replace(sql, _QUOTED, mark)


def skeleton(sql: Column) -> Column:
    """The statement with each literal shrunk to its quotes, and the ``%`` if it begins with one."""
    return F.regexp_replace(sql, _BEGINNINGS, "'$1$2'")


def word_line(text: Column) -> Column:
    """The words, numbers and marks of a skeleton in upper case, with one blank before, between and behind them."""
    return F.concat(F.lit(" "), F.array_join(_tokens(F.upper(text), _LINE_TOKENS), " "), F.lit(" "))


def top_level(masked: Column) -> Column:
    """Text inside parentheses blanked out at any depth, length kept."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))

    def step(state: Column, token: Column) -> Column:
        depth = (
            F.when(token == "(", state["depth"] + 1)
            .when(token == ")", F.greatest(state["depth"] - 1, F.lit(0)))
            .otherwise(state["depth"])
        )
        shown = F.when((state["depth"] == 0) | token.isin("(", ")"), token).otherwise(_filled(token))
        return F.struct(depth.alias("depth"), F.concat(state["text"], shown).alias("text"))

    return F.aggregate(_tokens(masked, _PAREN_TOKENS), start, step, lambda state: state["text"])


def statement_kind(sql: Column) -> Column:
    """``query``, ``migration`` or ``unknown``, by the leading keyword of clean text."""
    return (
        F.when(sql.rlike(r"(?i)^(?:SELECT|WITH)\b"), "query")
        .when(sql.rlike(r"(?i)^ALTER\b"), "migration")
        .otherwise("unknown")
    )


def artifact_kind(sql: Column, previous: Column) -> Column:
    """As ``statement_kind``; a query that replaces a query is a ``query_pair``."""
    kind = statement_kind(sql)
    paired = previous.isNotNull() & (kind == "query") & (statement_kind(previous) == "query")
    return F.when(paired, "query_pair").otherwise(kind)


def _any_call(names: list[str]) -> str:
    return rf"(?i)\b({'|'.join(names)})\s*\("


def _says(line: Column, *phrases: str) -> Column:
    """Does a word line hold one of the phrases?"""
    return reduce(or_, [F.contains(line, F.lit(f" {phrase} ")) for phrase in phrases])


def _calls(line: Column, names: list[str]) -> Column:
    return _says(line, *[f"{name.upper()} (" for name in names])


#: Flags of a query that one of some phrases in its word line sets.
PHRASES = {
    "has_cross_join": ["CROSS JOIN"],
    "has_final": ["FINAL"],
    "has_leading_wildcard": ["LIKE '%'"],
    "selects_all_columns": ["SELECT *", "SELECT DISTINCT *"],
}


def query_shape(line: Column) -> Column:
    """Flags of a query, from its word line, as one struct."""
    flags = {name: _says(line, *phrases) for name, phrases in PHRASES.items()}
    joins = F.regexp_count(line, F.lit(" JOIN(?= )"))
    # What follows the first condition; nothing if there is none.
    conditions = F.concat(F.lit(" "), F.get(F.split(line, r" (?:PRE)?WHERE(?= )", 2), F.lit(1)))
    wrapped = F.coalesce(_calls(conditions, WRAPPING_FUNCTIONS), F.lit(False))
    return F.struct(
        *[flag.alias(name) for name, flag in flags.items()], joins.alias("join_count"), wrapped.alias("has_function_wrapped_predicate")
    )


def unstable_reason(sql: Column, masked: Column, top: Column) -> Column:
    """Why two runs of a clean query may differ, or NULL."""
    unquoted = F.regexp_replace(sql, _CLOSED_STRING, "''")
    unordered = top.rlike(r"(?i)\bLIMIT\b") & ~top.rlike(r"(?i)\bORDER\b")
    return let(
        F.regexp_extract(unquoted, _any_call(UNSTABLE_FUNCTIONS), 1),
        lambda name: F.when(name != "", F.concat(F.lit("uses the non-deterministic function "), name))
        .when(unordered, "uses LIMIT without an ordering")
        .when(masked.rlike(r"(?i)\bSAMPLE\s+[\d.]|\bTABLESAMPLE\b"), "reads a sample"),
    )


def external_function(masked: Column) -> Column:
    """The first function in the text that reaches outside, or NULL."""
    return F.nullif(
        F.regexp_extract(masked, _any_call(EXTERNAL_FUNCTIONS + JVM_FUNCTIONS), 1), F.lit("")
    )


def reject_reasons(text: Column, line: Column, top: Column) -> Column:
    """All reasons why a clean statement is not one plain query that may be checked.

    ``text`` is its skeleton, ``line`` the word line of it and ``top`` that of what is in no parentheses.
    """
    begins = F.get(F.split(line, " ", 3), F.lit(1))
    external = external_function(text)
    rules = [
        # How it begins.
        ("empty statement", begins == ""),
        ("not a query", ~begins.isin("", "SELECT", "WITH")),
        ("WITH without a top-level SELECT", (begins == "WITH") & ~_says(top, "SELECT")),
        # What it holds anywhere.
        ("several statements", _says(line, ";")),
        (F.concat(F.lit("calls external function "), external), external.isNotNull()),
        # What it says about its result, outside of parentheses.
        ("changes settings", top.rlike(r" SETTINGS [A-Z_]\w* = ")),
        ("names an output format", top.rlike(r" FORMAT \w+ \z")),
        ("writes a file", _says(top, "INTO OUTFILE", "INTO DUMPFILE")),
    ]
    found = [F.when(condition, F.lit(reason) if isinstance(reason, str) else reason) for reason, condition in rules]
    return F.array_compact(F.array(*found))


def fingerprint(sql: Column, previous: Column | None = None) -> Column:
    """SHA-256 of a clean statement, or of a pair joined by a separator line."""
    if previous is None:
        return F.sha2(sql, 256)
    return F.sha2(F.concat(previous, F.lit("\n---\n"), sql), 256)


def normalize_query(sql: Column) -> Column:
    """The shape of a query: literals and lists of literals become placeholders."""
    spaced = F.btrim(F.regexp_replace(sql, r"\s+", " "), F.lit(_BLANKS))
    strings = F.regexp_replace(spaced, r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'", "?")
    numbers = F.regexp_replace(strings, r"\b[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\b", "?")
    return F.regexp_replace(numbers, r"\?(?:\s*,\s*\?)++", "?..")


def glob_to_regex(glob: str) -> str:
    """``*`` and ``?`` stay within a folder; ``**`` crosses folders, ``**/`` may be empty."""
    pieces = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    return "^" + "".join(pieces.get(part) or re.escape(part) for part in parts) + r"\z"
