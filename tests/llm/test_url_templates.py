"""Url verdicts against SQL and against urls written out."""

from __future__ import annotations

import random

import pytest
from messy import messy
from oracle import both
from pyspark.sql import functions as F

from dataproof.llm.queries import URL_RULES
from dataproof.llm.url_templates import Rule, general_path, judge_urls


def test_sql_agrees(spark, sf_dir):
    got, expected = both(spark, "op10_url_filters", sf_dir)
    assert got == expected


URLS = [
    ("HTTP://Blog.Example.COM/en/1?x=/es/", "blog.example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("https://x.net/es/1#a", "x.net", "/es/1", "net/es/", "block"),
    ("https://x.net/de/1", "x.net", "/de/1", None, "allow"),
    ("https://x.com?q=://y.net/es/", "x.com", "", None, "allow"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("a://b://c.net/fr/", "b:", "//c.net/fr/", None, "allow"),
]


def test_rules(spark):
    df = messy(spark, [(n, row[0], None) for n, row in enumerate(URLS)] * 2, "page_id", "url")
    rows = judge_urls(df, URL_RULES).collect()
    assert len(rows) == 2 * len(URLS)
    for row in rows:
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == URLS[row["page_id"]][1:]
    assert judge_urls(df.limit(0), URL_RULES).count() == 0


@pytest.mark.parametrize(("path", "general"), [
    ("/en/12/", "/en/{n}"), ("", ""), ("/", ""), ("//a//b", "/a/b"), ("/p/0123456789abcdef0/x1.html", "/p/{h}/x{n}.html"),
])
def test_general_paths(spark, path, general):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(general_path(F.col("path"))).first()[0] == general


def test_templates_spread_verdicts(spark):
    """A branch that the rules settle is judged as a whole, siblings alike are merged, unknown ones are let be."""
    rules = [Rule("block", "h.org", "/spam/a"), Rule("block", "h.org", "/junk/b"), Rule("allow", "h.org", "/good/")]
    urls = [f"http://h.org/spam/a/{n}" for n in range(40)] + [f"http://h.org/junk/b{n}/x" for n in range(40)]
    urls += [f"http://h.org/good/{n}" for n in range(40)] + [f"http://h.org/new/{n}" for n in range(40)]
    urls += ["http://h.org/spam/z/1", "http://h.org/" + "/".join("abcdefghij")]
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    found = {urls[r["page_id"]]: r for r in rows}
    assert found["http://h.org/spam/a/1"]["template"].startswith("/<blocked>")
    assert found["http://h.org/good/1"]["template"].startswith("/<allowed>")
    assert found["http://h.org/new/1"]["template"].startswith("/new/") and found["http://h.org/new/1"]["verdict"] == "allow"
    assert found[urls[-1]]["template"] == "/" + "/".join("abcdefghij") and len(rows) == len(urls)
    # No label of its own, beside a branch that the rules settle.
    assert found["http://h.org/spam/z/1"]["template"] == "/<blocked>/z/{n}" and found["http://h.org/spam/z/1"]["verdict"] == "allow"
    # A name of numbers is a wildcard: what no rule fits goes with the labelled ones of its template.
    rules = [Rule("block", "h.org", f"/p/{n}") for n in range(1, 6)]
    urls = [f"http://h.org/p/{n}" for n in range(0, 100)]
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert {r["template"] for r in rows} == {"/<blocked>/<blocked>"} and {r["verdict"] for r in rows} == {"block"}


@pytest.mark.parametrize("sections, blocked", [(16, 9), (25, 13), (60, 55)])
def test_the_number_of_sections_decides_nothing(spark, sections, blocked):
    """Undecided sections of a host are allowed, however many of its sections are blocked."""
    names = [f"s{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(sections)]
    rules = [Rule("block", "h.org", f"/{name}/") for name in names[:blocked]]
    urls = [f"http://h.org/{name}/{n}/page{n % 7}" for name in names for n in range(40)]
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    verdicts = {(urls[r["page_id"]].split("/")[3], r["verdict"]) for r in rows}
    assert verdicts == {(name, "block" if k < blocked else "allow") for k, name in enumerate(names)}


def brute_templates(urls):
    """(host, general): template, by recursion over (host, general, label)."""
    found = {}

    def settle(rows, level, host, prefix):
        for (segment,), members in groups(rows, lambda r: (r[0].split("/")[1:][level],) if len(r[0].split("/")) - 1 > level else None):
            labels = [r[1] for r in members if r[1] is not None]
            name = segment
            if labels:
                n, share, z = len(labels), sum(labels) / len(labels), 1.96
                middle, half = share + z * z / (2 * n), z * (share * (1 - share) / n + z * z / (4 * n * n)) ** 0.5
                low, high = (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)
                name = "<blocked>" if low > 0.5 else "<allowed>" if high < 0.5 else segment
            nodes.setdefault((host, level + 1, prefix + "/" + name), []).extend(members)

    def groups(rows, key):
        out = {}
        for row in rows:
            if key(row) is not None:
                out.setdefault(key(row), []).append(row)
        return out.items()

    nodes = {}
    for host, general, label in urls:
        nodes.setdefault((host, 0, ""), []).append((general, label))
    while nodes:
        (host, level, prefix), rows = nodes.popitem()
        for general, _ in rows:
            if len(general.split("/")) - 1 == level:
                found[host, general] = prefix
        settle(rows, level, host, prefix)
    return found


def test_templates_by_recursion(spark):
    from dataproof.llm.url_templates import path_templates

    draw = random.Random(6)
    urls = []
    for _ in range(900):
        path = "".join(f"/{draw.choice('abcd')}" for _ in range(draw.randrange(6)))
        label = {"/a": 1, "/b": 0, "/c": draw.choice([0, 1, None])}.get(path[:2])
        urls.append((draw.choice("xy"), path, label if draw.random() < 0.8 else None))
    rows = path_templates(spark.createDataFrame(urls, "host string, general string, label int")).collect()
    assert {(r["host"], r["general"]): r["template"] for r in rows} == brute_templates(urls)
