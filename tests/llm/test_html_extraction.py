"""Main text of pages written out, pairing, alignment, and the registered query."""

from __future__ import annotations

import html
import itertools
import random
import re

import pytest
from messy import messy

from dataproof.llm.html_extraction import common_lines, extract_text, main_text, page_lines, shared_lines
from dataproof.llm.queries import QUERIES


@pytest.mark.parametrize(("source", "text"), [
    (None, ""), ("", ""), ("<p>", ""), ("plain  text", "plain text"),
    ("<article><h1>T &amp; t</h1><p>One\n two<br>three</article>", "T & t\n\nOne two three"),
    ("<nav>menu</nav><article><p>a<p>b <b>c<p>d</article><footer>f</footer>", "a\n\nb c\n\nd"),
    ("<body><header>top</header><main><p>x</p><aside>s</aside><form><p>f</p></form></main>", "x"),
    ("<article><p>x</p><section class='user comments'><article><p>nice</p></article></section></article>", "x"),
    ("<article><p>x</p><div id=cookie-notice>ok?</div><div class='share ad'>buy</div><p>y</p></article>", "x\n\ny"),
    ("<article><script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>&lt;b&gt; &#233;&nbsp;z</p></article>", "<b> é z"),
    ("<article><p title='a>b'>x</p><p hidden>no</p><p style='display: none'>no</p></article>", "x"),
    ("<article><header><h1>T</h1><p>by me</p></header><p>x</p></article><header>top</header>", "T\n\nx"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c</td><td>d</td></tr></table><pre> a\n  b</pre></article>", "one\n\ntwo\n\nc\n\nd\n\na b"),
    ("<p>a < b</p><p>unclosed <a href=\"x", "a < b\n\nunclosed <a href=\"x"),
])
def test_pages(source, text):
    assert main_text(page_lines(source), set()) == text


@pytest.mark.parametrize(("source", "text"), [
    ("<article class='post has-sidebar'><p>x</p></article>", "x"), ("<div id='layout-sidebar-right'><p>x</p></div>", "x"),
    ("<div class='content no-comments'><article><p>x</p></article></div>", "x"),
    ("<article class='related'><p>x</p></article>", "x"),
    ("<div class='sidebar'><p>s</p><div class=box><article><p>x</p></article></div></div><p>y</p>", "x"),
    ("<div class=widget><main><article class='widget'><p>x</p></article></main></div>", "x"),
    ("<div hidden><article><p>x</p></article></div><p>y</p>", "y"), ("<p>y</p><nav><article>x</article></nav>", "y"),
    ("<article><p>x</p><article class='comment'><p>nice</p></article></article>", "x"),
    ("<article><p data-hidden='false'>a</p><p title='a hidden gem'>b</p><p title=\"class='ad'\">c</p></article>", "a\n\nb\n\nc"),
    ("<article><p HIDDEN=''>n</p><p class='Ad-12'>n</p><div id=main_nav>n</div><div class='x cookie-banner'>n</div><p>a</p></article>", "a"),
    ("<article><p>a <svg class='i' /> b</p><p>c</p></article>", "a b\n\nc"), ("<article><script src='x'/><p>a</p></article>", "a"),
    ("<article><p>a <button>Share</p><p>b</p><button>ok</button><p>c</p></article>", "a\n\nb\n\nc"),
    ("<article><button>Share<p>b</p></article><p><button>ok</button></p>", "b"), ("<article><p>a <script>v=1;</p><p>b</p></article>", "a\n\nb"),
    ("<article><svg><svg/><svg><title>t</title></svg><text>n</text></svg><p>a<button><div>n</div></button>b</article>", "ab"),
    ("<article><script src=/js/>v='<p>n'</script><noscript><p>n</p></noscript><p>a</p></article>", "a"),
])
def test_marks_are_taken_at_their_word(source, text):
    assert main_text(page_lines(source), set()) == text


@pytest.mark.parametrize(("source", "text"), [
    ("<h1>Title</h1><h2>Below</h2><article><p>x y z</p></article><h2>More</h2>", "Title\n\nBelow\n\nx y z"),
    ("<h1>Site</h1><p>by me</p><article><p>x y z and more</p></article>", "x y z and more"),
    ("<div><p>A long text of the page.</p><p>And more of it.</p></div><article><a href=x>Teaser</a> in short</article>",
     "A long text of the page.\n\nAnd more of it.\n\nTeaser in short"),
    ("<article><p>a</p><div class='post-comments'>n</div><div class='advert_top'>n</div><div id='article_comments-2'>n</div></article>", "a"),
    ("<article class='post no-comments'><p>a</p><div class='has-comments'>b</div></article>", "a\n\nb"),
    ("<article><p>a</p><label>Name <input></label><p>b <label>n</p><p>c</p></article>", "a\n\nb\n\nc"),
])
def test_titles_teasers_and_compound_names(source, text):
    assert main_text(page_lines(source), set()) == text


def test_many_open_elements():
    source = "<article>" + "<p>a <svg> <script> <button>b" * 20_000
    assert len(page_lines(source)) == 20_000


def test_longest_common_lines():
    draw = random.Random(2)

    def longest(a, b):
        return max(len(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n)
                   if all(any(x == y for y in it) for it in [iter(b)] for x in c))

    for _ in range(60):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(8))] for _ in "ab")
        found = common_lines(a, b)
        assert found == sorted(set(found)) and len(found) == longest(a, b)
    assert shared_lines([1, 2, 3], [1, 2, 3]) == []
    assert shared_lines([1, 2, 3], [1, 5, 6]) == [0]


def test_template_lines_go(spark):
    """Without an article only what neighbours share tells the template; another host keeps the same line."""
    def page(n):
        return f"<div>Welcome to our site</div><div>Story {n} is long and new</div><div>More about {n}</div><div>Write to us</div>"

    rows = [(n, f"http://one.example/news/{n}", page(n)) for n in range(9)]
    rows += [(20, "http://two.example/news/1", page(20)), (21, "http://one.example/news/3", page(3)), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r for r in extract_text(df).collect()}
    for n in (0, 1, 5, 6, 8):
        assert found[n]["text"] == f"Story {n} is long and new\n\nMore about {n}"
    assert found[20]["text"].startswith("Welcome") and found[None]["text"] == "" and len(found) == len(rows)


def test_copies_are_looked_past(spark):
    """Copies, also near ones and under other paths, and long templates: the next page with another text tells."""
    def page(n, top="Welcome to our site", more=1):
        return f"<div>{top}</div><div>Story {n} is long and new</div><div>More about {n}</div>" + "".join(f"<div>Write to us {k}</div>" for k in range(more))

    rows = [(n, f"http://one.example/news/{n}", page(n)) for n in range(5)]
    rows += [(10 + n, f"http://one.example/{place}", page(3)) for n, place in enumerate(("news/3", "news/3/print", "old/3", "z"))]
    rows += [(20, "http://one.example/news/3", page(3).replace("<div>", "<div class=x>"))]
    # Templates of more than 80 percent, and two pages with the same long text next to one with another.
    rows += [(30 + n, f"http://two.example/{n}", page(n, more=20)) for n in range(3)]
    text = "".join(f"<div>Sentence {n}</div>" for n in range(20))
    rows += [(40, "http://three.example/a/1", f"<div>Top</div>{text}<div>at 10:01</div>")]
    rows += [(41, "http://three.example/a/2", f"<div>Top</div>{text}<div>at 10:02</div>")]
    rows += [(42, "http://three.example/b/1", "<div>Top</div><div>Else</div><div>at 10:03</div>")]
    # Pages far off in the order, over the ends of blocks.
    rows += [(1000 + n, f"http://four.example/{n:04d}", page(n)) for n in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    found = {r["page_id"]: r["text"] for r in extract_text(df).collect()}
    own = {**{n: n for n in range(5)}, **{10 + n: 3 for n in range(4)}, 20: 3, **{30 + n: n for n in range(3)}}
    own |= {1000 + n: n for n in range(300)}
    for page_id, n in own.items():
        assert found[page_id] == f"Story {n} is long and new\n\nMore about {n}", page_id
    sentences = "\n\n".join(f"Sentence {n}" for n in range(20))
    assert found[40] == f"{sentences}\n\nat 10:01" and found[41] == f"{sentences}\n\nat 10:02" and len(found) == len(rows)


def test_prose_in_articles_stays(spark):
    page = "<nav>m</nav><article><p>The same first sentence.</p><p>Story {}.</p><p><a href=x>All stories</a></p></article>"
    df = spark.createDataFrame([(n, f"http://h/{n}", page.format(n)) for n in range(4)], "page_id long, url string, html string")
    for row in extract_text(df).collect():
        assert row["text"] == f"The same first sentence.\n\nStory {row['page_id']}."


def test_messy_rows(spark):
    long = "<article>" + "".join(f"<p>Paragraph {n}</p>" for n in range(20_000)) + "</article>"
    df = messy(spark, [(1, "http://h/a", long), (1, "http://h/a", long), (None, None, "<p>x</p>"), (2, "", None)], "page_id", "url")
    df = df.withColumnRenamed("lang", "html").withColumnRenamed("host", "key_a").withColumnRenamed("verdict", "shared")
    rows = extract_text(df).collect()
    whole = "\n\n".join(f"Paragraph {n}" for n in range(20_000))
    assert sorted((r["page_id"] or 0, r["text"]) for r in rows) == [(0, "x"), (1, whole), (1, whole), (2, "")]
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert extract_text(df.limit(0)).count() == 0


def test_registered(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op3_html_text"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for row in rows:
        article = re.search(r"<article>(.*?)</article>", pages[row["page_id"]]["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        text = "\n\n".join(b for b in blocks if b)
        assert (row["text"], row["n_chars"], row["url"]) == (text, len(text), pages[row["page_id"]]["url"])
