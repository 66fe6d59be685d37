"""Main text of web pages, by marked regions and by what neighbouring pages of a host share.

Pages of a host are put in the order of their url paths and each is paired with the nearest page that has
another text. The text lines of the two are aligned by a longest common subsequence, and lines outside an
article that both have are deleted: a template wrote them, not an author. Regions that the
markup itself names (menus, footers, adverts, forms, comments) go in any case, and prose inside an article
stays, however often it is repeated elsewhere.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataproof.llm.url_templates import host_of, path_of
from dataproof.sources.shared import keep_table

#: Two pages that share more of their lines than this may have the same text; pages further off are asked first.
CLOSE_PERCENT = 80
#: Neighbours looked at on each side of a page, and pages that are compared in one go.
REACH, BLOCK = 8, 128
#: Rows handed on at a time.
ROWS_AT_ONCE = 256

# --- fixed values: elements of the markup language and usual names of page regions --------------------

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without main text: those that hold no markup, and others; of these, those that cannot hold another of their kind.
_RAW = frozenset("script style iframe textarea title".split())
_SKIPPED = frozenset("noscript template object svg math select button canvas audio video label".split())
_ALONE = _SKIPPED - frozenset("template object svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_OUTSIDE = frozenset("aside footer form head menu nav dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_REGIONS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay newsletter subscribe subscription signup login social share sharing related recommended comment "
    "comments commentlist disqus reply replies respond widget widgets toolbar pagination pager search skip".split()
)
#: Regions named by their last word or their first, whatever the others say; first words that speak of a region and name none.
_LAST = frozenset("comments commentlist disqus".split())
_FIRST = frozenset("advert adverts advertisement advertisements advertising sponsored".split())
_ABOUT = frozenset("no has with without hide show toggle open closed allow".split())
#: Regions named by two words.
_COMPOUNDS = frozenset(
    f"{first}-{second}" for firsts, seconds in (
        ("site page main global top bottom left right primary secondary", "nav navbar navigation menu footer sidebar banner ad"),
        ("nav navigation menu", "bar menu list links"), ("footer sidebar", "nav menu links widgets"),
        ("cookie cookies consent gdpr", "notice banner bar consent popup message"),
        ("comment comments", "list form area section thread"), ("related recommended", "posts articles stories content links"),
        ("share sharing social", "buttons bar links icons share sharing"),
        ("ad ads advert", "container slot banner wrapper unit box block"), ("newsletter", "signup form subscribe box"),
        ("search", "form box bar"), ("skip", "link links nav"),
    ) for first in firsts.split() for second in seconds.split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([^\s"'=/<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
#: The slash that closes a tag at once; in a value without quotes it belongs to the value.
_AT_ONCE = re.compile(r"""(?:^|["'\s]|\s[^\s="']+)/\s*\Z""")
_BOUNDARY = re.compile(rf"</?(?:{'|'.join(sorted(_BLOCK))})(?=[\s/>])", re.IGNORECASE)
_NUMBERED = re.compile(r"-?[0-9]+\Z")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Line:
    """One block of text; ``article``: it stands in an article or main element; ``links``: its linked characters."""

    text: str
    article: bool
    links: int = 0
    heading: bool = False

    @property
    def own(self) -> int:
        """Characters that are no links."""
        return len("".join(self.text.split())) - self.links


@dataclass
class _Open:
    name: str
    dropped: bool
    article: bool
    header: bool = False
    #: Dropped by more than a class or id, and in an article element.
    sure: bool = False
    inside: bool = False


@dataclass
class _Lines:
    """Collects text until a block ends."""

    found: list[Line] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    article: bool = False
    heading: bool = False

    def end(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            self.found.append(Line(text, self.article, self.links, self.heading))
        self.parts, self.links = [], 0

    def add(self, text: str, article: bool, linked: bool, heading: bool) -> None:
        self.article, self.heading = article, heading
        self.parts.append(text)
        if linked:
            self.links += len("".join(text.split()))


def _named(value: str) -> bool:
    """Whether one of the whole names in a class or id is that of a region."""
    for name in value.lower().split():
        name = _NUMBERED.sub("", re.sub("[_-]+", "-", name))
        words = name.split("-")
        if name in _REGIONS or name in _COMPOUNDS:
            return True
        if words[0] not in _ABOUT and (words[-1] in _LAST or words[0] in _FIRST):
            return True
    return False


def _marked_region(attributes: str) -> tuple[bool, bool]:
    """Whether the attributes hide the element or give it another role, and whether they name it a menu, an advert and the like."""
    sure = named = False
    for found in _ATTRIBUTE.finditer(attributes):
        key, value = found.group(1).lower(), (found.group(2) or "").strip("\"'").lower()
        sure |= (
            key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in _ROLES
            or key == "style" and _HIDDEN_STYLE.search(value) is not None
        )
        named |= key in ("class", "id") and _named(value)
    return sure, named


class _Ends:
    """Where the elements without main text end: at their closing tag, or left open, at the next block."""

    def __init__(self, source: str):
        self.source, self.open_raw, self.closed = source, set(), None

    def end(self, name: str, tag: re.Match) -> int:
        if _AT_ONCE.search(tag.group("attributes") or ""):
            return tag.end()
        end = self._raw(name, tag.end()) if name in _RAW else self._skipped().get(tag.start())
        if end is None:
            block = _BOUNDARY.search(self.source, tag.end())
            end = block.start() if block else len(self.source)
        return end

    def _raw(self, name: str, at: int) -> int | None:
        if name in self.open_raw:
            return None
        close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(self.source, at)
        if close is None:
            self.open_raw.add(name)
        return close and close.end()

    def _skipped(self) -> dict[int, int]:
        """Ends of the others by their starts, if they are closed within the element around them."""
        if self.closed is not None:
            return self.closed
        self.closed, stack, latest, count, at = {}, [], {}, Counter(), 0
        while tag := _TAG.search(self.source, at):
            at, name = tag.end(), (tag.group("name") or "").lower()
            if name in _RAW and not tag.group("close") and not _AT_ONCE.search(tag.group("attributes") or ""):
                at = self._raw(name, at) or at
            if name in _VOID or name not in _BLOCK and name not in _SKIPPED:
                continue
            if tag.group("close"):
                while count[name]:
                    last, start = stack.pop()
                    count[last] -= 1
                    if last == name:
                        if name in _SKIPPED:
                            self.closed[start] = at
                        break
            elif name in _BLOCK or not _AT_ONCE.search(tag.group("attributes") or ""):
                if name in _ALONE and count[name]:
                    latest[name][0] = ""
                    count[name] -= 1
                latest[name] = [name, tag.start()]
                stack.append(latest[name])
                count[name] += 1
        return self.closed


def page_lines(source: str | None) -> list[Line]:
    """The blocks of a page in order, without the regions that its markup marks as no main text.

    Elements left open end with the element around them, a paragraph with the next block. Text outside
    an element that names its kind is kept as a line that is not in an article.
    """
    lines, stack = _Lines(), [_Open("", False, False)]
    at, anchors = 0, 0
    source = source or ""

    def text(piece: str) -> None:
        top = stack[-1]
        if piece and not top.dropped:
            lines.add(piece, top.article, anchors > 0, top.name in _HEADINGS)

    ends = _Ends(source)
    while tag := _TAG.search(source, at):
        text(source[at:tag.start()])
        at = tag.end()
        name = (tag.group("name") or "").lower()
        if not name:
            continue
        if name == "a":
            anchors = max(0, anchors + (-1 if tag.group("close") else 1))
        if name == "br":
            text(" ")
        if name in _BLOCK:
            lines.end()
        if name in _VOID:
            continue
        if name in _RAW or name in _SKIPPED:
            at = at if tag.group("close") else ends.end(name, tag)
            continue
        if tag.group("close"):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
            continue
        above = stack[-1]
        if name == "p" or name in _BLOCK and above.name == "p":
            while len(stack) > 1 and stack[-1].name not in _BLOCK - {"p"}:
                stack.pop()
            above = stack[-1]
        sure, named = _marked_region(tag.group("attributes") or "")
        if name in ("html", "body", "main") or name == "article" and not above.inside:
            named = False
        region = sure or named
        if name not in _BLOCK and name not in _OUTSIDE and not region:
            continue
        in_header = above.header or name == "header"
        sure = above.sure or sure or name in _OUTSIDE or name == "header" and not above.article
        dropped = above.dropped or region or sure
        if name in ("article", "main") and not above.inside:
            # What is around an article may be called a menu or have one; the article is no part of it.
            dropped = sure
        if in_header and above.article:
            # Of a header inside an article the headings belong to the article.
            dropped = above.dropped and not above.header or region or name not in _HEADINGS
        article = above.article or name in ("article", "main")
        stack.append(_Open(name, dropped, article, in_header, sure, above.inside or name == "article"))
    text(source[at:])
    lines.end()
    return lines.found


def mostly_links(line: Line) -> bool:
    """Whether a line consists of links for the larger part."""
    return 2 * line.links > len("".join(line.text.split()))


def main_text(lines: list[Line], shared: set[int]) -> str:
    """The article's lines if there is an article, else all; without the shared lines that are not its prose.

    An article counts if it has at least half of the page's text, links and other headings aside; else it is a teaser
    beside the text. Headings straight before the article belong to it.
    """
    article = [number for number, line in enumerate(lines) if line.article]
    if sum(lines[number].own for number in article) < sum(line.own for line in lines if not line.article and not line.heading):
        article = []
    main = set(article or range(len(lines)))
    before = article[0] - 1 if article else -1
    while before >= 0 and lines[before].heading and before not in shared:
        main.add(before)
        before -= 1
    kept = [
        line.text for number, line in enumerate(lines)
        if number in main and not (number in shared and (not line.article or mostly_links(line)))
    ]
    return "\n\n".join(kept)


def common_lines(own: list[int], other: list[int]) -> list[int]:
    """Places in ``own`` of one longest common subsequence, by chains of matching places."""
    places: dict[int, list[int]] = defaultdict(list)
    for at, line in enumerate(other):
        places[line].append(at)
    ends: list[int] = []
    links: list[tuple[int, object]] = []
    for at, line in enumerate(own):
        for place in reversed(places.get(line, ())):
            depth = bisect_left(ends, place)
            link = (at, links[depth - 1] if depth else None)
            if depth == len(ends):
                ends.append(place)
                links.append(link)
            else:
                ends[depth], links[depth] = place, link
    chain, found = links[-1] if links else None, []
    while chain is not None:
        found.append(chain[0])
        chain = chain[1]
    return found[::-1]


def shared_lines(own: list[int], *others: list[int]) -> list[int]:
    """The lines of a page that a template wrote, by its neighbours, the nearest first.

    Pages that have all of its lines are copies and tell nothing. The first page that shares up to
    CLOSE_PERCENT of the lines decides; if there is none, the lines that all closer pages share.
    """
    close: list[set[int]] = []
    for other in others:
        found = common_lines(own, other)
        if len(found) == len(own):
            continue
        if 100 * len(found) <= CLOSE_PERCENT * max(len(own), len(other)):
            return found
        close.append(set(found))
    return sorted(set.intersection(*close)) if close else []


def nearness(path: str, other: str) -> int:
    """How many characters two paths begin with in common."""
    return next((k for k, (a, b) in enumerate(zip(path, other, strict=False)) if a != b), min(len(path), len(other)))


def nearest(own: tuple, before: list[tuple], after: list[tuple]) -> Iterator[list[int]]:
    """Lines of the neighbours (host, path, lines) of a page's host, the longer path in common first.

    Both sides are given from the page outwards; in the order of paths what follows is never nearer.
    """
    sides = [iter([x for x in side[:REACH] if x[0] == own[0]]) for side in (before, after)]
    heads = [next(side, None) for side in sides]
    while any(heads):
        side = max((k for k in (0, 1) if heads[k]), key=lambda k: nearness(own[1], heads[k][1]))
        yield heads[side][2]
        heads[side] = next(sides[side], None)


def _keyed(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    given = df.select(df[id_col].alias("id"), df[url_col].alias("url"), df[html_col].alias("html"))
    return given.select("*", F.xxhash64("html").alias("key_a"), F.xxhash64("url", F.col("id").cast("string"), F.lit(1)).alias("key_b"))


_PAGE = "key_a long, key_b long, host string, path string, same long, lines array<long>"
_PLACED = "block long, place long, host string, path string, same long, lines array<long>"


def shared_by_neighbours(pages: DataFrame) -> DataFrame:
    """(key_a, key_b, shared line numbers) of pages that share lines with their neighbours.

    Only hashes of lines are moved. Pages of a host with equal lines are one page here, under the first of
    their paths. They are numbered in the order of (host, path), by ranges, so a large host is spread over
    many tasks, and compared in blocks of numbers; the pages at a block's ends are in both blocks.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [
                [xxhash.xxh3_64_intdigest(line.text) - (1 << 63) for line in page_lines(source)]
                for source in batch.column(4).to_pylist()
            ]
            same = [xxhash.xxh3_64_intdigest(np.array(x, np.int64).tobytes()) - (1 << 63) for x in lines]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(same, pa.int64()), pa.array(lines, pa.list_(pa.int64()))],
                names=["key_a", "key_b", "host", "path", "same", "lines"],
            )

    own, _ = keep_table(
        pages.select("key_a", "key_b", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
        .mapInArrow(hashed, _PAGE).where(F.size("lines") > 0), "page-lines",
    )
    different = own.groupBy("host", "same").agg(F.min("path").alias("path"), F.first("lines").alias("lines"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            numbers = pa.array(range(place, place + batch.num_rows), pa.int64())
            place += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * batch.num_rows, pa.int64()), numbers, *batch.columns],
                names=["block", "place", "host", "path", "same", "lines"],
            )

    order = ["host", "path", "same"]
    ranged, _ = keep_table(
        different.select(*order, "lines").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(placed, _PLACED),
        "page-order",
    )
    base, total = {}, 0
    for part, count in sorted(ranged.groupBy("block").count().collect()):
        base[part], total = total, total + count

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            at = np.array([base[part] + k for part, k in zip(rows["block"], rows["place"], strict=True)], np.int64)
            low, high = (at - REACH) // BLOCK, (at + REACH) // BLOCK
            for block in (low, high):
                taken = np.flatnonzero(low < high) if block is high else np.arange(len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[taken]), pa.array(at[taken]), *[column.take(pa.array(taken)) for column in batch.columns[2:]]],
                    names=batch.schema.names,
                )

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for block, group in groupby(rows, key=lambda row: row[0]):
            found, group = [], list(group)
            told = [(host, path, lines) for _, _, host, path, _, lines in group]
            for k, (_, place, host, _, same, lines) in enumerate(group):
                if place // BLOCK == block:
                    shared = shared_lines(lines, *nearest(told[k], told[max(0, k - REACH):k][::-1], told[k + 1:k + 1 + REACH]))
                    if shared:
                        found.append((host, same, shared))
            host, same, shared = zip(*found, strict=True) if found else ((),) * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(same, pa.int64()), pa.array(shared, pa.list_(pa.int32()))],
                names=["host", "same", "shared"],
            )

    shared = (
        ranged.mapInArrow(dealt, _PLACED).repartition("block").sortWithinPartitions("block", "place")
        .mapInArrow(within, "host string, same long, shared array<int>")
    )
    keys = own.select("key_a", "key_b", "host", "same").dropDuplicates()
    return keys.join(shared, ["host", "same"]).select("key_a", "key_b", "shared")


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: the id, the url, ``text`` and ``n_chars``.

    Blocks are joined in page order by an empty line; white space inside a block is one space, character
    references are decoded. NULL and empty pages have an empty text. A page alone on its host, or with copies
    only, has no neighbour and loses no shared line. Identical rows get identical results; pages with equal paths are
    ordered by content. Ids and urls may be NULL or repeat. An empty table gives an empty result. Other
    columns are not read, so their names cannot clash.
    """
    pages = _keyed(df, id_col, url_col, html_col)
    shared, _ = keep_table(shared_by_neighbours(pages), "shared-lines")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                sources, dropped = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                texts = [main_text(page_lines(x), set(numbers or ())) for x, numbers in zip(sources, dropped, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return (
        pages.join(shared, ["key_a", "key_b"], "left").select("id", "url", "html", "shared")
        .mapInArrow(render, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
    )
