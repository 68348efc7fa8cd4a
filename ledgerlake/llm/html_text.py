"""Operator 13: the main text of pages, by removing what a site's template repeats.

Pages are read once into pieces of text between block breaks, and into elements, each with its range of pieces and a hash of its subtree. Spark counts
in how many pages of a host a subtree occurs; one that occurs in many of them is the site's template and is deleted, with all that lies below it. What is
left of menus, adverts, forms, comments and the like, on sites too small to repeat them, goes by the names of its elements and classes, and of pages
that mark their article only that is taken.

An article may itself be copied to many pages. So no subtree that holds the article is counted, nor one with half of its page's text; inside an
article only what consists of links is, and equal pages count once. Prose of an article is never template, however often it occurs.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import joined_with_hot, written

#: Pages of a host from which a subtree is template; of running text outside an article also a share of the host's pages.
MANY_PAGES, PROSE_SHARE = 5, 0.5
#: Pages with one template subtree from which it is sent to every task, and such subtrees at most; template subtrees that are sent as one set.
HOT, MOST_HOT = 10_000, 200_000
MOST_SENT = 200_000

#: Elements of HTML (fixed values): without content, without text to show, whose text is no markup, never part of an article, that begin and end
#: a block, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
HIDDEN = frozenset("head script style noscript template svg math iframe object audio video canvas textarea title noembed noframes".split())
FURNITURE = frozenset("nav header footer aside form button select menu dialog fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table caption tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html tr tbody thead tfoot caption option legend".split())
CELLS = frozenset(("td", "th"))
CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "tbody": "tbody thead tr td th", "tfoot": "tbody thead tr td th", "option": "option", "body": "head"}
CLOSED_BY = {k: frozenset(v.split()) for k, v in CLOSED_BY.items()}
#: An opening tag closes none of these, nor anything outside them.
SCOPES = frozenset("html body table ul ol dl div article section main aside nav header footer form select blockquote".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figcaption span b i em strong u small code summary".split())
ARTICLES = frozenset(("article", "main"))
#: Words of classes, ids and roles that name what isn't the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar footer contentinfo "
    "sidebar complementary widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe subscription signup login search "
    "form header share sharing social related recommended recommendations trending comments comment commentlist disqus respond reply replies reactions pagination pager skip hidden toolbar copyright".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies disqus reactions".split())

NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
MARK = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

#: Bytes of text, or rows, of a batch that a task gives back.
BATCH_BYTES, BATCH_ROWS = 1 << 22, 1 << 14


def _names(attributes: str) -> tuple[set[str], bool]:
    """Words of class, id and role, in lower case, and whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden":
            hidden |= name == "hidden" or value == "true"
        else:
            words.update(w.lower() for w in PARTS.findall(value))
    return words, hidden


def _tag_end(source: str, at: int) -> int:
    """Place of the > that ends the tag, from at on; quotes hide it only where they begin a value. -1 if there is none."""
    here = at
    while m := MARK.search(source, here):
        if m[0] == ">":
            return m.start()
        here = m.end()
        before = m.start() - 1
        while before > at and source[before].isspace():
            before -= 1
        if source[before] == "=" and (close := source.find(m[0], here)) >= 0:
            here = close + 1
    return -1


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Element(NamedTuple):
    """One subtree: its pieces, a hash of its tags and texts (not of attributes), characters of text and of text in links, whether it is an article, lies
    in one, must go by its names, and is of readers' comments."""

    tag: str
    start: int
    end: int
    hash: int
    size: int
    linked: int
    article: bool
    inside: bool
    go: bool
    comments: bool


class Page:
    """pieces: texts, or None where a block begins or ends; elements, each behind those that it holds."""

    def __init__(self, source: str):
        self.pieces: list[str | None] = []
        self.elements: list[Element] = []
        self._open: list[list] = []
        self._counts: Counter[str] = Counter()
        self._inside = 0
        self._read(source)
        while self._open:
            self._close()

    def _text(self, raw: str, decode: bool = True) -> None:
        if not raw:
            return
        text = html.unescape(raw) if decode and "&" in raw else raw
        self.pieces.append(text)
        if self._open:
            shown = " ".join(text.split())
            top = self._open[-1]
            if shown:
                top[3].append(shown)
                top[4] += len(shown)
                top[5] += len(shown) if self._counts["a"] else 0

    def _enter(self, tag: str, attributes: str) -> None:
        words, hidden = _names(attributes) if "=" in attributes or "hidden" in attributes.lower() else (set(), False)
        comments = bool(words & COMMENTS)
        article = not comments and (tag in ARTICLES or "main" in words and tag == "div")
        go = hidden or tag in HIDDEN or tag in FURNITURE or bool(words & NAMES)
        if self._inside and (tag == "header" or "header" in words):  # holds the article's own heading
            go = hidden or bool(words & NAMES - {"header"})
        if tag in BLOCKS or tag in CELLS:
            self.pieces.append(None if tag in BLOCKS else " ")
        #                  tag, start, go, parts of the hash, characters, of them in links
        self._open.append([tag, len(self.pieces), go, [], 0, 0, article, self._inside > 0, comments])
        self._inside += article
        self._counts[tag] += 1

    def _close(self) -> None:
        tag, start, go, parts, size, linked, article, inside, comments = self._open.pop()
        self._counts[tag] -= 1
        self._inside -= article
        h = xxhash.xxh64_intdigest(f"{tag}\0{chr(0).join(parts)}")
        self.elements.append(Element(tag, start, len(self.pieces), _signed(h), size, linked, article, inside, go, comments))
        if self._open and size and not (tag in HIDDEN or comments):
            top = self._open[-1]
            top[3].append(f"\1{h:x}")
            top[4] += size
            top[5] += linked
        if tag in BLOCKS or tag in CELLS:
            self.pieces.append(None if tag in BLOCKS else " ")

    def _starts(self, tag: str, attributes: str) -> None:
        closed = CLOSED_BY.get(tag, frozenset())
        if closed or tag in CLOSES_P and self._counts["p"]:
            wanted = closed | {"p"} if tag in CLOSES_P else closed
            # outermost element to close, within the nearest scope
            at = None
            for i in range(len(self._open) - 1, -1, -1):
                name = self._open[i][0]
                if name in wanted:
                    at = i
                elif name in SCOPES:
                    break
            while at is not None and len(self._open) > at:
                self._close()
        if tag == "br":
            self.pieces.append(" ")
        elif tag in VOID:
            if tag in BLOCKS:
                self.pieces.append(None)
        else:
            self._enter(tag, attributes)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        closers: dict[str, re.Pattern] = {}
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                self._text(source[at:])
                return
            if lt > at:
                self._text(source[at:lt])
            after = source[lt + 1 : lt + 2]
            if after in ("!", "?"):
                end = source.find("-->", lt + 4) + 2 if source.startswith("<!--", lt) else source.find(">", lt)
                if end < lt:  # never closed: a comment lasts to the end
                    return
                at = end + 1
                continue
            m = NAME.match(source, lt + 1) if after.isalpha() or after == "/" else None
            if m is None:
                self._text("<")
                at = lt + 1
                continue
            end = _tag_end(source, m.end())
            if end < 0:  # cut off inside a tag
                return
            tag, attributes, at = m[1].lower(), source[m.end() : end], end + 1
            if after == "/":
                self._ends(tag)
                continue
            self._starts(tag, attributes)
            if attributes.endswith("/") and self._open and self._open[-1][0] == tag and tag not in BLOCKS and tag not in RAW:
                self._close()
            elif tag in RAW:
                found = closers.setdefault(tag, re.compile(f"</{tag}", re.I)).search(source, at)
                stop = found.start() if found else n
                self._text(source[at:stop], decode=tag in ("title", "textarea"))
                at = stop

    def _ends(self, tag: str) -> None:
        if not self._counts[tag]:
            if tag == "p":
                self.pieces.append(None)
            return
        if tag not in BLOCKS and tag not in CELLS:  # a block isn't ended by what began around it
            for top in reversed(self._open):
                if top[0] == tag:
                    break
                if top[0] in BLOCKS:
                    return
        while self._open[-1][0] != tag:
            self._close()
        self._close()

    def _article(self) -> tuple[int, int]:
        """Pieces of the article with the most text, of the elements article if there are any, or else of the main part; an empty range if there is none."""
        found = [e for e in self.elements if e.article]
        best = max([e for e in found if e.tag == "article"] or found, key=lambda e: (e.size, -e.start), default=None)
        return (best.start, best.end) if best else (-1, -1)

    def _judged(self) -> Iterator[tuple[Element, bool, bool]]:
        """Elements, outermost first, with whether they may be template, and whether they go by their names."""
        start, end = self._article()
        half = max([e.size for e in self.elements if e.tag in ("body", "html")], default=sum(len(p) for p in self.pieces if p)) / 2
        for e in sorted(self.elements, key=lambda e: (e.start, -e.end)):
            holds = e.start <= start and e.end >= end >= 0
            small = e.size < half or start >= 0
            may = bool(e.size) and not holds and e.size < half and e.tag not in ("html", "body") and e.tag not in HIDDEN and (not e.inside or 2 * e.linked >= e.size)
            yield e, may, e.go and not holds and (small or e.comments or e.tag in HIDDEN)

    def counted(self) -> dict[int, int]:
        """Hashes of the distinct subtrees that may be template, and whether each is prose (1) or anything else (0)."""
        return {e.hash: int(e.tag in PROSE and not e.linked) for e, may, _ in self._judged() if may}

    def main_text(self, template: set[int]) -> tuple[str, int]:
        """The blocks that are left, and how many subtrees went as template."""
        keep = bytearray(b"\1") * len(self.pieces)
        cut = last = 0
        articles = []
        for e, may, go in self._judged():
            if e.end <= last:  # lies in a deleted one
                continue
            known = may and e.hash in template
            if known or go:
                keep[e.start : e.end] = bytes(e.end - e.start)
                last = e.end
                cut += known
            elif e.article:
                articles.append(e)
        chosen = [e for e in articles if e.tag == "article"] or articles
        if chosen:
            within = bytearray(len(self.pieces))
            for e in chosen:
                within[e.start : e.end] = b"\1" * (e.end - e.start)
            keep = bytes(a & b for a, b in zip(keep, within, strict=True))
        blocks: list[str] = []
        now: list[str] = []
        for piece, here in zip([*self.pieces, None], [*keep, 1], strict=True):
            if piece is None:
                if now and (text := " ".join("".join(now).split())):
                    blocks.append(text)
                now = []
            elif here:
                now.append(piece)
        return "\n".join(blocks), cut


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    return F.when(host != "", host)


def _subtrees(pages: DataFrame) -> DataFrame:
    """d, site, hash and prose of each distinct subtree of each page that may be template."""
    names = ["d", "site", "hash", "prose"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        for b in batches:
            for i in range(b.num_rows):
                source, d, site = (b.column(c)[i].as_py() for c in ("html", "d", "site"))
                out += [(d, site, h, prose) for h, prose in Page(source).counted().items()]
                if len(out) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return pages.filter("html <> '' and site is not null").mapInArrow(run, "d long, site long, hash long, prose int")


def _extracted(pages: DataFrame, sent: dict[int, set[int]] | None) -> DataFrame:
    """page_id, url, text, n_chars and n_template of pages, whose template subtrees stand in column hits, or for each site in sent."""
    every = pages.sparkSession.sparkContext.broadcast(sent) if sent is not None else None
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_template", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, site, source, hits = (b.column(c)[i].as_py() for c in ("page_id", "url", "site", "html", "hits"))
                text, cut = Page(source or "").main_text(set(hits or ()) if every is None else every.value.get(site, set()))
                out.append({"page_id": page_id, "url": url, "text": text, "n_chars": len(text), "n_template": cut})
                size += len(text)
                if size >= BATCH_BYTES or len(out) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return pages.select("page_id", "url", "site", "html", "hits").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_template long")


def main_texts(pages: DataFrame, many: int = MANY_PAGES, most_sent: int = MOST_SENT) -> DataFrame:
    """page_id, url, text, n_chars (code points) and n_template (subtrees deleted as template) for every row of pages.

    Null and empty pages have an empty text. A page without a host in its URL has no site, so only its elements' names count. Pages of any
    length are read whole; broken markup never fails: what isn't closed ends with what surrounds it. Rows that repeat, or share an id, each get
    their text, and count once for the template. White space is Unicode's, no-break spaces included. Cells of a row are one block. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    rows = rows.withColumn("site", F.when(F.col("host").isNotNull(), F.xxhash64("host"))).withColumn("d", F.xxhash64("host", "html"))
    subtrees = written(_subtrees(rows), "subtrees")
    counts = subtrees.groupBy("site", "hash").agg(F.count_distinct("d").alias("n"), F.max("prose").alias("prose"))
    sites = rows.filter("site is not null").groupBy("site").agg(F.count_distinct("d").alias("pages"))
    template = counts.filter(F.col("n") >= many).join(sites, "site").filter((F.col("prose") == 0) | (F.col("n") >= PROSE_SHARE * F.col("pages")))
    template = written(template.select("site", "hash", "n"), "template")
    if template.count() <= most_sent:
        sent: dict[int, set[int]] = defaultdict(set)
        for r in template.select("site", "hash").toLocalIterator():  # at most most_sent
            sent[r.site].add(r.hash)
        return _extracted(rows.withColumn("hits", F.lit(None).cast("array<long>")), dict(sent))
    hits = joined_with_hot(subtrees.select("d", "site", "hash"), template, ["site", "hash"], "n", HOT, MOST_HOT)
    hits = hits.groupBy("d").agg(F.collect_set("hash").alias("hits"))
    return _extracted(rows.join(hits, "d", "left"), None)
