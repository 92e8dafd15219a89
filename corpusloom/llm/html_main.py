"""Main text of web pages by removal of site templates.

Each page's element subtrees are hashed. Spark counts, per host, on how many pages of different content a
subtree stands, and subtrees on many pages are templates: they are deleted with all they hold. Elements whose tag, role,
class or id says that they are no article (menus, forms, comments ...) are deleted as well; a class or id only says so if all
its words do (`site-footer`, not `no-sidebar` or `related-work`), and one that would cost the page all of its articles is not
believed. If a page has `article` or
`main` elements outside of deleted ones, only what is in any of them is text, unless nothing is left there: then the whole page
counts. A recurring paragraph, heading or list in an article, or in a main without articles, stays: only recurring containers
(div, section, table ...) can be templates there. Copies of one page, or of one article on several pages, count as one page, so
a copied article is no template.

Rows are counted in Spark with map-side combining; a page's own templates come back by a join on the host and the
hash of the page, never through the driver.

Edge cases: null or empty html gives an empty text. A url without a host belongs to the host "". Unclosed and
misnested tags are repaired as browsers do for paragraphs, list items, cells and inline elements. Pages are judged
one by one after the counts, so repeated rows and null ids pass through. Other columns of the input are kept; a new
column whose name is taken gets a leading underscore.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import fresh, map_batches, slices, staged

#: A subtree is a template on this many pages of its host, whatever share of the host they are; see `enough_pages`.
MIN_PAGES = 4

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attributes2>[^>]*+)>"
    r"|<[!?][^>]*+>?",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)", re.I)

RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noframes", "noembed"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
DROPPED = {
    "head", "nav", "footer", "aside", "form", "noscript", "template", "button", "select", "svg", "canvas", "dialog", "menu",
    "object", "audio", "video",
} | RAW
CONTAINERS = {"div", "section", "table", "aside", "nav", "ul", "ol", "form", "details", "fieldset", "center"}
BLOCKS = CONTAINERS | {
    "p", "article", "main", "body", "html", "head", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dl", "dt",
    "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "figure", "figcaption", "address",
    "hr", "summary", "dialog", "menu", "option", "select", "noscript", "template", "hgroup", "legend",
}
#: An opening tag closes an open element of these kinds, if none of the fence stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
HINTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe",
    "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "footer",
    "comment", "comments", "disqus", "reply", "replies", "share", "sharing", "social", "related", "widget",
}
#: Words that say nothing of their own beside one of the hints.
QUALIFIERS = {
    "site", "page", "global", "top", "bottom", "left", "right", "primary", "secondary", "main", "mobile", "reader", "user", "list",
    "item", "items", "link", "links", "bar", "box", "block", "area", "slot", "unit", "container", "wrapper", "wrap", "inner", "outer",
    "section", "signup", "form", "buttons", "icons", "posts", "articles", "stories",
}
TOKEN_PART = re.compile(r"[-_:]+")
WORD = re.compile(r"[a-z]+")
NEVER = {"html", "body", "main"}


def _tells(token: str, in_article: bool) -> bool:
    """Whether a class or id names something that is no article: all its words are hints or go with them."""
    parts = [p for p in TOKEN_PART.split(token) if p and not p[0].isdigit()]
    hints = [p in HINTS or (p == "header" and not in_article) for p in parts]
    return any(hints) and all(hint or p in QUALIFIERS for p, hint in zip(parts, hints))


def _is_boilerplate(tag: str, attributes: str, in_article: bool, hints: bool = True) -> bool:
    if tag in DROPPED:
        return True
    if tag in NEVER:
        return False
    if attributes:
        if HIDDEN.search(attributes):
            return True
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            if name.lower() == "role":
                if not ROLES.isdisjoint(WORD.findall(value)):
                    return True
            elif hints and any(_tells(token, in_article) for token in value.split()):
                return True
    return tag == "header" and not in_article


class Page:
    """Text fragments of a page (None: a block ends) and the ranges of fragments that elements cover."""

    def __init__(self, source: str, hints: bool = True):
        self._hints = hints
        self.fragments: list[str | None] = []
        #: first fragment, past the last, hash, content it belongs to (None: the page's)
        self.candidates: list[tuple[int, int, int, int | None]] = []
        self.dropped: list[tuple[int, int]] = []
        self.articles: list[tuple[int, int, int]] = []
        self.mains: list[tuple[int, int, int]] = []
        # open elements: tag, first fragment, hash so far, boilerplate, articles and mains ended before, whether in one of
        # them, candidates before, those of them that count only if the main has an article
        self._open: list[list] = []
        self._inside = self._articles = self._hidden = 0
        self._outside_articles: list[int] = []
        self._root = blake2b(digest_size=8)
        at = 0
        while True:
            token = TOKEN.search(source, at)
            if token is None:
                break
            if token.start() > at:
                self._text(source[at:token.start()])
            at = token.end()
            tag = token["tag"] or token["tag2"]
            if tag is None:
                continue
            tag = tag.lower()
            if token["close"] or token["close2"]:
                self._end(tag)
                continue
            attributes = token["attributes"] if token["tag"] else token["attributes2"]
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            self._start(tag, attributes)
        if at < len(source):
            self._text(source[at:])
        while self._open:
            self._pop()
        self.content = int.from_bytes(self._content(), "little", signed=True)

    def _content(self) -> bytes:
        """Hash of the outermost articles and mains, or of the whole page without one."""
        regions = sorted(self.articles + self.mains, key=lambda r: (r[0], -r[1]))
        if not regions:
            return self._root.digest()
        out, end = blake2b(digest_size=8), -1
        for first, past, number in regions:
            if past > end:
                out.update(number.to_bytes(8, "little", signed=True))
                end = past
        return out.digest()

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.fragments.append(text)
        (self._open[-1][2] if self._open else self._root).update(" ".join(text.split()).encode())

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._close_within({"p"}, {"td", "th", "table", "button", "object", "caption", "article", "main", "body"})
            if tag in CLOSES:
                self._close_within(*CLOSES[tag])
            self.fragments.append(None)
        if tag in VOID:
            if tag == "br":
                self.fragments.append(" ")
            return
        inside = self._inside > 0
        state = blake2b(tag.encode(), digest_size=8)
        boilerplate = _is_boilerplate(tag, attributes, inside, self._hints)
        self._open.append([
            tag, len(self.fragments), state, boilerplate, len(self.articles), len(self.mains), inside, len(self.candidates),
            len(self._outside_articles),
        ])
        if boilerplate:
            self._hidden += 1
        elif tag in ("article", "main"):
            self._inside += 1
            self._articles += tag == "article"

    def _close_within(self, tags: set[str], fence: set[str]) -> None:
        for depth in range(len(self._open) - 1, -1, -1):
            tag = self._open[depth][0]
            if tag in tags:
                while len(self._open) > depth:
                    self._pop()
                return
            if tag in fence:
                return

    def _end(self, tag: str) -> None:
        inline = tag not in BLOCKS
        for depth in range(len(self._open) - 1, -1, -1):
            found = self._open[depth][0]
            if found == tag:
                while len(self._open) > depth:
                    self._pop()
                return
            if inline and found in BLOCKS:
                return

    def _pop(self) -> None:
        tag, first, state, boilerplate, articles, mains, inside, begun, outside = self._open.pop()
        past = len(self.fragments)
        if tag in BLOCKS:
            self.fragments.append(None)
        digest = state.digest()
        (self._open[-1][2] if self._open else self._root).update(digest)
        number = int.from_bytes(digest, "little", signed=True)
        if boilerplate:
            self._hidden -= 1
            self.dropped.append((first, past))
        elif tag in ("article", "main"):
            self._inside -= 1
            self._articles -= tag == "article"
            if tag == "article" and not self._articles and not self._hidden:
                self.candidates[begun:] = [(*c[:3], number) for c in self.candidates[begun:]]
            if tag == "main" and len(self.articles) == articles and not self._articles:
                for at in reversed(self._outside_articles[outside:]):
                    del self.candidates[at]
                del self._outside_articles[outside:]
            if not self._hidden:
                (self.articles if tag == "article" else self.mains).append((first, past, number))
            return
        holds_article = len(self.articles) + len(self.mains) > articles + mains
        if past > first and not holds_article and tag not in NEVER:
            if inside and tag not in CONTAINERS:
                if self._articles:
                    return
                self._outside_articles.append(len(self.candidates))
            self.candidates.append((first, past, number, None))

    def _kept(self, regions: list[tuple[int, int]], gone: list[tuple[int, int]]) -> str:
        keep = bytearray(len(self.fragments))
        for a, b in regions:
            keep[a:b] = b"\x01" * (b - a)
        for a, b in gone:
            keep[a:b] = bytes(b - a)
        blocks, part = [], []
        for kept, fragment in zip(keep, self.fragments):
            if fragment is None:
                if part:
                    blocks.append(" ".join("".join(part).split()))
                    part = []
            elif kept:
                part.append(fragment)
        if part:
            blocks.append(" ".join("".join(part).split()))
        return "\n".join(block for block in blocks if block)

    def text(self, templates: set[int]) -> str:
        regions = [(a, b) for a, b, _ in self.articles + self.mains]
        gone = self.dropped + [(a, b) for a, b, number, _ in self.candidates if number in templates]
        return (regions and self._kept(regions, gone)) or self._kept([(0, len(self.fragments))], gone)


def main_text(source: str, templates: set[int]) -> str:
    """Text of a page; if that is empty, of the articles and mains that elements with a telling class or id hold."""
    text = Page(source).text(templates)
    if not text and source:
        plain = Page(source, hints=False)
        if plain.articles or plain.mains:
            return plain.text(templates)
    return text


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.lower(found), F.lit(""))


def subtrees(pages: DataFrame) -> DataFrame:
    """host, page (hash of the html), content and subtree, once each per page; subtree is null in one row per page.

    The content of a subtree in articles is the article of least hash, of others the page's: pages of one content agree in it."""
    schema = "host string, page long, content long, subtree long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out: list[tuple] = []
            for host, page, source in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
                found = Page(source or "")
                out.append((host, page, found.content, None))
                held: dict[int, int | None] = {}
                for *_, number, own in found.candidates:
                    known = held.get(number)
                    held[number] = own if known is None else known if own is None else min(own, known)
                out.extend((host, page, found.content if own is None else own, number) for number, own in held.items())
            columns = list(zip(*out))
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["host", "page", "content", "subtree"]
            )

    return map_batches(pages.select("host", "page", "html"), run, schema)


def enough_pages(total: Column, min_pages: int) -> Column:
    """Pages that make a template on a host of `total` pages: one more for each doubling beyond `min_pages` * 2 ** `min_pages`."""
    return F.greatest(F.lit(float(min_pages)), F.log2(total / min_pages))


def templates(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and subtree of those on many pages of different content."""
    counts = found.select("host", "subtree", "content").distinct().groupBy("host", "subtree").agg(
        F.count("*").alias("pages"))
    total = counts.where("subtree IS NULL").select("host", F.col("pages").alias("total"))
    return counts.where("subtree IS NOT NULL").join(total, "host").where(
        F.col("pages") >= enough_pages(F.col("total"), min_pages)).select(
        "host", "subtree", "pages")


def _squeezed(pages: DataFrame, source: str) -> DataFrame:
    """The pages with their html compressed one by one, for the shuffle to their templates."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == source else f.dataType) for f in pages.schema.fields])
    names = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in slices(batches, source):
            raw = [None if v is None else v.encode() for v in batch.column(source).to_pylist()]
            small = [None if v is None else len(v).to_bytes(8, "little") + codec.compress(v, asbytes=True) for v in raw]
            yield pa.RecordBatch.from_arrays(
                [pa.array(small, pa.binary()) if c == source else batch.column(c) for c in names], names)

    return map_batches(pages, run, schema)


def _widened(html: bytes | None) -> str | None:
    if html is None:
        return None
    return pa.Codec("zstd").decompress(html[8:], int.from_bytes(html[:8], "little"), asbytes=True).decode()


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, url: str = "url", source: str = "html",
            to: str = "text") -> DataFrame:
    """All columns of `pages` and the main text."""
    host, page, own, name = (fresh(pages, c) for c in ("host", "page", "templates", to))
    keyed = pages.withColumns({host: host_of(F.col(url)), page: F.xxhash64(source)})
    found = staged(
        subtrees(keyed.select(F.col(host).alias("host"), F.col(page).alias("page"), F.col(source).alias("html"))), "subtrees"
    )
    of_page = (
        found.where("subtree IS NOT NULL").join(templates(found, min_pages), ["host", "subtree"])
        .groupBy(F.col("host").alias(host), F.col("page").alias(page)).agg(F.collect_set("subtree").alias(own))
    )
    joined = _squeezed(keyed, source).join(of_page, [host, page], "left").select(*pages.columns, own)
    schema = T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])
    kept = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, source):
            known, pages_html = batch.column(own).to_pylist(), [_widened(v) for v in batch.column(source).to_pylist()]
            out = [main_text(html or "", set(t or ())) for html, t in zip(pages_html, known)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(pages_html, pa.string()) if c == source else batch.column(c) for c in kept), pa.array(out, pa.string())],
                [*kept, name],
            )

    return map_batches(joined, run, schema)
