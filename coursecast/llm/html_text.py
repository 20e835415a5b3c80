"""Main text of web pages: site templates and page furniture removed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursecast.llm.url_filter import host_of
from coursecast.sources.scratch import settle

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*\Z|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in RAW}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
FURNITURE = frozenset(
    "head script style noscript template iframe object svg canvas nav footer aside form button select "
    "textarea dialog menu title audio video map".split()
)
#: Words of class, id or role names that mark menus, notices, adverts, comments and the like.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice popup modal overlay newsletter subscribe subscription signup login sidebar aside widget "
    "related recommended recommendations teaser share sharing social breadcrumb breadcrumbs menu nav navbar "
    "navigation pagination pager footer header masthead comment comments disqus reply replies respond search "
    "skip toolbar tooltip complementary contentinfo alert".split()
)
#: A start tag of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: Which open elements a start tag ends, and the elements behind which it does not look.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    tag: str
    parent: int
    name: str  # tag with its class, as far as it tells elements apart
    dropped: bool
    marked: bool = False  # dropped by nothing but its class, id or role
    linked: bool = False  # has a link, button or field below
    text: int = 0  # characters below
    digest: int = 0
    feed: list[str] = field(default_factory=list)


def _furniture(tag: str, attributes: dict[str, str]) -> bool:
    """Whether the tag or its state says so; ``_marked`` goes by name."""
    if tag in FURNITURE:
        return True
    if tag in ("html", "body", "article", "main") and not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")))


def _marked(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("html", "body", "main"):
        return False
    named = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
    return any(w.lower() in MARKS for w in _WORDS.findall(named)) if named.strip() else False


class Page:
    """A forgiving element tree of one page, with its text in order."""

    def __init__(self, html: str) -> None:
        self.elements = [Element("", -1, "", False)]
        self.pieces: list[tuple[int, str | None]] = []  # element and text; None is a block's edge
        self._open = [0]
        at = 0
        while m := TOKEN.match(html, at):
            at = m.end()
            end, tag, rest, text = m.groups()
            if text is not None:
                self._text(text)
            elif tag:
                tag = tag.lower()
                if end:
                    self._end(tag)
                    continue
                self._start(tag, rest)
                if tag in RAW and not rest.endswith("/"):  # nothing but its end tag counts inside
                    found = RAW_END[tag].search(html, at)
                    if tag == "textarea":
                        self._text(html[at : found.start() if found else len(html)])
                    at = found.end() if found else len(html)
                    if found:
                        self._close(tag)
        while len(self._open) > 1:
            self._pop()
        self._spare()
        self._finish(0)

    def _text(self, text: str) -> None:
        at = self._open[-1]
        text = unescape(text) if "&" in text else text
        self.pieces.append((at, text))
        self.elements[at].feed.append(" ".join(text.split()))
        self.elements[at].text += len(text)

    def _finish(self, k: int) -> None:
        e = self.elements[k]
        e.digest = xxhash.xxh64_intdigest("\x00".join([e.name, *(f for f in e.feed if f)])) >> 1
        e.feed = []
        if k:
            up = self.elements[e.parent]
            up.feed.append(f"\x01{e.digest:x}")
            up.text += e.text
            up.linked |= e.linked or e.tag in ("a", "button", "input", "select", "textarea")

    def _pop(self) -> None:
        k = self._open.pop()
        if self.elements[k].tag not in INLINE:
            self.pieces.append((k, None))
        self._finish(k)

    def _close(self, tag: str) -> None:
        """Closes the innermost open ``tag`` and all within it, if there is one."""
        for depth in range(len(self._open) - 1, 0, -1):
            if self.elements[self._open[depth]].tag == tag:
                while len(self._open) > depth:
                    self._pop()
                return

    def _end(self, tag: str) -> None:
        if tag in ("br", "p") and all(self.elements[k].tag != tag for k in self._open):
            self.pieces.append((self._open[-1], " " if tag == "br" else None))
        elif tag in INLINE:  # does not reach out of its block
            for k in reversed(self._open[1:]):
                if self.elements[k].tag == tag:
                    self._close(tag)
                    return
                if self.elements[k].tag not in INLINE:
                    return
        else:
            self._close(tag)

    def _start(self, tag: str, rest: str) -> None:
        if tag in ENDS_PARAGRAPH:
            for k in reversed(self._open[1:]):
                if self.elements[k].tag == "p":
                    self._close("p")
                    break
                if self.elements[k].tag not in INLINE:
                    break
        if tag in SIBLINGS:
            ends, behind = SIBLINGS[tag]
            for k in reversed(self._open[1:]):
                if self.elements[k].tag in behind:
                    break
                if self.elements[k].tag in ends:
                    self._close(self.elements[k].tag)
        at = self._open[-1]
        if tag == "br":
            self.pieces.append((at, " "))
            return
        attributes = {}
        if rest.strip(" /"):
            attributes = {a.lower(): unescape(v.strip("\"'")) for a, v in ATTRIBUTE.findall(rest)}
        up = self.elements[at]
        in_article = any(self.elements[k].tag == "article" for k in self._open)
        dropped = up.dropped or _furniture(tag, attributes) or (tag == "header" and not in_article)
        e = Element(tag, at, f"{tag}.{attributes.get('class', '')}", dropped, _marked(tag, attributes))
        self.elements.append(e)
        k = len(self.elements) - 1
        if tag not in INLINE:
            self.pieces.append((k, None))
        if tag in VOID or rest.endswith("/") and tag not in RAW:
            self._finish(k)
        else:
            self._open.append(k)

    def _spare(self) -> None:
        """Drops what is furniture by name, but no element that holds the main article or most of the page's text."""
        shown = [0] * len(self.elements)
        for k, text in self.pieces:
            if text and not self.elements[k].dropped:
                shown[k] += len("".join(text.split()))
        holds = [e.tag == "main" and not e.dropped for e in self.elements]
        articles = [k for k, e in enumerate(self.elements) if e.tag == "article" and not e.dropped]
        if articles:
            longest = lambda those: max(those, key=lambda k: self.elements[k].text)
            best, by_name = longest(articles), self.within({k for k, e in enumerate(self.elements) if e.marked})
            plain = [k for k in articles if not by_name[k] and 2 * self.elements[k].text >= self.elements[best].text]
            holds[longest(plain) if plain else best] = True  # a long comment may be an article, too
        for k in range(len(self.elements) - 1, 0, -1):
            shown[self.elements[k].parent] += shown[k]
            holds[self.elements[k].parent] |= holds[k]
        for k, e in enumerate(self.elements[1:], 1):
            by_name = e.marked and not holds[k] and 2 * shown[k] <= shown[0]
            e.dropped |= self.elements[e.parent].dropped or by_name

    def within(self, roots: set[int]) -> list[bool]:
        """Per element, whether it is one of ``roots`` or below one."""
        out = [False] * len(self.elements)
        for k, e in enumerate(self.elements):
            out[k] = k in roots or (e.parent >= 0 and out[e.parent])
        return out

    def main(self) -> int:
        """The element that holds the main text: the longest article, or main if that is far longer; else the page."""
        best = {"article": 0, "main": 0}
        for k, e in enumerate(self.elements):
            if e.tag in best and not e.dropped and e.text > self.elements[best[e.tag]].text * (best[e.tag] > 0):
                best[e.tag] = k
        article, main = best["article"], best["main"]
        if article and main and 4 * self.elements[article].text < self.elements[main].text:
            return main
        return article or main

    def subtrees(self) -> list[int]:
        """Elements that may be parts of a site's template: blocks with text, no part of the page's skeleton."""
        main = self.main()
        skeleton, k = {0}, main
        while k > 0:
            skeleton.add(k)
            k = self.elements[k].parent
        inside = self.within({main}) if main else [False] * len(self.elements)
        return [
            k for k, e in enumerate(self.elements)
            if k not in skeleton and e.text and e.tag not in INLINE and e.tag not in ("html", "body", "head", "title")
            and (e.linked or not inside[k])
        ]

    def content(self) -> int:
        """A digest of what is the page's own, for counting pages with the same text once."""
        main = self.main()
        if main:
            return self.elements[main].digest
        leaves = [e for e in self.elements[1:] if not e.dropped and e.tag in ("p", "div", "td", "section", "pre")]
        return max(leaves, key=lambda e: (e.text, e.digest)).digest if leaves else self.elements[0].digest

    def text(self, template: set[int]) -> str:
        """The main element's blocks without furniture and without subtrees of the site's template."""
        cut = {k for k in self.subtrees() if self.elements[k].digest in template}
        cut |= {k for k, e in enumerate(self.elements) if e.dropped}
        gone, kept = self.within(cut), self.within({self.main()})
        blocks, now = [], []
        for k, text in self.pieces:
            if text is None:
                blocks.append("".join(now))
                now = []
            elif kept[k] and not gone[k]:
                now.append(text)
        blocks.append("".join(now))
        return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def template_subtrees(pages: DataFrame, *, min_pages: int = 5, min_share: float = 0.1) -> DataFrame:
    """``host`` and ``template``, the digests of its recurring element subtrees.

    A subtree counts once for each different main text it stands beside, so that copies of an article are no
    template. It belongs to the template if it stands beside ``min_pages`` of them and ``min_share`` of all
    of the host. A host thus has at most the mean number of subtrees per page, over ``min_share``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, content, digest = [], [], []
            for h, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(html.as_py() or "")
                found = {page.elements[k].digest for k in page.subtrees()} | {-1}  # -1 counts the page itself
                host += [h] * len(found)
                content += [page.content()] * len(found)
                digest += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(content, pa.int64()), pa.array(digest, pa.int64())],
                ["host", "content", "digest"],
            )

    seen = pages.select("host", "html").mapInArrow(run, "host string, content long, digest long").distinct()
    counts = seen.groupBy("host", "digest").agg(F.count("*").alias("n"))
    # The page's own row (-1) gives the total; one aggregation per host, no join.
    per = counts.groupBy("host").agg(
        F.max(F.when(F.col("digest") == -1, F.col("n"))).alias("total"),
        F.collect_list(F.when((F.col("digest") != -1) & (F.col("n") >= min_pages), F.struct("digest", "n"))).alias("found"),
    )
    chosen = F.filter("found", lambda x: x["n"] >= min_share * F.col("total"))
    return per.select("host", F.transform(chosen, lambda x: x["digest"]).alias("template")).filter(F.size("template") > 0)


def main_text(pages: DataFrame, **counting) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row.

    Subtrees that recur over the host's pages go, as do menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles and reader comments by tag and by class, id or role. What is left of the article (of the
    page, if it has none) is its text: one line per block. Null and empty html give an empty text; pages
    without host are one site; repeated rows count once for the template and are returned each. Templates are
    written and joined by host; Spark broadcasts them when small, and else splits a hot host's pages.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).withColumn("host", host_of(F.col("url")))
    template = settle(template_subtrees(rows, **counting), "templates").withColumnRenamed("host", "_host")
    rows = rows.join(template, rows.host == F.col("_host"), "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                Page(html.as_py() or "").text(set(digests.as_py() or ()))
                for html, digests in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
