"""Main text of web pages, with removal of a site's templates.

A page is parsed into its element tree, in time linear in its length.  Every container element's subtree is hashed (tag,
class, text and children); Spark counts on how many pages of a host with different texts each hash stands, and a container
that recurs on many of them is deleted with all it holds; copies of one page count once.  Elements whose tag or role says
that they are no article text go as well, and containers whose class names say so.

Only containers (div, section, table, ul, ...) can be deleted as templates: paragraphs and headings of an article, and
the article itself, may well stand on many pages of a site (passages, reprints) and are no template for it.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestrata.llm.common import map_slices, texts, written

#: Elements without article text.
DROPPED = {"head", "script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "input", "iframe", "object", "svg", "canvas", "dialog", "menu"}
#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that begin and end a block.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Containers that may be a template.
CONTAINERS = {"div", "section", "aside", "nav", "header", "footer", "form", "ul", "ol", "dl", "table", "figure", "details", "fieldset", "center", "menu"}
#: An element of the key ends where one of the values begins.
CLOSED_BY = {
    "p": BLOCKS - {"html", "body", "caption", "legend", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
#: Elements beyond which an end tag or an implied end does not reach.
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}}
#: Words of class and id names, and roles, of elements without article text.
NO_ARTICLE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "pagination", "pager", "popup", "promo", "promoted", "replies", "share", "sharing", "sidebar", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "toolbar", "widget",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}

_START = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
_ATTRIBUTE = re.compile(r"""(?<![^\s=/"'<>])([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPECIAL = re.compile(r"[>\"']")


class Tags:
    """The tags of a page, one after another.  Where a tag is never closed its ``<`` is text; what was learnt on the way
    (where the next special character stands, from which ones no end is reached, which quotes have no partner) is kept,
    so that the whole page is read in linear time."""

    def __init__(self, page: str):
        self.page = page
        self.seen, self.special = 0, -1
        self.endless: set[int] = set()
        self.single: dict[str, int] = {}

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose name ends at ``at``; -1 if there is none."""
        tried, page = [], self.page
        while True:
            if not self.seen <= at <= self.special:
                m = _SPECIAL.search(page, at)
                self.seen, self.special = at, m.start() if m else len(page)
            here = self.special
            if here == len(page) or here in self.endless:
                break
            tried.append(here)
            mark = page[here]
            if mark == ">":
                return here
            if here >= self.single.get(mark, len(page)):
                break
            close = page.find(mark, here + 1)
            if close < 0:
                self.single[mark] = here
                break
            at = close + 1
        self.endless.update(tried)
        return -1

    def next(self, at: int) -> tuple[int, int, re.Match] | None:
        """Start, end and match of the next tag, comment or declaration."""
        while m := _START.search(self.page, at):
            if m[1] or m[2]:
                return m.start(), m.end(), m
            if (end := self.end(m.end())) >= 0:
                return m.start(), end + 1, m
            at = m.start() + 1
        return None


class Element:
    __slots__ = ("article", "box", "digest", "dropped", "tag")

    def __init__(self, tag: str, key: str, dropped: bool, article: bool, box: int):
        self.tag, self.dropped, self.article, self.box = tag, dropped, article, box
        self.digest = hashlib.blake2b(f"{tag}\0{key}\0".encode("utf-8", "surrogatepass"), digest_size=8) if tag in CONTAINERS else None


def no_article(tag: str, found: dict[str, str]) -> bool:
    if tag in DROPPED or found.get("role", "").lower() in ROLES or "hidden" in found:
        return True
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if tag not in CONTAINERS and tag != "article" or not names.strip():
        return False  # headings and paragraphs of an article may have such names as well
    parts = {x.lower() for x in (*_NAME_PARTS.findall(names), *re.sub("[-_]", "", names).split())}
    return bool(parts & (NO_ARTICLE if tag != "article" else {"comment", "comments"}))


def parse(page: str) -> tuple[list[tuple[str, int]], list[tuple[int, int, bool]]]:
    """The blocks of the main text, each with the number of the innermost container around it (-1 if none); and the
    containers with their hash, the number of the container around them, and whether they are part of the page's text.

    The main text is what stands in article elements; on pages without one, in main elements; else in the whole page."""
    stack: list[Element] = []
    open_at: dict[str, list[int]] = {}  # places in the stack of each tag's open elements
    block_at: list[int] = []  # and of those that make blocks
    around: list[int] = []  # and of containers
    blocks: list[tuple[str, int, int]] = []  # text, place (2 article, 1 main, 0 elsewhere), innermost container
    boxes: list[tuple[int, int, bool]] = []
    piece: list[str] = []
    dropped = articles = 0

    def end_block() -> None:
        if piece:
            words = " ".join("".join(piece).split())
            piece.clear()
            if words:
                inner = stack[around[-1]] if around else None
                if inner is not None:
                    inner.digest.update(words.encode("utf-8", "surrogatepass"))
                    inner.digest.update(b"\0")
                if not dropped:
                    blocks.append((words, 2 if articles else 1 if open_at.get("main") else 0, inner.box if inner is not None else -1))

    def push(e: Element) -> None:
        nonlocal dropped, articles
        open_at.setdefault(e.tag, []).append(len(stack))
        if e.tag in BLOCKS:
            block_at.append(len(stack))
        if e.digest is not None:
            boxes.append((0, stack[around[-1]].box if around else -1, False))
            around.append(len(stack))
        stack.append(e)
        dropped += e.dropped
        articles += e.article

    def pop() -> None:
        nonlocal dropped, articles
        e = stack.pop()
        open_at[e.tag].pop()
        if e.tag in BLOCKS:
            block_at.pop()
        dropped -= e.dropped
        articles -= e.article
        if e.digest is not None:
            around.pop()
            own = e.digest.digest()
            boxes[e.box] = (int.from_bytes(own, "big", signed=True), boxes[e.box][1], not dropped and not e.dropped)
            if around:
                stack[around[-1]].digest.update(b"\1" + own)

    at, size, tags = 0, len(page), Tags(page)
    while at < size:
        got = tags.next(at)
        text = page[at : got[0]] if got else page[at:]
        if not got and (cut := text.rfind("<")) >= 0 and re.match(r"<[/!?A-Za-z]", text[cut : cut + 2]):
            text = text[:cut]  # a tag that the page's end cuts off
        if text:
            piece.append(html.unescape(text) if "&" in text else text)
        if not got:
            break
        start, at, m = got
        if m[1]:
            end = page.find("-->", start + 2)
            at = size if end < 0 else end + 3
            continue
        if m[2]:
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        tag, attributes = m[4].lower(), page[m.end() : at - 1]
        if tag in BLOCKS:
            end_block()
        if m[3]:
            if places := open_at.get(tag):
                if tag not in BLOCKS and block_at and block_at[-1] > places[-1]:
                    continue  # an inline end tag does not end blocks
                while True:
                    last = stack[-1].tag
                    if last in BLOCKS:
                        end_block()
                    pop()
                    if last == tag:
                        break
            continue
        for i in reversed(block_at):
            open_tag = stack[i].tag
            if tag in CLOSED_BY.get(open_tag, ()):
                end_block()
                while len(stack) > i:
                    pop()
                break
            if open_tag != "p" and (open_tag in FENCES.get(tag, ()) or tag not in FENCES):
                break
        if tag == "br":
            piece.append(" ")
        if tag in VOID:
            continue
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        if attributes and re.search(r"(?:^|\s)hidden(?:\s|$)", attributes):
            found.setdefault("hidden", "")
        push(Element(tag, found.get("class", ""), no_article(tag, found), tag == "article", len(boxes)))
        if tag in RAW:
            end = re.compile(f"</{tag}(?![A-Za-z0-9])", re.IGNORECASE).search(page, at)
            at = size if end is None else end.start()
    end_block()
    while stack:
        pop()
    best = max([b[1] for b in blocks], default=0)
    return [(b[0], b[2]) for b in blocks if b[1] == best], boxes


def pruned(blocks: list[dict], boxes: list[dict], gone: set[int]) -> str:
    """The text without the blocks in a container of ``gone``; a container is numbered after those around it."""
    out: list[bool] = []
    for box in boxes:
        out.append(box["hash"] in gone or box["up"] >= 0 and out[box["up"]])
    return "\n\n".join(b["text"] for b in blocks if b["at"] < 0 or not out[b["at"]])


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 10) -> DataFrame:
    """id, url and ``text`` (blocks in page order joined by two line feeds; empty if none) of every page.

    Null html counts as empty; pages of a null or odd url form one site.  Repeated rows are rows of their own, and count
    as one page for the templates.  A container is a template where it stands on at least ``min_pages`` pages of its host
    that differ in their text, however many pages the host has; smaller hosts have none.  Pages are parsed once into a
    table in the shared folder.  Counts are aggregated map-side, so a hot host costs no more than others; only pages with
    blocks in containers are joined with the templates, by (host, hash).
    """

    def work(part):
        blocks, boxes, hashes, known = [], [], [], []
        for page in part.column("text").to_pylist():
            own, around = parse(page)
            blocks.append([{"text": t, "at": k} for t, k in own])
            boxes.append([{"hash": h, "up": up} for h, up, _ in around])
            hashes.append(sorted({h for h, _, shown in around if shown}))
            all_of = hashlib.blake2b("\0".join(t for t, _ in own).encode("utf-8", "surrogatepass"), digest_size=8)
            known.append(int.from_bytes(all_of.digest(), "big", signed=True))
        return {"id": part.column("id"), "url": part.column("url"), "blocks": blocks, "boxes": boxes, "hashes": hashes, "known": known}

    rows = texts(pages, id_col, html_col, F.col(url_col).cast("string").alias("url"))
    kind = rows.schema["id"].dataType.simpleString()
    parsed = map_slices(rows, work, f"id {kind}, url string, blocks array<struct<text:string,at:int>>, boxes array<struct<hash:long,up:int>>, hashes array<long>, known long")
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))
    parsed = written(parsed.withColumn("host", host).withColumn("row", F.monotonically_increasing_id()), "html")
    nested = F.exists("blocks", lambda b: b["at"] >= 0)
    plain = parsed.filter(~nested).select("id", "url", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n").alias("text"))
    each = parsed.select("host", F.explode("hashes").alias("hash"), "known").distinct()
    templates = each.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).select("host", "hash")
    odd = parsed.filter(nested)
    asked = odd.select("row", "host", F.explode("hashes").alias("hash"))
    per_page = asked.join(templates, ["host", "hash"]).groupBy("row").agg(F.collect_set("hash").alias("gone"))

    def without(batches):
        schema = pa.schema([pa.field("id", batch_kind), pa.field("url", pa.string()), pa.field("text", pa.string())])
        for batch in batches:
            texts_ = [pruned(b, x, set(g or ())) for b, x, g in zip(*[batch.column(k).to_pylist() for k in ("blocks", "boxes", "gone")], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts_, pa.string())], schema=schema)

    batch_kind = to_arrow_type(parsed.schema["id"].dataType)
    kept = odd.join(per_page, "row", "left").select("id", "url", "blocks", "boxes", "gone").mapInArrow(without, f"id {kind}, url string, text string")
    return plain.unionByName(kept).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES: dict[str, Callable] = {"op7_html_text": query}
ORACLE_SQL: dict[str, str] = {}
