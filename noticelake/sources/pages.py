"""Landed web pages to listed rows and articles.

Tree walking needs Python, so it runs once per page in Arrow batches; everything that follows is native.
The expressions at the end (links, metadata pairs) are the native variants for simple markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import quote, unquote, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake import dims, schemas
from noticelake.functions import text as texts
from noticelake.functions.dates import dotted_date


@dataclass(frozen=True)
class Markup:
    """Where things are on a page, as (tag or None, class or None). Defaults: the boards' fixed markup."""

    list_box: tuple[str | None, str | None] = ("table", "artclTable")
    list_row: tuple[str | None, str | None] = ("tr", None)
    list_link: tuple[str | None, str | None] = ("a", "artclLinkView")
    list_date: tuple[str | None, str | None] = (None, "_artclTdRdate")
    pinned_class: str = "headline"
    title: tuple[str | None, str | None] = (None, "artclViewTitle")
    body: tuple[str | None, str | None] = (None, "artclView")
    head: tuple[str | None, str | None] = (None, "artclViewHead")
    download: str = "/download.do"
    date_label: str = "작성일"
    category_label: str = "분류"
    author_label: str = "작성자"


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LINE_ENDS = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}
CLOSE_P = LINE_ENDS | {"ul", "ol", "dl", "table", "section", "article", "nav", "header", "footer", "form", "pre", "blockquote", "hr"}
SAME_KIND = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "dt": {"dl"}, "dd": {"dl"}}


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings
    start: int = 0
    end: int = 0

    def find(self, want: tuple[str | None, str | None]) -> Iterator[Node]:
        """Nodes below this one in page order; a stack, since pages nest to any depth."""
        tag, cls = want
        left = [self]
        while left:
            node = left.pop()
            if node is not self and (tag is None or node.tag == tag) and (cls is None or cls in (node.attrs.get("class") or "").split()):
                yield node
            left.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, left = [], self.children[::-1]
        while left:
            c = left.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                left.extend(reversed(c.children))
        return "".join(out)

    def lines(self, out: list[str]) -> None:
        """Text with a line break after every block and for every br; no script or style."""
        left = self.children[::-1]
        while left:
            c = left.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag == "br":
                out.append("\n")
            elif c.tag not in ("script", "style"):
                if c.tag in LINE_ENDS:
                    left.append("\n")
                left.extend(reversed(c.children))


class _Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.offsets = [0]
        for line in html.split("\n"):
            self.offsets.append(self.offsets[-1] + len(line) + 1)
        self.root = Node("root", end=len(html))
        self.open = [self.root]
        self.feed(html)
        self.close()
        self._pop(1, len(html))

    def _at(self) -> int:
        line, col = self.getpos()
        return self.offsets[line - 1] + col

    def _pop(self, depth: int, at: int) -> None:
        for node in self.open[depth:]:
            node.end = at
        del self.open[depth:]

    def _close_implied(self, tag: str) -> None:
        names = [n.tag for n in self.open]
        if tag in CLOSE_P and "p" in names:
            self._pop(len(names) - 1 - names[::-1].index("p"), self._at())
        elif tag in SAME_KIND:
            for i in range(len(names) - 1, 0, -1):
                if names[i] in SAME_KIND[tag]:
                    return
                if names[i] == tag or {names[i], tag} == {"dt", "dd"} or {names[i], tag} == {"td", "th"}:
                    return self._pop(i, self._at())
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._close_implied(tag)
        node = Node(tag, dict(attrs), start=self._at() + len(self.get_starttag_text() or ""))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                return self._pop(i, self._at())
        return None

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


_INLINE = re.compile(r"\s+")


def _inline(s: str) -> str:
    return _INLINE.sub(" ", s).strip()


def _absolute(href: str, origin: str) -> str:
    return quote(urljoin(origin + "/", href.strip()), safe="%/:=&?~#+!$,;'@()*[]")


def list_rows(html: str, m: Markup) -> list[dict]:
    """Rows of one list page in page order: href, title, date text and whether the row is pinned."""
    out = []
    for box in _Tree(html).root.find(m.list_box):
        for row in box.find(m.list_row):
            link = next(row.find(m.list_link), None)
            if link is None or not link.attrs.get("href"):
                continue
            strong = list(link.find(("strong", None)))
            own = "".join(c for c in link.children if isinstance(c, str))
            title = "".join(s.text() for s in strong) if strong else own
            day = "".join(n.text() for n in row.find(m.list_date)) if m.list_date != (None, None) else ""
            pinned = m.pinned_class in (row.attrs.get("class") or "").split()
            out.append({"href": link.attrs["href"], "title": _inline(title), "day": day, "pinned": pinned})
    return out


def article(html: str, origin: str, m: Markup) -> dict:
    """Parts of one article page; a missing title or body stays empty / None for the quality gate."""
    root = _Tree(html).root
    title = next(root.find(m.title), None)
    body = next(root.find(m.body), None)
    meta: dict[str, str] = {}
    for head in root.find(m.head):
        for dl in head.find(("dl", None)):
            key = _inline("".join(n.text() for n in dl.find(("dt", None))))
            meta[key] = _inline("".join(n.text() for n in dl.find(("dd", None))))
    files = []
    for img in body.find(("img", None)) if body else []:
        if img.attrs.get("src"):
            url = _absolute(img.attrs["src"], origin)
            files.append({"kind": "image", "name": unquote(url.rsplit("/", 1)[-1]), "url": url})
    for a in root.find(("a", None)):
        if m.download in (a.attrs.get("href") or ""):
            files.append({"kind": "file", "name": _inline(a.text()), "url": _absolute(a.attrs["href"], origin)})
    lines: list[str] = []
    if body:
        body.lines(lines)
    tidy = (re.sub("[ \t]+", " ", line).strip() for line in "".join(lines).replace("\xa0", " ").split("\n"))
    return {
        "title": _inline(title.text()) if title else "",
        "raw_html": html[body.start : body.end] if body else None,
        "original_content": "\n".join(line for line in tidy if line),
        "published": meta.get(m.date_label),
        "board_category": meta.get(m.category_label) or None,
        "author": meta.get(m.author_label) or None,
        "attachments": files,
    }


LIST_ROWS = "array<struct<href:string,title:string,day:string,pinned:boolean>>"


def listed_from_pages(pages: DataFrame, markup: Markup | None = None) -> tuple[DataFrame, DataFrame]:
    """(listed rows, rejected pages). ``pages``: source, page, html, href_pattern, url_prefix, url_suffix.

    Rows whose link is not an article of the page's board are dropped; a page left with no row is an error.
    """
    m = markup or Markup()
    names = [c for c in pages.columns if c != "html"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[names].assign(rows=[list_rows(h or "", m) for h in part["html"]])

    fields = ", ".join(f"`{n}` {pages.schema[n].dataType.simpleString()}" for n in names)
    found = pages.mapInPandas(run, f"{fields}, rows {LIST_ROWS}")
    rows = found.select(*names, F.posexplode("rows").alias("row", "r"))
    article_id = F.expr("regexp_extract(r.href, href_pattern, 1)")
    rows = rows.withColumn("source_notice_id", article_id).filter("source_notice_id != ''")
    listed = rows.select(
        "source", "source_notice_id", F.concat("url_prefix", "source_notice_id", "url_suffix").alias("url"),
        F.col("r.title").alias("title"), dotted_date(F.col("r.day")).alias("listed_date"), F.col("r.pinned").alias("pinned"), "page", "row",
    )
    good = listed.select("source", "page").distinct()
    rejected = pages.select("source", "page").join(good, ["source", "page"], "left_anti")
    return listed, rejected.withColumn("error", F.lit("list page has no notice rows"))


ARTICLE = (
    "title string, raw_html string, original_content string, published string, board_category string, author string, "
    f"attachments {schemas.ATTACHMENTS}"
)


def articles_from_pages(pages: DataFrame, markup: Markup | None = None) -> DataFrame:
    """Articles with the other columns of ``pages`` (html, origin, ...); see ``quality_gate`` for the rest."""
    m = markup or Markup()
    names = [c for c in pages.columns if c != "html"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [article(h or "", o, m) for h, o in zip(part["html"], part["origin"], strict=True)]
            yield pd.concat([part[names].reset_index(drop=True), pd.DataFrame(found)], axis=1)

    fields = ", ".join(f"`{n}` {pages.schema[n].dataType.simpleString()}" for n in names)
    out = pages.mapInPandas(run, f"{fields}, {ARTICLE}")
    return out.withColumn("published_at", F.try_to_date(dotted_date(F.col("published")), "yyyy-MM-dd")).drop("published")


def quality_gate(articles: DataFrame) -> DataFrame:
    """Adds ``error_class`` and ``error``; good rows have neither, the batch always goes on.

    Needs title, raw_html (null when no body was found), original_content and n_attachments.
    """
    no_title, no_body = F.coalesce("title", F.lit("")) == "", F.col("raw_html").isNull()
    size = F.length("original_content")
    short = size < dims.MIN_CONTENT_CHARS
    error_class = F.when(no_title | no_body, "structure").when(short, "empty_content")
    where = F.when(
        F.col("n_attachments") > 0, F.format_string(" (content is probably in %d image/file attachment(s))", "n_attachments")
    ).otherwise("")
    structure = F.format_string("page structure not recognized (title=%s, body=%s)", (~no_title).cast("string"), (~no_body).cast("string"))
    message = F.when(no_title | no_body, structure).when(short, F.concat(F.format_string("body has only %d chars of text", size), where))
    return articles.withColumn("error_class", error_class).withColumn("error", message)


# --- URLs -----------------------------------------------------------------------------------------------

# Fixed pattern: article addresses, as (prefix of the board, article id).
ARTICLE_URL = r"^(https://[^/]+/bbs/[^/]+/[0-9]+/)([0-9]+)/artclView\.do$"


def canonical_url(url: Column) -> Column:
    """Trimmed, https, without query and fragment."""
    secure = F.regexp_replace(texts.strip(url), "^http:", "https:")
    return F.regexp_replace(secure, "(?s)[?#].*$", "")


def parse_article_url(rows: DataFrame, url: str, pattern: str = ARTICLE_URL) -> DataFrame:
    """Adds canonical_url, board_prefix and article_id; the latter two are null for other addresses."""
    out = rows.withColumn("canonical_url", canonical_url(F.col(url)))
    found = F.col("canonical_url").rlike(pattern)
    return out.withColumns({
        "board_prefix": F.when(found, F.regexp_extract("canonical_url", pattern, 1)),
        "article_id": F.when(found, F.regexp_extract("canonical_url", pattern, 2)),
    })


def route_urls(parsed: DataFrame, boards: DataFrame) -> DataFrame:
    """Adds ``source``: the first board (in registry order) the address belongs to, else the first board.

    A board owns one address prefix, so this is an equality join instead of one pattern test per board.
    """
    owners = boards.groupBy("url_prefix").agg(F.min_by("source", "ord").alias("owner"))
    first = boards.agg(F.min_by("source", "ord").alias("s")).first()["s"]
    out = parsed.join(owners, parsed["board_prefix"] == owners["url_prefix"], "left").drop("url_prefix")
    return out.withColumn("source", F.coalesce("owner", F.lit(first))).drop("owner")


# --- native expressions for simple markup -----------------------------------------------------------------

_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(value: Column) -> Column:
    """The five XML entities and the fixed blank."""
    for entity, char in _ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def _plain(markup: Column) -> Column:
    return texts.normalize_inline(unescape(F.regexp_replace(markup, "<[^>]*>", "")))


def resolve_url(href: Column, origin: Column) -> Column:
    """Reference against the site root; characters outside ASCII are percent-encoded."""
    joined = (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(origin, F.lit("/"), href))
    )
    chars = F.transform(F.split(joined, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.url_encode(c)).otherwise(c))
    return F.array_join(chars, "")


def metadata_map(html: Column) -> Column:
    """``<dl><dt>key</dt><dd>value</dd></dl>`` pairs; a later key overwrites an earlier one."""
    lists = F.regexp_extract_all(html, F.lit(r"(?is)<dl\b[^>]*>(.*?)</dl>"), 1)
    pairs = F.transform(lists, lambda dl: F.struct(
        _plain(F.array_join(F.regexp_extract_all(dl, F.lit(r"(?is)<dt\b[^>]*>(.*?)</dt>"), 1), "")).alias("k"),
        _plain(F.array_join(F.regexp_extract_all(dl, F.lit(r"(?is)<dd\b[^>]*>(.*?)</dd>"), 1), "")).alias("v"),
    ))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(keys, lambda k: F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(-1))["v"])
    return F.map_from_arrays(keys, values)


def attachments(page: Column, body: Column, origin: Column, download: str = "/download.do") -> Column:
    """Images of the body, then download links of the page, as (kind, name, url)."""
    sources = F.regexp_extract_all(body, F.lit(r"""(?is)<img\b[^>]*?\bsrc=["']([^"']*)["']"""), 1)
    anchor = r"""(?is)<a\b[^>]*?\bhref=["']([^"']*)["'][^>]*>(.*?)</a>"""
    links = F.arrays_zip(
        F.regexp_extract_all(page, F.lit(anchor), 1).alias("href"), F.regexp_extract_all(page, F.lit(anchor), 2).alias("label")
    )

    def image(src: Column) -> Column:
        last = F.try_element_at(F.split(unescape(src), "/"), F.lit(-1))
        name = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
        return F.struct(F.lit("image").alias("kind"), name.alias("name"), resolve_url(unescape(src), origin).alias("url"))

    def link(a: Column) -> Column:
        return F.struct(F.lit("file").alias("kind"), _plain(a["label"]).alias("name"), resolve_url(unescape(a["href"]), origin).alias("url"))

    wanted = F.filter(links, lambda a: F.contains(a["href"], F.lit(download)))
    return F.concat(F.transform(sources, image), F.transform(wanted, link))
