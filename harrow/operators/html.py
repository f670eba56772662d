"""HTML extraction: one pass over each page, for whole Arrow batches.

The tree comes from the standard library's tokenizer and a small builder that
closes what HTML leaves open (li, p, tr, td, th, option, headings). Extractors
are independent: one that fails is named in ``parse_errors``, the others count.
Only the fields that are asked for are computed, as column pruning cannot reach
into Python. For pages of simple form there are pure column expressions below.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from harrow.functions import urls

from .selectors import compile_selector, select

# Tag names as HTML defines them.
HIDDEN = {"script", "style", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"} | HEADINGS
#: Start tag to (open tags it closes, tags that stop the search).
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
}
FIELDS = {
    "metadata": "struct<title:string,description:string,keywords:string>",
    "text": "string",
    "links": "array<string>",
    "images": "array<struct<src:string,alt:string>>",
    "headings": "map<string,array<string>>",
    "tables": "array<array<array<string>>>",
    "lists": "array<array<string>>",
}


class Node:
    __slots__ = ("name", "attrs", "kids", "up")

    def __init__(self, name: str, attrs: dict[str, str], up: Node | None):
        self.name, self.attrs, self.kids, self.up = name, attrs, [], up

    def walk(self) -> Iterator[Node]:
        """All elements below, in order of the document."""
        stack = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))

    def strings(self, skip: set[str] = frozenset()) -> Iterator[str]:
        """All text below, in order; nothing of elements named in ``skip``."""
        stack: list = list(reversed(self.kids))
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                yield k
            elif k.name not in skip:
                stack.extend(reversed(k.kids))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close(self, names: set[str], stops: set[str]) -> None:
        node = self.at
        found = None
        while node is not self.root and node.name not in stops:
            if node.name in names:
                found = node
            node = node.up
        if found is not None:
            self.at = found.up

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        elif tag in BLOCKS:
            self._close({"p"}, {"table", "li", "td", "th", "div"})
            if self.at.name in HEADINGS:
                self.at = self.at.up
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.up

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.name != tag:
            if node.name == "table" and tag not in ("body", "html", "div"):
                return
            node = node.up
        if node is not self.root:
            self.at = node.up

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def visible_text(node: Node) -> str:
    return "" if node.name in HIDDEN else " ".join(t for s in node.strings(HIDDEN) if (t := s.strip()))


def plain(node: Node) -> str:
    """Text pieces of a node, stripped, nothing between."""
    return "".join(s.strip() for s in node.strings(HIDDEN if node.name not in HIDDEN else frozenset()))


def metadata(root: Node, base: str) -> dict:
    out = {"title": "", "description": "", "keywords": ""}
    title = next((n for n in root.walk() if n.name == "title"), None)
    if title is not None and len(title.kids) == 1 and isinstance(title.kids[0], str):
        out["title"] = " ".join(title.kids[0].split())
    for want in ("description", "keywords"):
        tag = next((n for n in root.walk() if n.name == "meta" and n.attrs.get("name") == want), None)
        if tag is not None:
            out[want] = tag.attrs.get("content", "").strip()
    return out


def links(root: Node, base: str, same_domain: bool = False) -> list[str]:
    """Absolute page links without fragments, each once, in order. A href that cannot be parsed is left out."""
    own, out = urlsplit(base).netloc.lower(), {}
    for n in root.walk():
        href = n.attrs.get("href", "").strip() if n.name == "a" else ""
        if not href or href[0] == "#" or ":" in href and href.split(":", 1)[0].lower() in urls.SKIPPED_SCHEMES:
            continue
        url = urls.resolve(base, href)
        if url is None:
            continue
        parts = urlsplit(url)
        if parts.scheme in ("http", "https") and parts.netloc and (not same_domain or parts.netloc.lower() == own):
            out[url] = None
    return list(out)


def images(root: Node, base: str) -> list[dict]:
    return [{"src": urljoin(base, src), "alt": n.attrs.get("alt", "").strip()} for n in root.walk() if n.name == "img" and (src := n.attrs.get("src", "").strip())]


def headings(root: Node, base: str) -> dict[str, list[str]]:
    out = {"h1": [], "h2": [], "h3": []}
    for n in root.walk():
        if n.name in out:
            out[n.name].append(plain(n))
    return out


def tables(root: Node, base: str) -> list:
    """Cell texts by table and row; a table inside another counts in both."""
    out = []
    for t in root.walk():
        if t.name == "table":
            rows = [[plain(c) for c in r.walk() if c.name in ("th", "td")] for r in t.walk() if r.name == "tr"]
            if rows := [r for r in rows if r]:
                out.append(rows)
    return out


def lists(root: Node, base: str) -> list:
    out = []
    for n in root.walk():
        if n.name in ("ul", "ol"):
            items = [t for k in n.kids if isinstance(k, Node) and k.name == "li" and (t := plain(k))]
            if items:
                out.append(items)
    return out


EXTRACTORS: dict[str, Callable] = {"metadata": metadata, "text": lambda root, base: visible_text(root), "links": links, "images": images, "headings": headings, "tables": tables, "lists": lists}
EMPTY: dict[str, Callable] = {"metadata": lambda: {"title": "", "description": "", "keywords": ""}, "text": str, "links": list, "images": list, "headings": lambda: {"h1": [], "h2": [], "h3": []}, "tables": list, "lists": list}


def parse_page(url: str, html: str | None, fields=tuple(FIELDS), same_domain: bool = False) -> dict:
    """The asked fields of one page, and what went wrong in ``parse_errors``."""
    out, errors = {f: EMPTY[f]() for f in fields}, []
    root = tree(html or "")
    for f in fields:
        try:
            out[f] = links(root, url, same_domain) if f == "links" else EXTRACTORS[f](root, url)
        except Exception as e:  # an extractor must not cost the others their results
            errors.append(f"{f}: {type(e).__name__}: {e}")
    return out | {"parse_errors": errors}


def parse_html(pages: DataFrame, fields=tuple(FIELDS), url_col="url", html_col="html", same_domain: bool = False, parser: Callable = parse_page) -> DataFrame:
    """``pages`` without the HTML, with the asked fields of each page (title comes with metadata).

    All other columns pass through, so nothing has to be joined back. Columns
    that have a field's name give way to the field. parser: any function of
    (url, html, fields, same_domain) to a dict of the fields and ``parse_errors``.
    """
    new = {f: FIELDS[f] for f in fields} | {"parse_errors": "array<string>"} | ({"title": "string"} if "metadata" in fields else {})
    kept = [c for c in pages.columns if c not in new and c != html_col]
    rows = pages.select(*kept, F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    shape = T.StructType([*(pages.schema[c] for c in kept), *(T.StructField(k, T._parse_datatype_string(v)) for k, v in new.items())])
    own = to_arrow_schema(shape)

    def run(batches):
        for b in batches:
            got = [parser(u or "", h, fields, same_domain) for u, h in zip(b.column("_url").to_pylist(), b.column("_html").to_pylist(), strict=True)]
            for r in got if "metadata" in fields else ():
                r["title"] = r["metadata"]["title"]
            found = [pa.array([list(r[k].items()) if k == "headings" else r[k] for r in got], own.field(k).type) for k in new]
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(own.field(c).type) for c in kept), *found], schema=own)

    return rows.mapInArrow(run, shape)


def select_text(pages: DataFrame, selector: str, html_col="html") -> DataFrame:
    """``pages`` without the HTML, with ``text``: that of the elements a selector finds, one to a line; "" if none. See ``harrow.operators.selectors``."""
    compile_selector(selector)  # an error here, not in a task
    kept = [c for c in pages.columns if c not in (html_col, "text")]
    shape = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType())])
    own = to_arrow_schema(shape)

    def run(batches):
        for b in batches:
            said = ["\n".join(visible_text(n) for n in select(tree(h or ""), selector)).strip() for h in b.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(own.field(c).type) for c in kept), pa.array(said, pa.string())], schema=own)

    return pages.select(*kept, F.col(html_col).alias("_html")).mapInArrow(run, shape)


# ---- the same for pages of simple form, without Python


#: Character references that the expressions below know.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&bull;": "•", "&laquo;": "«", "&raquo;": "»", "&euro;": "€", "&reg;": "®", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}


def unescape(text: Column) -> Column:
    for k, v in ENTITIES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def known_references(html: Column) -> Column:
    """HTML for the parser in which an ampersand is text unless it begins a reference of ``ENTITIES``, as in ``unescape``.

    By itself the parser also reads what HTML allows besides: other names, numbers, and old names without a semicolon.
    """
    blank = F.replace(html, F.lit("&nbsp;"), F.lit(ENTITIES["&nbsp;"]))  # a usual blank there
    return F.regexp_replace(blank, "&(?!(?:" + "|".join(k[1:] for k in ENTITIES) + "))", "&amp;")


def quick_title(html: Column) -> Column:
    return urls.collapse_spaces(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def quick_heading(html: Column, level: str = "h1") -> Column:
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<{level}\b[^>]*>(.*?)</{level}>"), F.lit(1))
    return F.transform(inner, lambda x: urls.collapse_ends(unescape(F.regexp_replace(x, "<[^>]*>", ""))))


def quick_hrefs(html: Column) -> Column:
    """Trimmed href values of all anchors in double quotes, in order."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return F.transform(found, lambda x: urls.collapse_ends(unescape(x)))


def quick_links(base: Column, html: Column) -> Column:
    """Absolute links for hrefs that are absolute or root-relative, each once, in order."""
    joined = F.transform(F.filter(quick_hrefs(html), urls.is_followable), lambda h: urls.join_root_relative(base, h))
    return F.array_distinct(F.filter(joined, lambda u: u.isNotNull()))


#: An anchor whose href ``quick_hrefs`` doesn't see or ``quick_links`` can't resolve: not in double quotes, relative to the path or the scheme, or with an entity that is not in ``ENTITIES``.
_OTHER_HREF = (
    r"(?is)<a\s(?:[^>]*?\s)?href(?:\s+=|=[^\"])|<a\s[^>]*?[^\s>]href\s*="
    r"|<a\s[^>]*?href=\"\s*(?!(?:https?://|/(?!/)|#|\"|[a-z][a-z0-9+.-]*:))[^\"]"
    r"|<a\s[^>]*?href=\"[^\"]*?(?:\.\./|/\./|&(?!(?:" + "|".join(k[1:] for k in ENTITIES) + r"))#?[a-z0-9]+;)"
)


def with_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``links``: by expressions where every href has one of the usual forms, by the parser for other pages."""
    other = F.coalesce(F.col(html_col).rlike(_OTHER_HREF), F.lit(False))
    quick = pages.filter(~other).withColumn("links", F.coalesce(quick_links(F.col(url_col), F.col(html_col)), F.array().cast("array<string>")))
    return quick.unionByName(pages.filter(other).withColumn("links", _parsed_links(F.col(url_col), F.col(html_col))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parsed_links(url: pd.Series, html: pd.Series) -> pd.Series:
    return pd.Series([links(tree(h), u or "") for u, h in zip(url, html, strict=True)], dtype=object)


def quick_text(html: Column) -> Column:
    """Visible text: hidden elements, comments and tags away, pieces stripped and joined by one blank."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", "\u0001")
    pieces = F.split(F.regexp_replace(bare, r"<[^>]*>", "\u0001"), "\u0001")
    return F.array_join(F.filter(F.transform(pieces, lambda x: urls.collapse_ends(unescape(x))), lambda x: x != ""), " ")
