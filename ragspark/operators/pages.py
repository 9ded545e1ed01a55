"""Pages (TXT-02..06, EXT-05..10, EXT-15..18, SRC-28, SRC-30): cleaning, web parts, page text, links and the documents of a page."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text, urls

BLANKS = " \t\n\x0b\x0c\r"
#: Characters of page text that a document or a flat extraction keeps.
TEXT_CAP = 5000
FLAT_CAPS = (15_000, 10_000, 5_000)
#: A property of a web part counts as text if it is longer.
MIN_PROPERTY = 10
MIN_CONTENT = 100
#: Where the main content lies, first match first: (tag, attribute, value, whether a part of the value is enough).
MAIN_CONTENT = [
    ("div", "class", "CanvasZone", True),
    ("div", "data-automation-id", "contentScrollRegion", False),
    ("div", "class", "mainContent", True),
    ("div", "role", "main", False),
    ("article", None, None, False),
]
#: Elements and parts of class names that hold no content, those dropped from a whole body only, and lines of the interface.
DROPPED_TAGS = {"script", "style", "nav", "header", "footer", "button"}
DROPPED_CLASSES = ["CommandBar", "Ribbon", "SuiteNav"]
BODY_CLASSES = ["ribbon", "navigation", "commandBar", "nav-"]
INTERFACE_LINES = [
    "Skip Ribbon Commands", "Skip to main content", "Turn on more accessible mode", "Turn off more accessible mode",
    "enable scripts and reload", "secured browser on the server", "To navigate through the Ribbon", "Sign in",
]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def clean_html(page: str | None) -> str:
    """Entities first, then markup; a phrase (text between double spaces) a line."""
    lines = text.html_text(html.unescape(page or ""), "\n").splitlines()
    phrases = (p.strip() for line in lines for p in line.strip().split("  "))
    return "\n".join(p for p in phrases if p)


@F.pandas_udf(T.StringType())
def to_clean_text(page: pd.Series) -> pd.Series:
    return page.map(clean_html)


class _Regions(HTMLParser):
    """Text of the first element of each kind in MAIN_CONTENT, and of the body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, set[int]]] = []  # tag, dropped everywhere, dropped from a body, regions begun
        self.open: set[int] = set()
        self.found: dict[int, list[str]] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        values = {k: v or "" for k, v in attrs}
        kind = values.get("class", "")
        begun = set()
        for i, (want, key, value, part) in enumerate([*MAIN_CONTENT, ("body", None, None, False)]):
            held = values.get(key, "") if key else ""
            if tag == want and i not in self.found and (key is None or (value in held if part else value == held)):
                self.found[i] = []
                begun.add(i)
        gone = tag in DROPPED_TAGS or any(c in kind for c in DROPPED_CLASSES)
        self.stack.append((tag, gone, any(c in kind for c in BODY_CLASSES), begun))
        self.open |= begun

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, *_ in self.stack):
            while self.stack:
                t, _, _, begun = self.stack.pop()
                self.open -= begun
                if t == tag:
                    return

    def handle_data(self, data: str) -> None:
        data = data.strip()
        if data and not any(gone for _, gone, _, _ in self.stack):
            for i in self.open:
                if i < len(MAIN_CONTENT) or not any(chrome for _, _, chrome, _ in self.stack):
                    self.found[i].append(data)


def main_content(page: str | None) -> str:
    """Text of the best content region, without lines of the interface; empty if under MIN_CONTENT characters."""
    parser = _Regions()
    parser.feed(page or "")
    if not parser.found:
        return ""
    lines = [x.strip() for part in parser.found[min(parser.found)] for x in part.splitlines()]
    out = "\n".join(x for x in lines if x and not any(p in x for p in INTERFACE_LINES))
    return out if len(out) >= MIN_CONTENT else ""


@F.pandas_udf(T.StringType())
def to_main_content(page: pd.Series) -> pd.Series:
    return page.map(main_content)


def strip_markdown(md: Column) -> Column:
    """Plain text of Markdown: no fences, headings, quotes, list marks, emphasis, code marks, link targets or tags."""
    for pattern, into in (
        (r"(?m)^```.*$", ""), (r"(?m)^ {0,3}#{1,6} +", ""), (r"(?m)^ {0,3}> ?", ""), (r"(?m)^ {0,3}([-*+]|\d+\.) +", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*\n]+)\*", "$1"), (r"`([^`]*)`", "$1"), (r"<[^<>]+>", ""),
    ):
        md = F.regexp_replace(md, pattern, into)
    return F.btrim(md, F.lit(BLANKS))


def keep_markdown(md: Column) -> Column:
    """Markdown without its HTML tags."""
    return F.regexp_replace(md, r"<[^<>]+>", "")


def table_markdown(page: str | None) -> list[str]:
    """Every table of a page as Markdown under a heading; short rows are padded to the header, empty rows dropped."""
    return [f"**Table:**\n\n{text.markdown_table(t['headers'], t['rows'])}" for t in text.html_tables(page)]


_PART = "struct<innerHtml:string,webPartData:struct<properties:map<string,variant>>>"
_PAGE = f"title string, description string, canvasLayout struct<horizontalSections:array<struct<columns:array<struct<webparts:array<{_PART}>>>>>,verticalSection:struct<webparts:array<{_PART}>>>, webParts array<{_PART}>"
_TEXTS = T.ArrayType(T.StringType())


@F.pandas_udf(_TEXTS)
def _part_texts(inner: pd.Series, properties: pd.Series) -> pd.Series:
    def one(bodies: list | None, props: list | None) -> list[str]:
        out = []
        for body, values in zip(bodies if bodies is not None else [], props if props is not None else [], strict=True):
            pieces = [clean_html(body), *table_markdown(body)] if body else []
            pieces += [clean_html(v) for v in (values if values is not None else [])]
            out.append("\n\n".join(p for p in pieces if p))
        return [x for x in out if x]

    return pd.Series([one(a, b) for a, b in zip(inner, properties, strict=True)])


def webpart_texts(parts: Column) -> Column:
    """Texts of an array of web parts that hold any: cleaned body, its tables, string properties of over MIN_PROPERTY characters."""
    def strings(p: Column) -> Column:
        entries = F.coalesce(F.map_entries(p["webPartData"]["properties"]), F.array().cast("array<struct<key:string,value:variant>>"))
        texts = F.transform(F.filter(entries, lambda e: F.schema_of_variant(e["value"]) == "STRING"), lambda e: F.try_variant_get(e["value"], "$", "string"))
        return F.filter(texts, lambda v: F.length(v) > MIN_PROPERTY)

    parts = F.coalesce(parts, F.array().cast(f"array<{_PART}>"))
    return _part_texts(F.transform(parts, lambda p: p["innerHtml"]), F.transform(parts, strings))


def page_text(pages: DataFrame, payload: str, *keep: str) -> DataFrame:
    """``keep`` columns and body: heading, description and web parts of a page's JSON; its older part list where those give one piece at most."""
    none = F.array().cast(f"array<{_PART}>")
    page = F.from_json(payload, _PAGE)
    across = F.flatten(F.transform(F.col("p.canvasLayout.horizontalSections"), lambda s: F.flatten(F.transform(s["columns"], lambda c: F.coalesce(c["webparts"], none)))))
    down = F.coalesce(F.col("p.canvasLayout.verticalSection.webparts"), none)
    rows = pages.select(*keep, page.alias("p")).withColumn("canvas", webpart_texts(F.concat(F.coalesce(across, none), down))).withColumn("older", webpart_texts(F.col("p.webParts")))
    filled = lambda c, lead="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(lead), c, F.lit("\n")))
    canvas = F.when(F.size("canvas") > 0, F.array_join("canvas", "\n\n"))
    pieces = F.array_compact(F.array(filled(F.col("p.title"), "# "), filled(F.col("p.description")), canvas))
    body = F.array_join(F.when(F.size(pieces) <= 1, F.concat(pieces, F.col("older"))).otherwise(pieces), "\n\n")
    return rows.select(*keep, F.btrim(body, F.lit(BLANKS)).alias("body"))


def page_links(url: Column, page: Column, needles: tuple[str, ...] = ()) -> Column:
    """Distinct absolute links of a page to its own host that hold every needle: unquoted, and those relative to the page or its host resolved."""
    root = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]+)", 1)
    whole = F.transform(text.hrefs(page), lambda h: urls.resolve(url, urls.unquote(h)))
    own = F.filter(whole, lambda h: h.isNotNull() & ((h == root) | h.startswith(F.concat(root, F.lit("/")))))
    for needle in needles:
        own = F.filter(own, lambda h, n=needle: h.contains(n))
    return F.array_distinct(own)


def feature_table(headers: Column) -> Column:
    """The other, stricter classifier: a header that is literally ``Feature``."""
    return F.when(F.array_contains(headers, "Feature"), "feature_matrix").otherwise("general")


def page_documents(pages: DataFrame, cap: int = TEXT_CAP) -> DataFrame:
    """(page_url, page_path, page_title, content_type, n, content, table_kind): FAQ, table and text documents of pages (url, title, html)."""
    meta = [F.col("url").alias("page_url"), F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1).alias("page_path"), F.col("title").alias("page_title")]
    rows = pages.select(*meta, text.to_faqs("html").alias("faqs"), text.to_tables("html").alias("tables"), text.to_content("html").alias("body"))

    def document(kind: str, n: Column, content: Column, table_kind: Column) -> Column:
        return F.struct(F.lit(kind).alias("content_type"), n.cast("int").alias("n"), content.alias("content"), table_kind.cast("string").alias("table_kind"))

    faqs = F.transform("faqs", lambda f, n: document("faq", n, text.render_faq(f["question"], f["answer"]), F.lit(None)))
    tables = F.transform("tables", lambda t, n: document("table", n, text.render_table(F.concat(F.lit("Table "), (n + 1).cast("string")), t["headers"], t["rows"]), text.table_class(t["headers"])))
    body = F.filter(F.array(document("text", F.lit(0), F.substring("body", 1, cap), F.lit(None))), lambda _: F.btrim("body", F.lit(BLANKS)) != "")
    # All documents of a page from one pass over it; outer, as for the inner form Spark infers a filter that parses every page again.
    made = rows.select("page_url", "page_path", "page_title", F.explode_outer(F.concat(faqs, tables, body)).alias("d"))
    return made.filter(F.col("d").isNotNull()).select("page_url", "page_path", "page_title", "d.*")


def flat_pages(pages: DataFrame, cap: int = FLAT_CAPS[0], min_length: int = 10) -> DataFrame:
    """(url, title, content): page text cut at the format's cap; pages with less text than ``min_length`` are left out."""
    return pages.select("url", "title", F.substring(text.to_text("html"), 1, cap).alias("content")).filter(F.length("content") >= min_length)
