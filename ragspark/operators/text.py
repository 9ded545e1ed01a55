"""Cleaning, structure extraction and chunking (TXT-*, EXT-*, CHK-*, SCA-*)."""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values: (size, overlap, separators) of the chunking profiles.
PROFILES = {
    "web": (1500, 300, ["\n\n", "\n", ". ", " ", ""]),
    "pdf": (1000, 200, ["\n\n", "\n", " ", ""]),
    "excel": (1000, 200, ["\n\n", "\n", " | ", " ", ""]),
    "word": (1000, 200, ["\n\n", "\n", " | ", " ", ""]),
    "slides": (1500, 300, ["\n\n", "\n", " ", ""]),
    "remote": (1500, 300, ["\n\n", "\n", " ", ""]),
    "remote_sheet": (2000, 200, ["\n\n", "\n", "---", " ", ""]),
}


def profile_of(extension: Column) -> Column:
    return F.when(extension.isin("xlsx", "xls"), "remote_sheet").otherwise("remote")


def parse_vtt(vtt: Column) -> Column:
    """Speech of a WebVTT transcript: no headers, notes, cue times, blanks or lines of digits."""
    lines = F.transform(F.split(vtt, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("WEBVTT") & ~x.startswith("NOTE") & ~x.contains("-->") & ~x.rlike("^[0-9]+$")), "\n")


def prefer_parsed(parsed: Column, raw: Column) -> Column:
    return F.when(parsed != "", parsed).otherwise(raw)


def hrefs(page: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(page, F.lit("href=[\"']([^\"']+)[\"']"), 1))


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("https?://[^\\s<>\"')]+"), 0))


def first_words(text: Column, n: int = 20) -> Column:
    # Blanks are evened out in as much of the text as holds n words, and the blank before them.
    text = F.regexp_extract(text, rf"^\s*+(?:\S++\s*+){{0,{n}}}+", 0)
    return F.array_join(F.slice(F.split(F.btrim(F.regexp_replace(text, r"\s+", " ")), " "), 1, n), " ")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", ""), r"[\s-]+", "_")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def table_class(headers: Column) -> Column:
    h = F.lower(F.concat_ws(" ", headers))
    return (
        F.when(h.contains("feature") & (h.contains("yes") | h.contains("no")), "feature_matrix").when(h.contains("description"), "description").when(h.contains("migration"), "migration").otherwise("general")
    )


def render_table(title: Column, headers: Column, rows: Column, first: int = 10, total: Column | None = None) -> Column:
    """Title, headers and the first rows as lines; the number of further rows, if any. ``rows`` may hold the first ones only, with ``total`` given."""
    total = F.size(rows) if total is None else total
    shown = F.transform(F.slice(rows, 1, first), lambda r, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), F.array_join(r, " | ")))
    head = F.when(F.size(headers) > 0, F.concat(F.lit("Headers: "), F.array_join(headers, ", ")))
    more = F.when(total > first, F.concat(F.lit("... and "), (total - first).cast("string"), F.lit(" more rows")))
    return F.array_join(F.concat(F.array(F.concat(F.lit("Table: "), title), head), shown, F.array(more)), "\n")


def render_faq(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Q: "), question, F.lit("\n\nA: "), answer)


def flatten_canvas(payload: Column) -> Column:
    """Text of a page payload's web parts: sections, columns, parts in order, then the vertical section."""
    part = "array<struct<innerHtml:string>>"
    layout = F.from_json(payload, f"canvasLayout struct<horizontalSections:array<struct<columns:array<struct<webparts:{part}>>>>,verticalSection:struct<webparts:{part}>>")["canvasLayout"]
    across = F.flatten(F.transform(layout["horizontalSections"], lambda s: F.flatten(F.transform(s["columns"], lambda c: c["webparts"]))))
    parts = F.concat(F.coalesce(across, F.array().cast(part)), F.coalesce(layout["verticalSection"]["webparts"], F.array().cast(part)))
    return F.array_join(F.filter(F.transform(parts, lambda p: p["innerHtml"]), lambda x: x.isNotNull() & (x != "")), "\n\n")


def paragraph_faqs(paragraphs: DataFrame) -> DataFrame:
    """(page, faq_number, question, answer) of paragraphs (page, pos, text): a question opens an island that a blank line or the next question ends."""
    by = Window.partitionBy("page").orderBy("pos")
    text = F.btrim("text")
    question = F.contains(text, F.lit("?")) & (F.length(text) > 20) & (F.length(text) < 200)
    rows = paragraphs.select("page", "pos", text.alias("text"), question.alias("q"), (text == "").alias("blank"))
    rows = rows.withColumn("island", F.sum((F.col("q") | F.col("blank")).cast("int")).over(by))
    parts = F.array_sort(F.collect_list(F.struct("pos", "q", "blank", "text")))
    groups = rows.groupBy("page", "island").agg(parts.alias("p")).filter(F.get("p", F.lit(0))["q"] & (F.size("p") > 1))
    answer = F.array_join(F.transform(F.slice("p", 2, F.size("p")), lambda x: x["text"]), " ")
    return groups.select("page", F.row_number().over(Window.partitionBy("page").orderBy("island")).alias("faq_number"), F.get("p", F.lit(0))["text"].alias("question"), answer.alias("answer"))


def chunk_fixed(docs: DataFrame, size: int = 1500, overlap: int = 300) -> DataFrame:
    """(doc_id, chunk_index, total_chunks, chunk) by character offsets."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length("text") - overlap) / step), F.lit(1)).cast("int")
    rows = docs.filter(F.length("text") > 0).select("doc_id", "text", n.alias("total_chunks"))
    rows = rows.select("doc_id", "text", "total_chunks", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)).alias("chunk_index"))
    return rows.select("doc_id", "chunk_index", "total_chunks", F.substring("text", F.col("chunk_index") * step + 1, F.lit(size)).alias("chunk"))


def _ends(text: str, sep: str) -> tuple[Callable[[int, int], int], Callable[[int], int]]:
    """(last, next) over the places where ``text`` is cut, each before a separator, or before any character if that is empty:
    the last one in [lo, hi], or -1, and the first one from lo on, or the length of the text."""
    n = len(text)
    if not sep:
        return lambda lo, hi: min(hi, n - 1) if lo <= min(hi, n - 1) else -1, lambda lo: min(lo, n)
    if any(sep.startswith(sep[i:]) for i in range(1, len(sep))):
        # Occurrences may overlap: only those that a scan from the left meets count.
        places = [m.start() for m in re.finditer(re.escape(sep), text)]

        def last(lo: int, hi: int) -> int:
            i = bisect_right(places, hi) - 1
            return places[i] if i >= 0 and places[i] >= lo else -1

        def next_(lo: int) -> int:
            i = bisect_left(places, lo)
            return places[i] if i < len(places) else n

        return last, next_
    width = len(sep)

    def first(lo: int) -> int:
        i = text.find(sep, lo)
        return i if i >= 0 else n

    return lambda lo, hi: text.rfind(sep, lo, hi + width), first


def _merged(text: str, begin: int, end: int, size: int, overlap: int, last: Callable[[int, int], int], next_: Callable[[int], int]) -> list[str]:
    """Texts of [begin, end), whose pieces are short enough: neighbouring pieces put together up to ``size`` characters; each text begins with up to ``overlap`` of the one before."""
    out: list[str] = []
    while end - begin > size:
        cut = last(begin + 1, begin + size)
        out.append(text[begin:cut])
        # The next text has room for the piece at the cut.
        least = max(cut - overlap, min(next_(cut + 1), end) - size)
        begin = min(next_(least), cut) if least > begin else begin
    if end > begin:
        out.append(text[begin:end])
    return [x for x in (t.strip() for t in out) if x]


def split_text(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Texts of at most ``size`` characters, cut before the first separator that occurs; pieces that are too long are cut by finer ones on their own.

    Cuts are looked for from where one is needed, so a text costs some searches for each of its chunks, not a step for each piece.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), None)
    if at is None:
        return [x for x in (text.strip(),) if x]
    last, next_ = _ends(text, separators[at])
    if separators[at] == "":
        return _merged(text, 0, len(text), size, overlap, last, next_)
    out: list[str] = []
    begun = at_ = 0
    while len(text) - at_ >= size:
        hop = last(at_ + 1, at_ + size - 1)
        if hop < 0:  # the piece that begins here is too long
            end = next_(at_ + 1)
            out += _merged(text, begun, at_, size, overlap, last, next_)
            out += split_text(text[at_:end], size, overlap, separators[at + 1 :]) if separators[at + 1 :] else [text[at_:end]]
            begun = hop = end
        at_ = hop
    return out + _merged(text, begun, len(text), size, overlap, last, next_)


def chunk_recursive(docs: DataFrame, profile: str = "web") -> DataFrame:
    """(doc_id, chunk_index, total_chunks, chunk) by a profile's separators."""
    size, overlap, separators = PROFILES[profile]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: split_text(t, size, overlap, separators) if t else [])

    rows = docs.select("doc_id", cut("text").alias("c"))
    # Outer: the inner form is given a filter for which every text is split a second time.
    return rows.select("doc_id", F.size("c").alias("total_chunks"), F.posexplode_outer("c").alias("chunk_index", "chunk")).filter(F.col("chunk_index").isNotNull())


class _Text(HTMLParser):
    """Visible text pieces, one between two tags; the content of dropped elements is left out."""

    def __init__(self, drop: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.drop, self.depth, self.parts, self.held = drop, 0, [], ""

    def _end_piece(self) -> None:
        if self.held.strip():
            self.parts.append(self.held.strip())
        self.held = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._end_piece()
        self.depth += tag in self.drop

    def handle_endtag(self, tag: str) -> None:
        self._end_piece()
        if tag in self.drop and self.depth:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.held += data

    def close(self) -> None:
        super().close()
        self._end_piece()


class _Tables(HTMLParser):
    """Rows of cells of every table."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append("")
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None and self.tables and self.tables[-1] and self.tables[-1][-1]:
            self.tables[-1][-1][-1] = " ".join(self.cell)
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None and data.strip():
            self.cell.append(data.strip())


CODE = frozenset({"script", "style"})
CHROME = CODE | {"nav", "header", "footer"}


def html_text(page: str | None, separator: str = "\n", drop: frozenset[str] = CODE, unescape: bool = False) -> str:
    parser = _Text(drop)
    parser.feed(html.unescape(page or "") if unescape else page or "")
    parser.close()
    return separator.join(parser.parts)


def html_tables(page: str | None) -> list[dict]:
    """Headers (first row) and rows, padded to the header, of tables that have both."""
    parser = _Tables()
    parser.feed(page or "")
    out = []
    for table in parser.tables:
        rows = [r for r in table if any(c.strip() for c in r)]
        if len(rows) > 1:
            width = len(rows[0])
            out.append({"headers": rows[0], "rows": [r[:width] + [""] * (width - len(r)) for r in rows[1:]]})
    return out


def markdown_table(headers: list[str], rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(headers), line(["---"] * len(headers)), *map(line, rows)])


def list_faqs(page: str | None) -> list[dict]:
    """Question and answer of list items with a question mark: text over 50 characters, answer over 20, each once."""
    out, seen = [], set()
    for item in re.findall(r"(?is)<li[^>]*>(.*?)(?=</li>|<li[ >]|</[ou]l>|$)", page or ""):
        text = html_text(item, " ")
        if "?" in text and len(text) > 50 and text not in seen:
            question, answer = text.split("?", 1)
            if len(answer.strip()) > 20:
                seen.add(text)
                out.append({"question": question.strip() + "?", "answer": answer.strip()})
    return out


TABLES = T.ArrayType(T.StructType([T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))]))


@F.pandas_udf(T.StringType())
def to_text(page: pd.Series) -> pd.Series:
    return page.map(html_text)


@F.pandas_udf(T.StringType())
def to_content(page: pd.Series) -> pd.Series:
    return page.map(lambda p: html_text(p, " ", CHROME))


@F.pandas_udf(TABLES)
def to_tables(page: pd.Series) -> pd.Series:
    return page.map(html_tables)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])))
def to_faqs(page: pd.Series) -> pd.Series:
    return page.map(list_faqs)
