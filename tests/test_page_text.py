"""Queries over pages and documents that have no SQL, against other ways to the same result."""

import html
import re

from ragspark.operators import text
from ragspark.plans import QUERIES

SF = "/root/testdata/sf0.01"


def pieces(page):
    """Text between tags by patterns alone; pages of the table are simple enough for that."""
    page = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "\x00", page)
    page = re.sub(r"(?s)<!--.*?-->|<![^>]*>", "\x00", page)
    return [t for t in (html.unescape(p).strip() for p in re.split(r"(?s)<[^>]*>|\x00", page)) if t]


def test_html_to_text(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    squeezed = lambda t: re.sub(r"\s+", "", t)
    rows = QUERIES["html_to_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert squeezed(r.text) == squeezed("".join(pieces(pages[r.page_id]))), r.page_id
        assert all(t in r.text or squeezed(t) in squeezed(r.text) for t in pieces(pages[r.page_id]))
        # Content lacks what stands in navigation, headers and footers.
        body = re.sub(r"(?is)<(nav|header|footer)\b.*?</\1\s*>", "\x00", pages[r.page_id])
        assert squeezed(r.content) == squeezed("".join(pieces(body))), r.page_id


def test_chunk_recursive(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    chunks = {}
    for r in text.chunk_recursive(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        chunks.setdefault(r.doc_id, []).append((r.chunk_index, r.chunk))
    for doc_id, body in docs.items():
        found = [c for _, c in sorted(chunks.get(doc_id, []))]
        # Chunks lie in order in the text, none begins before the last one's start, and nothing but white space is between them.
        at = end = 0
        for c in found:
            # The last place that leaves no gap: repeated words have several.
            blank = len(body[end:]) - len(body[end:].lstrip())
            start = body.rfind(c, at, end + blank + len(c))
            assert start >= 0 and not body[end:start].strip(), doc_id
            at, end = start, max(end, start + len(c))
        assert not body[end:].strip(), doc_id
