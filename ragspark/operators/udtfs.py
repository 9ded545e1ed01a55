"""Table functions for SQL (EXT-02, EXT-14, SNK-20): ``select ... from pages p, lateral page_tables(p.html)``.

``register`` makes them known to a session: ``page_tables``, ``page_faqs``, ``page_sections``. Null pages give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .text import html_tables, list_faqs

_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")


class PageTables:
    """(n, headers, cells) of each table of a page."""

    def eval(self, html: str) -> Iterator[tuple]:
        for n, t in enumerate(html_tables(html)):
            yield n, t["headers"], t["rows"]


class PageFaqs:
    """(n, question, answer) of each question of a page's lists."""

    def eval(self, html: str) -> Iterator[tuple]:
        for n, f in enumerate(list_faqs(html)):
            yield n, f["question"], f["answer"]


class PageSections:
    """(n, level, heading, body) of a Markdown text; what stands before the first heading has level 0."""

    def eval(self, markdown: str) -> Iterator[tuple]:
        level, heading, body, n = 0, None, [], 0
        for line in [*(markdown or "").split("\n"), None]:
            found = None if line is None else _HEADING.match(line)
            if line is None or found:
                text = "\n".join(body).strip()
                if heading is not None or text:
                    yield n, level, heading, text
                    n += 1
                if found:
                    level, heading, body = len(found[1]), found[2], []
            else:
                body.append(line)


FUNCTIONS = {
    "page_tables": (PageTables, "n int, headers array<string>, cells array<array<string>>"),
    "page_faqs": (PageFaqs, "n int, question string, answer string"),
    "page_sections": (PageSections, "n int, level int, heading string, body string"),
}


def register(spark: SparkSession) -> None:
    for name, (function, returned) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function, returnType=returned, useArrow=False))
