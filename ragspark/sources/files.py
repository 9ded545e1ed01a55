"""File scans (SRC-04..19, SRC-36..42): binary, text and JSON files to frames; extraction by type inside tasks."""

from __future__ import annotations

import io
import re
import zipfile
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def decode(content: bytes, name: str = "") -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def _joined(node, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def _word_body(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")


def word_text(content: bytes, name: str = "") -> str:
    """Banner, paragraphs, then table rows without their empty cells."""
    body = _word_body(content)
    out = [f"Word document: {name}", "Contains structured text and formatting information"]
    out += [p for p in (_joined(x, f"{_W}t") for x in body.findall(f"{_W}p")) if p.strip()]
    for row in body.iter(f"{_W}tr"):
        out.append(" | ".join(c for c in (_joined(x, f"{_W}t").strip() for x in row.findall(f"{_W}tc")) if c))
    return "\n".join(x for x in out if x)


def word_summary(content: bytes) -> tuple[int, int, int]:
    """Paragraphs, tables and characters of paragraphs."""
    body = _word_body(content)
    paragraphs = [_joined(x, f"{_W}t") for x in body.findall(f"{_W}p")]
    return len(paragraphs), len(body.findall(f"{_W}tbl")), sum(map(len, paragraphs))


def _shape_lines(node) -> list[str]:
    return [x for x in (_joined(p, f"{_A}t") for p in node.iter(f"{_A}p")) if x]


def slides_text(content: bytes, name: str = "") -> str:
    """A heading a slide, text of its shapes, rows of its tables, its notes."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for i, path in enumerate(names, 1):
            out.append(f"\n--- Slide {i} ---\n")
            tree = ElementTree.fromstring(z.read(path))
            for shape in (n for n in tree.iter() if n.tag in (f"{_P}sp", f"{_P}graphicFrame")):
                if shape.tag == f"{_P}sp":
                    out += ["\n".join(_shape_lines(shape))] if _shape_lines(shape) else []
                for row in shape.iter(f"{_A}tr"):
                    cells = [c for c in (_joined(x, f"{_A}t") for x in row.findall(f"{_A}tc")) if c]
                    out += [" | ".join(cells)] if cells else []
            rels = path.replace("slides/", "slides/_rels/") + ".rels"
            for rel in ElementTree.fromstring(z.read(rels)) if rels in z.namelist() else []:
                if rel.get("Type", "").endswith("/notesSlide"):
                    notes = "\n".join(_shape_lines(ElementTree.fromstring(z.read("ppt/" + rel.get("Target").removeprefix("../")))))
                    out += [f"\n[Notes: {notes}]"] if notes else []
    return "\n".join(out)


def _sheets(content: bytes) -> list[tuple[str, list[list[tuple[str, bool]]]]]:
    """(name, rows) of each sheet; a cell is its text and whether it is a number."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_joined(si, f"{_S}t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")] if "xl/workbook.xml" in z.namelist() else []
        paths = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out = []
        for k, path in enumerate(paths):
            rows = []
            for row in ElementTree.fromstring(z.read(path)).iter(f"{_S}row"):
                cells: list[tuple[str, bool]] = []
                for c in row.findall(f"{_S}c"):
                    letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                    cells += [("", False)] * (at - len(cells))
                    v = c.find(f"{_S}v")
                    value = _joined(c, f"{_S}t") if v is None else v.text or ""
                    cells.append((shared[int(value)], False) if c.get("t") == "s" and value else (value, c.get("t", "n") == "n" and value != ""))
                rows.append(cells)
            out.append((names[k] if k < len(names) else f"Sheet{k + 1}", rows))
        return out


def sheet_text(content: bytes, name: str = "") -> str:
    """Banner, a heading a sheet, its columns, rows that hold something, and mean, least and most of numeric columns."""
    out = [f"Excel file: {name}", "Contains structured data and information"]
    for sheet, rows in _sheets(content):
        out.append(f"\n--- Sheet: {sheet} ---\n")
        if len(rows) < 2:
            continue
        width = max(map(len, rows))
        full = [[*r, *[("", False)] * (width - len(r))] for r in rows]
        heads = [c or f"Unnamed: {i}" for i, (c, _) in enumerate(full[0])]
        out.append("Columns: " + " | ".join(heads) + "\n")
        out += [f"Row {i}: {' | '.join(c for c, _ in r)}\n" for i, r in enumerate(full[1:], 1) if any(c.strip() for c, _ in r)]
        numeric = [(h, [float(r[i][0]) for r in full[1:] if r[i][0]]) for i, h in enumerate(heads) if all(r[i][1] or not r[i][0] for r in full[1:])]
        numeric = [(h, x) for h, x in numeric if x]
        if numeric:
            out.append("\nSummary for numeric columns:\n")
            out += [f"{h}: mean={sum(x) / len(x):.2f}, min={min(x):.2f}, max={max(x):.2f}\n" for h, x in numeric]
    return "\n".join(out)


def sheet_summary(content: bytes) -> tuple[list[str], int, int]:
    """Sheet names, rows below the headers, most columns."""
    sheets = _sheets(content)
    return [n for n, _ in sheets], sum(max(len(r) - 1, 0) for _, r in sheets), max((max(map(len, r), default=0) for _, r in sheets), default=0)


EXTRACTORS = {"txt": decode, "md": decode, "docx": word_text, "pptx": slides_text, "xlsx": sheet_text}


def extract(path: str, content: bytes) -> tuple[str, str | None]:
    """(text, error); a type without extractor is empty text. Register others (content, file name), such as one for PDF, in EXTRACTORS."""
    name = path.rpartition("/")[2]
    run = EXTRACTORS.get(name.rpartition(".")[2].lower())
    try:
        return (run(content, name) if run else ""), None
    except Exception as e:  # a broken file is a row with its error, not a failed job
        return "", f"{type(e).__name__}: {e}"


def first_filled(*extractors):
    """One extractor of several: tried in turn until the text is not blank; what a failed one gave before is kept and added to."""

    def run(content: bytes, name: str = "") -> str:
        held, last = "", None
        for one in extractors:
            try:
                held += one(content, name)
            except Exception as e:
                held, last = held + getattr(e, "partial", ""), e
            if held.strip():
                return held
        if last is not None:
            raise last
        return held

    return run


_EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_EXTRACTED)
def extracted(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(p, c) for p, c in zip(path, content, strict=True)], columns=["text", "error"])


def scan_folder(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, file_name, file_type, size, modified, text, error) of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("file_name"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("file_type"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), extracted("path", "content").alias("x"))
    return rows.select("path", "file_name", "file_type", "size", "modified", "x.text", "x.error")


_SUMMARY = T.StructType([T.StructField("sheet_names", T.ArrayType(T.StringType())), *(T.StructField(c, T.LongType()) for c in ("total_rows", "total_columns", "paragraph_count", "table_count", "text_length")), T.StructField("error", T.StringType())])


@F.pandas_udf(_SUMMARY)
def _summarized(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    def one(p: str, c: bytes) -> tuple:
        try:
            if p.lower().endswith(".xlsx"):
                return (*sheet_summary(c), None, None, None, None)
            return (None, None, None, *word_summary(c), None)
        except Exception as e:
            return (None,) * 6 + (f"{type(e).__name__}: {e}",)

    return pd.DataFrame([one(p, c) for p, c in zip(path, content, strict=True)], columns=_SUMMARY.names).astype(object)


def summarize_folder(spark: SparkSession, path: str) -> DataFrame:
    """Structure of the .xlsx and .docx files of a folder: (file_name, sheet_count, sheet_names, total_rows, total_columns, paragraph_count, table_count, text_length, error)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,docx}").load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), _summarized("path", "content").alias("x"))
    return rows.select("file_name", F.size("x.sheet_names").alias("sheet_count"), "x.*")


def scan_json_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, n, line) of JSONL files, globs too; parsing and its counters are feedback.convert_status. ``n`` orders the lines of a file: by
    the split that a line is in, and within it as they are read."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")).alias("n"), F.col("value").alias("line"))
    return lines


def union_enabled(sources: dict[str, DataFrame], enabled: list[str]) -> DataFrame:
    """The enabled sources, stamped with their name; columns that one lacks are null."""
    chosen = [df.withColumn("source_type", F.lit(name)) for name, df in sources.items() if name in enabled]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)
