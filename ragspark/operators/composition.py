"""Files to chunks (SRC-09, SRC-12, SRC-15, SRC-18, SRC-19, CHK-02..10, SNK-20): profiles, metadata, stamps, counters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.tables import numbered

from . import text

#: What a file's chunks are called.
CONTENT_TYPES = {
    "pdf": "pdf_document", "docx": "word_document", "doc": "word_document", "xlsx": "excel_spreadsheet", "xls": "excel_spreadsheet",
    "pptx": "powerpoint_presentation", "ppt": "powerpoint_presentation", "txt": "text_file", "md": "text_file",
}
#: Profiles of directory scans by file type.
DIRECTORY_PROFILES = {"pdf": "pdf", "xlsx": "excel", "xls": "excel", "docx": "word", "doc": "word", "pptx": "slides", "ppt": "slides"}
#: Metadata columns of a file and what a missing one becomes.
METADATA = {"source_type": "remote_document", "source": "files", "file_name": "unknown", "file_type": "", "url": "", "folder_path": "", "drive_name": "", "last_modified": "", "created": "", "file_size_kb": "0"}


def _case(key: Column, values: dict[str, str], otherwise: str | None) -> Column:
    out = F.lit(otherwise).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_by_profile(body: pd.Series, profile: pd.Series) -> pd.Series:
    return pd.Series([text.split_text(t, *text.PROFILES[p]) if t and p in text.PROFILES else [] for t, p in zip(body, profile, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_pages_by_profile(page: pd.Series, profile: pd.Series) -> pd.Series:
    """The same of HTML, whose text is taken in the same pass: as a step of its own it keeps another Python process for each task."""
    bodies = ((text.html_text(h), p) for h, p in zip(page, profile, strict=True))
    return pd.Series([text.split_text(t, *text.PROFILES[p]) if t and p in text.PROFILES else [] for t, p in bodies])


def remote_profile(file_type: Column) -> Column:
    return text.profile_of(F.lower(file_type))


def directory_profile(file_type: Column) -> Column:
    return _case(F.lower(file_type), DIRECTORY_PROFILES, "remote")


def chunk_by_profile(docs: DataFrame, profile: Column, body: str = "text", html: bool = False) -> DataFrame:
    """Every row of ``docs`` cut by its own profile: its other columns, chunk_index (from 0 in each row), total_chunks and the chunk as ``body``.

    With ``html``, ``body`` is a page whose text is cut.
    """
    rest = [c for c in docs.columns if c != body]
    split = split_pages_by_profile if html else split_by_profile
    rows = docs.select(*rest, split(body, profile).alias("_chunks"))
    # Outer: for the inner form Spark infers a filter on the number of chunks, for which every text is split a second time.
    rows = rows.select(*rest, F.size("_chunks").alias("total_chunks"), F.posexplode_outer("_chunks").alias("chunk_index", body))
    return rows.filter(F.col("chunk_index").isNotNull())


def renumbered(chunks: DataFrame, *order: str) -> DataFrame:
    """Chunks of a batch with ``chunk_index`` from 0 over the whole batch, in the given order, and ``total_chunks`` of it: what site pages get."""
    rows = numbered(chunks, "_index", *order)
    return rows.withColumn("chunk_index", F.col("_index")).drop("_index").withColumn("total_chunks", F.lit(rows.count()))


def file_chunks(files: DataFrame) -> DataFrame:
    """Chunks of files (file_name, file_type, text and any of METADATA) with full metadata and content_type; blank texts give none."""
    kept = [F.coalesce(F.col(c).cast("string"), F.lit(d)).alias(c) if c in files.columns else F.lit(d).alias(c) for c, d in METADATA.items()]
    rows = files.filter(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "").select(*kept, "text").withColumn("file_type", F.lower("file_type"))
    return chunk_by_profile(rows, remote_profile(F.col("file_type"))).withColumn("content_type", _case(F.col("file_type"), CONTENT_TYPES, None))


def directory_documents(files: DataFrame) -> DataFrame:
    """One row a file with text: source, file_path, file_format, content_type, searchable_terms (first 20 words), text."""
    rows = files.filter(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "")
    kind = _case(F.lower("file_type"), {"xlsx": "excel_data", "xls": "excel_data", "docx": "word_document", "doc": "word_document"}, "text")
    return rows.select(F.col("file_name").alias("source"), F.col("path").alias("file_path"), F.lower("file_type").alias("file_format"), kind.alias("content_type"), text.first_words(F.col("text")).alias("searchable_terms"), "text")


def stamped(chunks: DataFrame, chunk_type: Column, body: str = "text") -> DataFrame:
    return chunks.withColumn("chunk_type", chunk_type).withColumn("searchable_content", text.first_words(F.col(body)))


def rechunk(docs: DataFrame, profile: str, body: str = "text") -> DataFrame:
    """Cut documents again; ordinals and totals count within each of them."""
    return chunk_by_profile(docs.drop("chunk_index", "total_chunks"), F.lit(profile), body)


def batch_counts(files: DataFrame) -> DataFrame:
    """successful: files that gave text; failed: missing, unreadable or empty ones (text null or blank, or an error)."""
    good = (F.coalesce(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit("")) != "") & (F.col("error").isNull() if "error" in files.columns else F.lit(True))
    return files.agg(F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"), F.count(F.lit(1)).alias("total"))


def heading_files(lines: DataFrame) -> DataFrame:
    """(doc_id, file_name, content): texts cut at headings (doc_id, pos, level, text), each named by the slug of its heading."""
    from pyspark.sql import Window

    by = Window.partitionBy("doc_id").orderBy("pos")
    rows = lines.withColumn("part", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(by)).filter("part > 0")
    parts = F.array_sort(F.collect_list(F.struct("pos", "level", "text")))
    got = rows.groupBy("doc_id", "part").agg(parts.alias("p"))
    body = F.array_join(F.transform(F.slice("p", 2, F.size("p")), lambda x: x["text"]), "\n")
    return got.select("doc_id", F.concat(text.slug(F.get("p", F.lit(0))["text"]), F.lit(".txt")).alias("file_name"), body.alias("content"))
