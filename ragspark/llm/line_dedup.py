"""Operator 2, line dedup: of a line that several documents hold, only the smallest doc_id keeps it.

Line keys (md5 of the normalised line) are range-partitioned by (key, doc, position) and sorted in each
partition; a task streams its rows, remembering one key, so memory does not follow the size of a group.
Ranges include the document, so a line that a third of all documents hold spans many partitions; the
groups cut by a partition border are settled through one small row per border. What comes back is one
zlib-compressed keep bitmap for each row that loses lines, not text; rows are told apart by doc_id and a hash of their text.

Defined cases: null or empty text is one empty line; lines with keys under 10 code points always stay;
rows that share a doc_id are one document to the "found in two documents" rule, and each loses the lines that a smaller
doc_id holds, by its own positions; a row with a null doc_id loses nothing and takes nothing from others; doc_id is of an
integer type; other columns may have any name and are carried along. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import column, columns_of, discard, free_name, materialize, partitions

MIN_KEY_CHARS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_key(text: str = "text") -> Column:
    """Tells rows of one doc_id apart; rows with equal texts lose equal lines."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(docs: DataFrame) -> DataFrame:
    """(key, doc_id, version, pos) of every line whose key is long enough."""
    lines = docs.select("doc_id", text_key().alias("version"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)
    return lines.select("doc_id", "version", "pos", key.alias("line")).filter(F.length("line") >= MIN_KEY_CHARS).select(F.unhex(F.md5("line")).alias("key"), "doc_id", "version", "pos")


def _rows(kind: int, keys: pa.Array, doc: np.ndarray, version: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int8)), keys, pa.array(doc), pa.array(version), pa.array(pos, pa.int32())], names=["kind", "key", "doc_id", "version", "pos"])


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over sorted rows. kind 0: dropped; 1: row of the group that opens the partition, which may
    have begun in an earlier one; 2: first document here of the partition's first and of its last group."""
    seen, last_key, first_doc = 0, None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(0).cast(pa.binary(16))
        raw = np.frombuffer(keys.buffers()[1], np.uint64)[2 * keys.offset : 2 * (keys.offset + n)].reshape(n, 2)
        doc, version, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        new = np.ones(n, bool)
        new[1:] = (raw[1:] != raw[:-1]).any(axis=1)
        new[0] = keys[0].as_py() != last_key
        group = seen + np.cumsum(new)  # 1 is the group that opens the partition
        heads = np.concatenate([[first_doc], doc[new]])
        first = heads[group - seen]
        opening = group == 1
        drop = ~opening & (doc != first)
        if opening.any():
            yield _rows(1, keys.filter(pa.array(opening)).cast(pa.binary()), doc[opening], version[opening], pos[opening])
        if drop.any():
            yield _rows(0, pa.nulls(int(drop.sum()), pa.binary()), doc[drop], version[drop], pos[drop])
        if seen == 0:
            yield _rows(2, keys[:1].cast(pa.binary()), doc[:1], version[:1], pos[:1])
        seen, last_key, first_doc = int(group[-1]), keys[n - 1].as_py(), int(first[-1])
    if seen > 1:
        yield _rows(2, pa.array([last_key], pa.binary()), np.array([first_doc]), np.zeros(1, np.int64), np.zeros(1, np.int32))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, pos) of the lines to drop; a row that occurs several times brings its lines once for each."""
    spark = docs.sparkSession
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    keys = materialize(line_keys(docs.filter(F.col("doc_id").isNotNull())).withColumn("doc_id", F.col("doc_id").cast("long")))
    ordered = keys.repartitionByRange(partitions(spark), "key", "doc_id", "pos").sortWithinPartitions("key", "doc_id", "pos")
    found = materialize(ordered.mapInArrow(_first_occurrences, "kind tinyint, key binary, doc_id bigint, version bigint, pos int"))
    discard(keys)
    # Two rows a partition at most, so the size of this side is bounded by the number of partitions.
    borders = found.filter("kind = 2").groupBy("key").agg(F.min("doc_id").alias("first_doc"))
    settled = found.filter("kind = 1").join(F.broadcast(borders), "key").filter("doc_id <> first_doc")
    names = ["doc_id", "version", "pos"]
    return found.filter("kind = 0").select(*names).unionByName(settled.select(*names)).withColumn("doc_id", F.col("doc_id").cast(doc_type))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for drop in batch.column(2).to_pylist():
            bits = np.ones((max(drop) // 8 + 1) * 8, np.uint8)
            bits[drop] = 0
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc_id", "version", "keep"])


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc_id, version, keep) for the rows that lose lines; a line beyond the end of its bitmap stays."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    by_row = dropped_lines(docs).groupBy("doc_id", "version").agg(F.collect_list("pos").alias("drop"))
    return by_row.mapInArrow(_bitmaps, f"doc_id {kind}, version bigint, keep binary")


_LINES = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("text", T.StringType())])


@F.pandas_udf(_LINES)
def apply_bitmap(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
    rows = []
    for t, k in zip(text, keep, strict=True):
        t = t or ""
        if k is None:
            rows.append((t.count("\n") + 1, 0, t))
            continue
        lines = t.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8)).tolist()
        left = [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]
        rows.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "text"])


def deduplicated(docs: DataFrame, out: str = "_lines") -> DataFrame:
    """``docs`` with a struct column ``out`` (a name that must be free) of n_lines, n_dropped and the text that is left."""
    doc_id, version, keep = (free_name(docs, out + x) for x in ("_doc_id", "_version", "_keep"))
    maps = keep_bitmaps(docs.select("doc_id", "text")).withColumnsRenamed({"doc_id": doc_id, "version": version, "keep": keep})
    # The bitmaps grow with the corpus: a merge join at every size.
    joined = docs.hint("merge").join(maps, (F.col("doc_id") == column(doc_id)) & (text_key() == column(version)), "left")
    return joined.select(*columns_of(docs), apply_bitmap("text", column(keep)).alias(out))


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents without lines that a smaller doc_id holds; same columns (n_chars follows the text)."""
    out = free_name(docs, "_lines")
    df = deduplicated(docs, out).withColumn("text", column(out)["text"])
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*columns_of(docs))
