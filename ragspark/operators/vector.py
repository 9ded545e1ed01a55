"""Exact vector search (VEC-01..06, VEC-09..12, ORD-01): pre-filter, score, top k with a total order."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scores are compared after rounding, so near ties rank alike everywhere; then the smaller id wins.
DIGITS = 6
#: Queries scored in one pass over the store: every task holds them. More are met in blocks.
MAX_QUERIES = 5_000
#: Vectors of a query block and of a store block, which one task holds together, and rows multiplied at once.
QUERY_BLOCK, STORE_BLOCK, STRIP = 2_000, 50_000, 4_096


def _norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Cosine similarity of two arrays in double precision; 0.0 if either norm is 0. ``norm_b`` spares b's norm in every row."""
    dot = F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = _norm(a) * (_norm(b) if norm_b is None else norm_b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot / norms)


def top_k(store: DataFrame, query: list[float], k: int = 4, where: Column | None = None) -> DataFrame:
    """The k best rows of a store (vec_id, embedding, ...) for one query vector, with their score."""
    rows = store if where is None else store.filter(where)
    rows = rows.filter(F.size("embedding") == len(query))
    norm = F.lit(math.hypot(*query))
    scored = rows.withColumn("score", F.round(cosine(F.col("embedding"), F.array(*map(F.lit, query)), norm), DIGITS))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores; only those that reach the k-th are sorted."""
    near = np.arange(len(scores)) if len(scores) <= k else np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _block_scores(ids: np.ndarray, vectors: np.ndarray, k: int):
    norms = np.linalg.norm(vectors, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            scale = np.linalg.norm(x, axis=1)[:, None] * norms[None, :]
            scores = np.round(np.divide(x @ vectors.T, scale, out=np.zeros_like(scale), where=scale > 0), DIGITS)
            vec = batch.column(0).to_numpy(zero_copy_only=False)
            # Candidates of this block only; ties at the edge are kept by the total order (score, id).
            best = np.stack([_best(scores[:, j], vec, k) for j in range(len(ids))], axis=1)
            q = np.broadcast_to(np.arange(len(ids)), best.shape).ravel()
            rows = best.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(vec[rows]), pa.array(scores[rows, q])], names=["qid", "vec_id", "score"])

    return run


def _in_blocks(store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best rows of each block of the store for each query: every block of queries meets every block of the store in a task of its own."""
    n_store = max(store.sparkSession.sparkContext.defaultParallelism, -(-store.count() // STORE_BLOCK))
    n_query = -(-queries.count() // QUERY_BLOCK)

    def dealt(rows: DataFrame, id_: str, own: str, n: int, other: str, m: int) -> DataFrame:
        # Of the same type as the other side's numbers: a long and an int of one value are dealt to different partitions.
        block = F.pmod(F.xxhash64(id_, "embedding"), F.lit(n)).cast("int").alias(own)
        return rows.select(id_, "embedding", F.size("embedding").alias("dim"), block, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)).groupBy("dim", "s", "q")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        vectors = right["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(right.num_rows, -1)
        strips = left.select(["vec_id", "embedding"]).to_batches(max_chunksize=STRIP)
        return pa.Table.from_batches(list(_block_scores(right["qid"].to_numpy(), vectors, k)(iter(strips))))

    met = dealt(store, "vec_id", "s", n_store, "q", n_query).cogroup(dealt(queries, "qid", "q", n_query, "s", n_store))
    return met.applyInArrow(cell, "qid long, vec_id long, score double")


def batch_top_k(store: DataFrame, queries: DataFrame, k: int = 25, most: int | None = None) -> DataFrame:
    """(qid, vec_id, score, rank): the k best rows for each query (qid, embedding).

    Up to ``most`` queries (MAX_QUERIES) are held by every task and the store is not shuffled: a block of it is multiplied with all of
    them at once. More queries stay distributed: both sides are dealt to blocks and each pair of blocks meets in one task.
    Either way a block passes on its own k best, and only those meet. Null vectors match nothing.
    """
    most = MAX_QUERIES if most is None else most
    rows = store.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = queries.filter(F.col("embedding").isNotNull()).select(F.col("qid").cast("long").alias("qid"), "embedding")
    held = asked.limit(most + 1).collect()
    if len(held) > most:
        scored = _in_blocks(rows, asked, k)
    else:
        scored = store.sparkSession.createDataFrame([], "qid long, vec_id long, score double")
        for dim in sorted({len(r["embedding"]) for r in held}):
            same = [r for r in held if len(r["embedding"]) == dim]
            ids, vectors = np.array([r["qid"] for r in same], np.int64), np.array([r["embedding"] for r in same], np.float64)
            scored = scored.unionByName(rows.filter(F.size("embedding") == dim).mapInArrow(_block_scores(ids, vectors, k), "qid long, vec_id long, score double"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def embed_hashing(text: Column, dim: int) -> Column:
    """A unit vector of word counts hashed into ``dim`` places; zeros for a null or blank text. No model is needed."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> np.ndarray:
            places = [zlib.crc32(w.encode()) % dim for w in (t or "").lower().split()]
            v = np.bincount(np.array(places, np.int64), minlength=dim).astype(np.float64)
            return v / max(np.linalg.norm(v), 1e-300)

        return texts.map(one)

    return embed(text)


def stats(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).cast("long").alias("dim"), F.count_if(F.col("embedding").isNull()).alias("n_missing"))


def compare_sources(store: DataFrame, source: str) -> DataFrame:
    """Presence, dimension range and count of vectors by source."""
    size = F.size("embedding").cast("long")
    return store.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"), F.count_if(F.col("embedding").isNull()).alias("n_missing"))


def grounded(pairs: DataFrame, answer: str, text: str, min_length: int = 5, min_shared: int = 3) -> DataFrame:
    """Adds n_shared, the number of distinct longer words that answer and text share, and grounded."""
    def long_words(c: str) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > min_length))

    shared = F.size(F.array_intersect(long_words(answer), long_words(text))).cast("long")
    return pairs.withColumn("n_shared", shared).withColumn("grounded", shared > min_shared)


def grounding_counts(answers: DataFrame, docs: DataFrame, min_length: int = 5, min_shared: int = 3) -> DataFrame:
    """(id, n_docs): the documents (doc_id, text) that share over ``min_shared`` distinct longer words with each answer (id, answer).

    By an inverted index: pairs meet at the words they share, and only words of answers are looked up.
    """
    def words(df: DataFrame, key: str, c: str) -> DataFrame:
        return df.select(key, F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > min_length))).alias("word"))

    shared = words(answers, "id", "answer").join(words(docs, "doc_id", "text"), "word").groupBy("id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    counts = shared.filter(F.col("n") > min_shared).groupBy("id").agg(F.count(F.lit(1)).alias("n_docs"))
    return answers.select("id").join(counts, "id", "left").select("id", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"))
