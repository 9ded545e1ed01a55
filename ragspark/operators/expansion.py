"""Query expansion and retrieval for many questions (RET-03, RET-05, VEC-05): variants, hits of each, first-wins union, cited context."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import retrieval, vector

#: Hits of the question itself and of a rephrasing; rephrasings taken; documents kept for a prompt.
OWN_HITS, MORE_HITS, REPHRASINGS, MAX_DOCS = 25, 12, 2, 30


class Embedder(Protocol):
    def __call__(self, text: Column, dim: int) -> Column: ...


class Rephraser(Protocol):
    """Text of a question to other wordings, one a line; it may raise."""

    def __call__(self, question: str) -> str: ...


class Answerer(Protocol):
    def __call__(self, question: Column, context: Column) -> Column: ...


def rephrased(question: Column, rephrase: Callable[[str], str]) -> Column:
    """The first REPHRASINGS non-blank lines that ``rephrase`` gives; none where it fails."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(questions: pd.Series) -> pd.Series:
        def one(q: str | None) -> list[str]:
            try:
                lines = rephrase(q).split("\n") if q is not None else []
            except Exception:  # a failed rephrasing leaves the question alone
                lines = []
            return [x.strip() for x in lines if x.strip()][:REPHRASINGS]

        return questions.map(one)

    return run(question)


def expand(questions: DataFrame, rephrase: Callable[[str], str] | None = None) -> DataFrame:
    """(qid, variant, question, k): each question (qid, question) as variant 0 and its rephrasings as 1, 2."""
    own = questions.select("qid", F.lit(0).alias("variant"), "question", F.lit(OWN_HITS).alias("k"))
    if rephrase is None:
        return own
    more = questions.select("qid", F.posexplode(rephrased(F.col("question"), rephrase)).alias("pos", "question"))
    return own.unionByName(more.select("qid", (F.col("pos") + 1).alias("variant"), "question", F.lit(MORE_HITS).alias("k")))


def variant_hits(variants: DataFrame, store: DataFrame) -> DataFrame:
    """(qid, variant, rank, vec_id, score) of variants (qid, variant, k, embedding); all variants share the passes over the store."""
    keyed = variants.withColumn("vid", F.col("qid") * (REPHRASINGS + 1) + F.col("variant"))
    hits = vector.batch_top_k(store, keyed.select(F.col("vid").alias("qid"), "embedding"), OWN_HITS).withColumnRenamed("qid", "vid")
    return hits.join(keyed.select("vid", "qid", "variant", "k"), "vid").filter("rank <= k").select("qid", "variant", "rank", "vec_id", "score")


def union_hits(hits: DataFrame, prefix: int = 50, cap: int = MAX_DOCS) -> DataFrame:
    """Each question's hits (qid, variant, rank, source, text, ...) in order; of a source and text prefix the first stays, ``cap`` a question. Adds n."""
    key = F.concat(F.coalesce("source", F.lit("")), F.lit("_"), F.substring("text", 1, prefix))
    first = Window.partitionBy("qid", key).orderBy("variant", "rank")
    rows = hits.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("variant", "rank"))).filter(F.col("n") <= cap)


def cited_contexts(docs: DataFrame) -> DataFrame:
    """(qid, context, n_docs) of documents (qid, n, text, file_name and optionally folder_path, page_number, last_modified), a bounded number a question."""
    optional = [F.col(c).cast("string") if c in docs.columns else None for c in ("folder_path", "page_number", "last_modified")]
    block = F.concat(retrieval.citation(F.col("n"), F.col("file_name"), *optional), F.lit("\n"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("n", block.alias("b"))))
    return docs.groupBy("qid").agg(F.array_join(F.transform(rows, lambda x: x["b"]), "\n\n---\n\n").alias("context"), F.count(F.lit(1)).alias("n_docs"))


class Retriever:
    """A store (vec_id, embedding, text, source) with its embedder: questions to their k best rows."""

    def __init__(self, store: DataFrame, embed: Embedder, dim: int, k: int = OWN_HITS):
        self.store, self.embed, self.dim, self.k = store, embed, dim, k

    def invoke(self, questions: DataFrame) -> DataFrame:
        """(qid, rank, vec_id, score, text, source) for questions (qid, question)."""
        asked = questions.select("qid", self.embed(F.col("question"), self.dim).alias("embedding"))
        hits = vector.batch_top_k(self.store.select("vec_id", "embedding"), asked, self.k)
        return hits.join(self.store.select("vec_id", "text", "source"), "vec_id").select("qid", "rank", "vec_id", "score", "text", "source")
