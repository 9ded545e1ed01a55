"""Operator 13, ranked lexical search over a tiered index.

Terms are runs of letters, digits and characters beyond ASCII, ASCII capitals folded. A document's score for an item sums, over the
item's terms with repeats, w * ((SCALE * tf) div (1000 * tf + 8 * m)): w the term's weight by its document frequency, m by the document's length.

The index holds the terms that a block of items asks for: for each document its terms of these, how often they occur, and the document's length.
It has one tier for each share of ``TIERS`` and one with everything. A tier holds, of each term, the postings of the highest impact (the factor beside
w); which they are is read off a histogram of each term's impacts, and the highest impact left out is the term's residual bound in that tier.

A search reads the first tier. There it gets the k-th best partial score of each item; an item is proven if the
residual bounds of its terms together are strictly below that score, so that no document outside the tier can reach it. Documents whose partial score
with the residuals of what they lack reaches the k-th are then scored in full. Items without that proof go to the next tier, and at last
to the full one, where nothing is left out. So results are exact for every item; the tiers only decide what is read for it.

Items are searched by their distinct texts, in blocks whose text is bounded, each block against all documents. Tasks hold one block's terms and weights and
pass on k documents an item. No posting is shuffled: only term statistics and those results are.

Defined cases: null texts have no terms; documents without terms do not count; items without terms, or none of whose terms a document with a
weight above 0 holds, have no rows; every row of items is ranked, repeated ones too; so is every row of documents; of equal scores the smaller doc_id
comes first, a null doc_id before all; rows equal in both are in any order; empty tables give an empty table. doc_id is an integer.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize
from .terms import WORDS_AND_DIGITS, terms_of

K = 10
SCALE = 1_000_000_000
#: (share, least number) of each term's postings in the tiers above the full one, highest impacts first.
TIERS = ((1 / 16, 256), (1 / 4, 2_048))
#: Items of a block: bytes of text and number at most, both by hash, so about.
BLOCK_BYTES, BLOCK_ITEMS = 1_000_000, 2_000
#: Impacts are below 1,000,000; the histogram has cells of this width.
CELL = 4_000
#: Documents scored at once, by the number of items.
CELLS_AT_ONCE = 1_000_000
_LEAST = np.iinfo(np.int64).min


class Queries(NamedTuple):
    """Items as rows of a matrix by term: the entries of term t are those from starts[t] on, item and number of repeats of each."""

    n_items: int
    starts: np.ndarray
    item: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, items: list[list[int]], n_terms: int) -> Queries:
        entries = sorted((t, i, c) for i, terms in enumerate(items) for t, c in Counter(terms).items())
        t, i, c = np.array(entries, np.int64).reshape(-1, 3).T
        return cls(len(items), np.searchsorted(t, np.arange(n_terms + 1)), i, c)

    def total(self, bound: np.ndarray) -> np.ndarray:
        """The sum of a bound of each term over each item's terms."""
        out = np.zeros(self.n_items, np.int64)
        np.add.at(out, self.item, np.repeat(bound, np.diff(self.starts)) * self.times)
        return out

    def only(self, items: np.ndarray) -> Queries:
        """The same with no entries but those of some items."""
        keep = np.isin(self.item, items)
        return Queries(self.n_items, np.append(0, np.cumsum(keep))[self.starts], self.item[keep], self.times[keep])


def _tokenised(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text, WORDS_AND_DIGITS)
                if words:
                    found = Counter(filter(vocabulary.__contains__, words))
                    ids.append(doc_id)
                    ns.append(len(words))
                    terms.append([vocabulary[t] for t in found])
                    tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return run


class Postings(NamedTuple):
    """A batch of the index: the place of its document, term and impact of each posting."""

    at: np.ndarray
    doc_id: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    impact: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, n_docs: int, n_terms: int) -> Postings:
        at, ids, n = (batch.column(i) for i in range(3))
        lists, n = batch.column(3), n.to_numpy()
        doc = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
        term, tf = lists.flatten().to_numpy(), batch.column(4).flatten().to_numpy()
        m = 100 - 75 + (75 * n * n_docs) // n_terms
        return cls(at.to_numpy(), ids.fill_null(_LEAST).to_numpy(), doc, term, (SCALE * tf) // (1000 * tf + 8 * m[doc]))


def _in_tier(cut: np.ndarray, n_docs: int, n_terms: int):
    """The postings of each document whose impact is at or above the term's cut; documents without any go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = Postings.of(batch, n_docs, n_terms)
            keep = p.impact >= cut[p.term]
            count = np.bincount(p.doc[keep], minlength=batch.num_rows)
            offsets = pa.array(np.append(0, np.cumsum(count[count > 0])), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch.column(i).flatten().filter(pa.array(keep))) for i in (3, 4)]
            rows = pa.array(count > 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(rows) for i in range(3)), *lists], names=["at", "doc_id", "n", "terms", "tfs"])

    return run


def _scored(p: Postings, q: Queries, weight: np.ndarray, residual: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(first document, scores, residuals of the terms met) of runs of documents against all items."""
    step = max(1, CELLS_AT_ONCE // max(q.n_items, 1))
    for first in range(0, len(p.at), step):
        a, b = np.searchsorted(p.doc, [first, first + step])
        term, doc = p.term[a:b], p.doc[a:b] - first
        n = q.starts[term + 1] - q.starts[term]
        entry = np.repeat(q.starts[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = np.repeat(doc, n) * q.n_items + q.item[entry]
        size = (min(step, len(p.at) - first), q.n_items)
        sums = []
        for each in (p.impact[a:b] * weight[term], None if residual is None else residual[term]):
            if each is None:
                sums.append(None)
                continue
            total = np.zeros(size[0] * size[1], np.int64)
            np.add.at(total, cell, np.repeat(each, n) * q.times[entry])
            sums.append(total.reshape(size))
        yield first, *sums


def _best(q: Queries, weight: np.ndarray, k: int, n_docs: int, n_terms: int):
    """(item, doc_id, score): the k best of a task for each item, by what its rows hold."""

    def cut(rows: list[np.ndarray], least: np.ndarray) -> list[np.ndarray]:
        item, doc_id, score = rows
        order = np.lexsort((doc_id, -score, item))
        item, doc_id, score = item[order], doc_id[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == k - 1
        least[item[last]] = score[last]
        return [c[place < k] for c in (item, doc_id, score)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, held = np.ones(q.n_items, np.int64), [np.array([], np.int64)] * 3
        for batch in batches:
            p = Postings.of(batch, n_docs, n_terms)
            for first, score, _ in _scored(p, q, weight, None):
                doc, item = np.nonzero(score >= least)
                held = cut([np.concatenate(c) for c in zip(held, (item, p.doc_id[first + doc], score[doc, item]), strict=True)], least)
        ids = pa.array(held[1], pa.int64(), mask=held[1] == _LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), ids, pa.array(held[2], pa.int64())], names=["item", "doc_id", "score"])

    return run


def _reaching(q: Queries, weight: np.ndarray, residual: np.ndarray, kth: np.ndarray, n_docs: int, n_terms: int):
    """(at): documents that may reach the k-th score of an item, with the residuals of the terms they lack in this tier."""
    total = q.total(residual)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = Postings.of(batch, n_docs, n_terms)
            for first, score, met in _scored(p, q, weight, residual):
                reach = ((score > 0) & (score + total - met >= kth)).any(1)
                yield pa.RecordBatch.from_arrays([pa.array(p.at[first : first + len(reach)][reach], pa.int64())], names=["at"])

    return run


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """Spark cuts each task's rows to k an item before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class TieredIndex:
    """Written tables: the documents' postings of a vocabulary, and those of each tier; cuts and residual bounds are arrays by term."""

    def __init__(self, docs: DataFrame, vocabulary: dict[bytes, int], tiers: tuple[tuple[float, int], ...] = TIERS):
        texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        rows = texts.mapInArrow(_tokenised(vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>")
        self.full = materialize(rows.select(F.monotonically_increasing_id().alias("at"), "*"))
        self.n_docs, self.n_terms = (x or 0 for x in self.full.agg(F.count(F.lit(1)), F.sum("n")).first())
        #: One row for each term of the vocabulary.
        df, cuts, residuals = self._statistics(len(vocabulary), tiers)
        self.weight = np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        self.residual = [r * self.weight for r in residuals] + [np.zeros(len(df), np.int64)]
        self.tiers = [materialize(self._postings().mapInArrow(_in_tier(cut, self.n_docs, self.n_terms), self.full.schema)) for cut in cuts] + [self.full]

    def _postings(self) -> DataFrame:
        return self.full.filter(F.size("terms") > 0)

    def _statistics(self, size: int, tiers: tuple[tuple[float, int], ...]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Document frequency of each term, and for each tier its least impact and the highest impact below that."""
        df, cuts, residuals = np.zeros(size, np.int64), [np.zeros(size, np.int64) for _ in tiers], [np.zeros(size, np.int64) for _ in tiers]
        if not self.n_docs:
            return df, cuts, residuals
        each = self._postings().select("n", F.inline(F.arrays_zip("terms", "tfs")))
        m = F.call_function("div", 75 * F.col("n") * F.lit(self.n_docs), F.lit(self.n_terms)) + 25
        impact = F.call_function("div", SCALE * F.col("tfs"), 1000 * F.col("tfs") + 8 * m)
        cells = each.select("terms", impact.alias("impact")).groupBy("terms", F.call_function("div", F.col("impact"), F.lit(CELL)).alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.max("impact").alias("most"))
        highest_first = Window.partitionBy("terms").orderBy(F.desc("cell"))
        above = F.coalesce(F.sum("c").over(highest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = cells.select("*", above.alias("above"), F.sum("c").over(Window.partitionBy("terms")).alias("df"))
        of = []
        for share, least in tiers:
            inside = F.col("above") < F.greatest(F.lit(least), F.ceil(F.col("df") * share))
            of += [F.min(F.when(inside, F.col("cell"))).cast("long") * CELL, F.coalesce(F.max(F.when(~inside, F.col("most"))), F.lit(0))]
        for r in cells.groupBy("terms").agg(F.first("df"), *of).toLocalIterator():
            df[r[0]] = r[1]
            for i in range(len(tiers)):
                cuts[i][r[0]], residuals[i][r[0]] = r[2 + 2 * i], r[3 + 2 * i]
        return df, cuts, residuals

    def search(self, items: list[list[int]], k: int, proven: list[int] | None = None) -> DataFrame:
        """(item, doc_id, score, rank), item being the place in items; ``proven`` receives the number of items that each tier has proven."""
        every, found, n = Queries.of(items, len(self.weight)), [], (self.n_docs, self.n_terms)
        open_ = np.array([i for i, terms in enumerate(items) if terms], np.int64)
        for tier, residual in zip(self.tiers, self.residual, strict=True):
            q = every.only(open_)
            best = _ranked(tier.filter(F.size("terms") > 0).mapInArrow(_best(q, self.weight, k, *n), "item int, doc_id long, score long"), k)
            if tier is self.full:
                found.append(best)
                proven is None or proven.append(len(open_))
                break
            kth = np.zeros(q.n_items, np.int64)
            for r in best.filter(F.col("rank") == k).select("item", "score").collect():  # one row an item of the block
                kth[r[0]] = r[1]
            done = open_[q.total(residual)[open_] < kth[open_]]
            proven is None or proven.append(len(done))
            if len(done):
                q = every.only(done)
                # Items outside this search are out of reach.
                bar = np.full(q.n_items, np.iinfo(np.int64).max)
                bar[done] = kth[done]
                at = tier.mapInArrow(_reaching(q, self.weight, residual, bar, *n), "at long")
                # A document is one row of its tier; a semi-join, so that nothing is met twice.
                full = self.full.join(at, "at", "left_semi").select(*self.full.columns)
                found.append(_ranked(full.mapInArrow(_best(q, self.weight, k, *n), "item int, doc_id long, score long"), k))
            open_ = np.setdiff1d(open_, done)
            if not len(open_):
                break
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def discard(self) -> None:
        discard(*self.tiers)


def _blocks(items: DataFrame) -> Iterator[list[str]]:
    """The distinct texts of items, a bounded part at a time."""
    texts = materialize(items.filter(F.col("text").isNotNull()).select("text").distinct())
    size, n = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    blocks = max(1, -(-(size or 0) // BLOCK_BYTES), -(-n // BLOCK_ITEMS))
    for b in range(blocks if n else 0):
        yield [r["text"] for r in texts.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()]
    discard(texts)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, tiers: tuple[tuple[float, int], ...] = TIERS, told: Callable[[list[int]], None] | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents (doc_id, text) of each row of items (item_id, text)."""
    spark, parts = docs.sparkSession, []
    for texts in _blocks(items):
        words = [terms_of(t.encode(), WORDS_AND_DIGITS) for t in texts]
        vocabulary = {t: i for i, t in enumerate(sorted({t for w in words for t in w}))}
        if not vocabulary:
            continue
        index, proven = TieredIndex(docs, vocabulary, tiers), []
        found = index.search([[vocabulary[t] for t in w] for w in words], k, proven)
        names = spark.createDataFrame(list(enumerate(texts)), "item int, text string")
        parts.append(materialize(found.join(names, "item").select("text", "rank", "doc_id", "score")))
        index.discard()
        told is None or told(proven)
    if not parts:
        return items.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return items.select("item_id", "text").join(out, "text").select("item_id", "rank", "doc_id", "score")
