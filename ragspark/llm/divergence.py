"""Operator 11, source divergence audit: how far each source's use of words is from its language and from its other sources.

Each language keeps the terms that at least ``MIN_DOCS`` of its documents hold. Every group (lang, source) gives each of the V
kept terms p = 1 + floor(SCALE * (count + 1) / (N + V)), N its count of all of them. p against q costs f = floor((p - q)**2 / q).

* Counts leave the scan summed within a task; one shuffle by (lang, term) gives sums, document counts and postings.
* Pairs of sources. A term that neither has, or only one, costs an amount that depends on a count alone, so these are summed
  over each group's histogram of counts. What a term adds when both hold it comes from the postings: a task sums it for a
  batch of posting lists and passes on one row for each pair of sources, not for each term.
* Terms of a group, by upper bounds. A group's terms with p > q are put into buckets of like counts, whose largest p and
  smallest q bound f from above. Rounds evaluate the unseen buckets best bound first, for all groups at once, until
  every unseen bound is strictly below the group's k-th value; so ties at the k-th place are all seen.

All arithmetic is in 64-bit integers: exact while a group has under 9e13 occurrences.

Defined cases: null text, lang and source are ''; repeated rows count each; a group without terms, or a language without kept
terms, has its pairs (0 with V = 0) and no term rows; a language of one source has neither; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize
from .terms import WORDS, terms_of

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Distinct terms that a task holds before it passes their counts on, and pairs of postings computed at once.
HELD_TERMS, PAIRS_AT_ONCE = 400_000, 2_000_000
#: Buckets of counts for each doubling of the count.
STEPS = 8


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the rows of a task, in as few rows as ``HELD_TERMS`` allows."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), np.int32)))  # noqa: B023, E731
            columns = [same(lang), same(source), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            terms = terms_of(text, WORDS)
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from out()
    yield from out()


def _p(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total) by long division in two steps, so that no product leaves 64 bits."""
    high, low = 100_000, SCALE // 100_000
    first = (n + 1) * F.lit(high)
    quotient, rest = F.call_function("div", first, total), first % total
    return 1 + quotient * F.lit(low) + F.call_function("div", rest * F.lit(low), total)


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, value): what the terms that groups a and b both hold cost beyond what the histograms have counted, summed over a batch of postings."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    for batch in batches:
        lists = batch.column(0)
        length = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        flat = lists.flatten()
        g, p, p0 = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        names, g = np.unique(g, return_inverse=True)
        # Each posting meets those after it in its list.
        after = np.repeat(np.cumsum(length), length) - 1 - np.arange(len(g))
        start = 0
        while start < len(g):
            stop = max(start + 1, int(np.searchsorted(np.cumsum(after[start:]), PAIRS_AT_ONCE, "right")) + start)
            n = after[start:stop]
            i = np.repeat(np.arange(start, stop), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            start = stop
            if not len(i):
                continue
            keys, values = [], []
            for x, y in ((i, j), (j, i)):
                keys.append(g[x] * len(names) + g[y])
                values.append(f(p[x], p[y]) - f(p[x], p0[y]) - f(p0[x], p[y]) + f(p0[x], p0[y]))
            key, value = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            columns = [names[key[first] // len(names)], names[key[first] % len(names)], np.add.reduceat(value, first)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "value"])


def _counts(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: kept (lang, term, source, n, n_lang), and groups (g, lang, source, v, total, total_lang), one row a group."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(*named, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    by_source = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    postings = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.collect_list(F.struct("source", "n")).alias("x"))
    kept = materialize(postings.filter(F.col("docs") >= min_docs).select("lang", "term", "n_lang", F.inline("x")))
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    # A term has a row for each of its sources; its share of 1 and of n_lang come from the rows themselves.
    of_lang = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n_lang"))
    groups = rows.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    groups = groups.select("lang", "source", zero("v").alias("v"), (zero("n") + zero("v")).alias("total"), (zero("n_lang") + zero("v")).alias("total_lang"))
    return kept, materialize(groups.select(F.monotonically_increasing_id().alias("g"), "*"))


def _pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, value) of all ordered pairs of groups of one language; scored has g, lang, term, n, p, p0."""
    alone = groups.filter("v > 0").select("g", "lang", "v", _p(F.lit(0).cast("long"), F.col("total")).alias("p0"))
    other = alone.select(F.col("g").alias("b"), "lang", F.col("p0").alias("q0"))
    # The result has a row for each of these pairs.
    neither = alone.withColumnRenamed("g", "a").join(other, "lang").filter("a <> b").select("a", "b", (F.col("v") * _f(F.col("p0"), F.col("q0"))).alias("value"))
    histogram = scored.groupBy("g", "lang", "p", "p0").agg(F.count(F.lit(1)).alias("c"))
    met = histogram.join(other, "lang").filter("g <> b")
    ours = F.col("c") * (_f(F.col("p"), F.col("q0")) - _f(F.col("p0"), F.col("q0")))
    theirs = F.col("c") * (_f(F.col("q0"), F.col("p")) - _f(F.col("q0"), F.col("p0")))
    sides = F.array(F.struct(F.col("g").alias("a"), "b", ours.alias("value")), F.struct(F.col("b").alias("a"), F.col("g").alias("b"), theirs.alias("value")))
    one = met.select(F.inline(sides)).groupBy("a", "b").agg(F.sum("value").alias("value"))
    lists = scored.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "p0")).alias("x")).filter(F.size("x") > 1).select("x")
    both = lists.mapInArrow(_both, "a long, b long, value long")
    empty = groups.filter("v = 0").select(F.col("g").alias("a"), "lang").join(groups.select(F.col("g").alias("b"), "lang"), "lang").filter("a <> b").select("a", "b", F.lit(0).cast("long").alias("value"))
    return neither.unionByName(one).unionByName(both).unionByName(empty).groupBy("a", "b").agg(F.sum("value").alias("value"))


def _first(values: DataFrame, k: int) -> DataFrame:
    """The k largest values of each group, ties by ascending term: Spark cuts each task's rows to k a group before the shuffle."""
    order = Window.partitionBy("g").orderBy(F.desc("value"), "term")
    return values.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_terms(scored: DataFrame, k: int = TOP, rounds: list[int] | None = None) -> DataFrame:
    """(g, term, value, rank): the k largest f of each group over its rows (g, term, n, p, q) with p > q, by upper bounds of count buckets.

    ``rounds`` receives the number of terms evaluated in each round.
    """
    bucket = F.floor(F.log2(F.col("n").cast("double")) * STEPS).alias("bucket")
    rows = materialize(scored.filter("p > q").select("g", bucket, "term", "p", "q"))
    stats = rows.groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("c"), _f(F.max("p"), F.min("q")).alias("bound"))
    best_first = Window.partitionBy("g").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    unseen = materialize(stats.withColumn("before", F.coalesce(F.sum("c").over(best_first), F.lit(0).cast("long"))))
    top, reach = None, k
    while True:
        now = unseen.filter(F.col("before") < reach)
        found = rows.join(now.select("g", "bucket"), ["g", "bucket"], "left_semi").select("g", "term", _f(F.col("p"), F.col("q")).alias("value"))
        if rounds is not None:
            rounds.append(found.count())
        top = materialize(_first(found if top is None else found.unionByName(top.drop("rank")), k))
        kth = top.filter(F.col("rank") == k).select("g", F.col("value").alias("kth"))
        # A group with fewer than k values so far has no bound yet.
        left = unseen.filter(F.col("before") >= reach).join(kth, "g", "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).drop("kth")
        last, unseen = unseen, materialize(left)
        discard(last)
        if unseen.isEmpty():
            discard(rows, unseen)
            return top
        reach *= 8


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language, part ``term`` the k terms that mark the source most."""
    kept, groups = _counts(docs, min_docs)
    known = kept.join(groups, ["lang", "source"])
    scored = known.select("g", "lang", "term", "n", _p(F.col("n"), F.col("total")).alias("p"), _p(F.lit(0).cast("long"), F.col("total")).alias("p0"), _p(F.col("n_lang"), F.col("total_lang")).alias("q"))
    scored = materialize(scored)
    names = groups.select("g", "lang", "source")
    pairs = _pairs(scored, groups).join(names.select(F.col("g").alias("b"), F.col("source").alias("item")), "b").withColumnRenamed("a", "g")
    order = Window.partitionBy("g").orderBy(F.desc("value"), "item")
    pairs = pairs.select("g", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = top_terms(scored, k).select("g", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return names.join(pairs.unionByName(terms), "g").select("lang", "source", "part", "item", "value", "rank")
