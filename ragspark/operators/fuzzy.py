"""Fuzzy best match (JOIN-01, SCA-10): for each question the most similar stored text, by an inverted index of q-grams.

A text's tokens are its characters and its pairs of neighbouring characters, each with the number of its occurrence, so that sets of
tokens count as multisets. Texts of a given similarity share a least number of tokens (``Measure``). So only the rarest tokens of each text
are indexed, ``MEETINGS`` more than may be missing: two texts that are similar enough meet at that many of these at least, and only those that
do are compared. Where a pair of lengths is so short that it need not share any pair of characters, single characters are the tokens.

The similarity asked for falls in steps (``STEPS``), the last being the threshold. A question that has a match at a step is done: every text as
similar as that has been met, so its best match is among them. Only the others go on to a weaker filter and longer lists.

Where the measure counts edits, texts of up to ``SHORT`` characters are first looked up by what is left of them without 0, 1 and 2 characters, which tells
more than any token where texts are much alike; a question is done when no text further away can be as similar as what it met.

Keys of the index are a token and a band of lengths. Lists longer than ``LIST`` are split, and questions go to each part.
Equal texts are one entry, so copies neither lengthen lists nor are scored again.

Texts are compared in lower case. Null and empty texts match nothing. Of equal ratios the smallest key wins. Ratios are rounded to
``DIGITS`` places, and a rounded ratio at the threshold is a match.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.tables import discard, materialize, partitions

STEPS = (0.95, 0.9, 0.8)
#: Shared rare tokens that make a pair a candidate, or as many as it has to share, if fewer.
MEETINGS = 4
#: Stored texts of one key before its list is split.
LIST = 2_000
DIGITS = 6
#: Ratios this much below a step may round to it.
_SLACK = 10.0**-DIGITS


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity by matching blocks of the lower-cased strings."""
    return pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return 1 - F.levenshtein(F.lower(a), F.lower(b)) / longest


def sequence_ratio_from(a: Column, b: Column, least: float) -> Column:
    """The ratio where it may reach ``least``, else 0: cheap upper bounds go first."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float:
            m = difflib.SequenceMatcher(None, x, y)
            return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio(a, b)


#: Edits that are looked for first, by texts with as many characters left out, and the longest texts for which that is done.
EDITS, SHORT = 2, 48
#: Hashes of such texts that a task makes, unless there are more than all tasks' share.
TASK = 200_000


class Measure(NamedTuple):
    """What a similarity of at least t needs of texts of lengths x and y.

    ``size`` of the pair; ``reach``: the shorter length is at least this share of the longer; ``pairs`` and ``singles``: of
    size, how many pairs of characters, less 1, and how many characters are shared at least; ``edits``: whether it counts edits.
    """

    score: Callable[[Column, Column, float], Column]
    size: Callable[[Column, Column], Column]
    least_size: Callable[[float], float]
    reach: Callable[[float], float]
    pairs: Callable[[float], float]
    singles: Callable[[float], float]
    edits: bool = False


#: 2 * M / (x + y) with M characters in B blocks. Between blocks a character is unmatched, so B <= 1 + x + y - 2 * M, and M - B pairs are shared.
SEQUENCE = Measure(sequence_ratio_from, lambda x, y: x + y, lambda t: 2 / (2 - t), lambda t: t / (2 - t), lambda t: 1.5 * t - 1, lambda t: t / 2)
#: 1 - d / max(x, y): each of d edits costs the longer text two pairs or one character at most.
LEVENSHTEIN = Measure(lambda a, b, t: levenshtein_ratio(a, b), lambda x, y: F.greatest(x, y), lambda t: 1.0, lambda t: t, lambda t: 2 * t - 1, lambda t: t, True)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(texts: pd.Series) -> pd.Series:
    """Characters, marked 1, and pairs of characters, marked 2, each with the number of its occurrence."""

    def of(text: str) -> list[str]:
        seen: Counter[str] = Counter()
        out = []
        for token in [f"1{c}" for c in text] + [f"2{text[i : i + 2]}" for i in range(len(text) - 1)]:
            seen[token] += 1
            out.append(f"{token}{seen[token]}")
        return out

    return texts.map(of)


def _dealt(rows: DataFrame) -> DataFrame:
    """For joins by a shuffle. Spark goes by the size of the compressed file, without what arrays add, and would send millions of rows through the driver."""
    return rows.hint("merge")


def _indexed(texts: DataFrame, frequency: DataFrame) -> DataFrame:
    """(id, text, n, kind, tokens): the tokens of each kind, those of the fewest stored texts first."""
    each = texts.select("id", F.explode(_tokens("text")).alias("token")).join(frequency, "token", "left")
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")))
    sets = each.groupBy("id", F.substring("token", 1, 1).alias("kind")).agg(F.transform(ranked, lambda x: x["token"]).alias("tokens"))
    return texts.join(_dealt(sets), "id")


def _short(measure: Measure, t: float) -> float:
    """Texts of this length or less need not share a pair of characters with all texts in reach."""
    return 1 / (measure.pairs(t) * measure.least_size(t)) if measure.pairs(t) > 0 else float("inf")


def _postings(texts: DataFrame, measure: Measure, t: float) -> DataFrame:
    """(id, n, kind, token, at, size, meet): the rarest tokens, at ``meet`` of which any text of similarity t is met; at counts from 0."""
    short, least = _short(measure, t), F.col("n") * measure.least_size(t)
    twos, ones = F.ceil(least * measure.pairs(t) - 1 - 1e-9), F.ceil(least * measure.singles(t) - 1e-9)
    used = F.when(F.col("kind") == "2", F.col("n") > short).otherwise(F.col("n") * measure.reach(t) <= short)
    need = F.greatest(F.lit(1), F.when(F.col("kind") == "2", twos).otherwise(ones))
    meet = F.least(need, F.lit(MEETINGS)).cast("int")
    rarest = F.slice("tokens", F.lit(1), F.greatest(F.lit(0), F.size("tokens") - need + meet).cast("int"))
    return texts.filter(used).select("id", "n", "kind", F.size("tokens").alias("size"), meet.alias("meet"), F.posexplode(rarest).alias("at", "token"))


def candidates(questions: DataFrame, stored: DataFrame, measure: Measure, t: float, longest: int = LIST) -> DataFrame:
    """(q, s): ids of all pairs of indexed texts that may have similarity t or more."""
    reach, short = measure.reach(t), _short(measure, t)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-_log(reach))).cast("int")
    right = _postings(stored, measure, t).withColumn("band", band)
    left = _postings(questions, measure, t).withColumn("band", F.explode(F.array(*[band + d for d in (-1, 0, 1)])))
    # At most one key for every LIST postings.
    long_ = right.groupBy("token", "band").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > longest).select("token", "band", F.ceil(F.col("c") / longest).cast("int").alias("parts"))
    right = right.join(long_, ["token", "band"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    left = left.join(long_, ["token", "band"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    x, y = left.alias("x"), right.alias("y")
    size = measure.size(F.col("x.n"), F.col("y.n"))
    need = F.when(F.col("x.kind") == "2", size * measure.pairs(t) - 1).otherwise(size * measure.singles(t))
    # Shared tokens by their places: those before, this one, those after.
    most = F.least("x.at", "y.at") + F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    lengths = F.least("x.n", "y.n") >= reach * F.greatest("x.n", "y.n") - 1e-9
    # A pair meets by tokens of one kind only.
    kinds = (F.col("x.kind") == "2") | (F.least("x.n", "y.n") <= F.lit(short))
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.part") == F.col("y.part")) & lengths & kinds & (most >= need - 1e-9)
    met = x.join(_dealt(y), on).groupBy(F.col("x.id").alias("q"), F.col("y.id").alias("s")).agg(F.count(F.lit(1)).alias("c"), F.max(F.least("x.meet", "y.meet")).alias("meet"))
    return met.filter(F.col("c") >= F.col("meet")).select("q", "s")


def _left_out(texts: DataFrame, edits: int) -> DataFrame:
    """(id, h): hashes of the texts with up to so many characters left out, from left to right.

    Of equal neighbours the first is left out. So the same is hardly left twice, and nothing is lost: what is left of a text can be taken from
    its rightmost places, and then no character that is left out equals the one before it.
    """
    rows = texts.select("id", F.col("text").alias("t"), F.lit(1).alias("at"))
    length, i = F.length("t"), F.col("i")
    for _ in range(edits):
        # Place 0 leaves the text as it is, and nothing more is left out.
        places = F.when(F.col("at") <= length, F.sequence("at", length)).otherwise(F.array().cast("array<int>"))
        rows = rows.select("id", "t", F.explode(F.concat(F.array(F.lit(0)), places)).alias("i"))
        rows = rows.filter((i < 2) | (F.substring("t", i, F.lit(1)) != F.substring("t", i - 1, F.lit(1))))
        left = F.when(i > 0, F.concat(F.substring("t", F.lit(1), i - 1), F.substring("t", i + 1, length))).otherwise(F.col("t"))
        rows = rows.select("id", left.alias("t"), F.when(i > 0, i).otherwise(length + 1).alias("at"))
    return rows.select("id", F.xxhash64("t").alias("h"))


def _near(questions: DataFrame, stored: DataFrame, edits: int) -> DataFrame:
    """(q, s): ids of all pairs of different texts that are so many edits apart or fewer, and of some others; questions (id, text, n) have SHORT characters at most.

    Such texts are equal after leaving out so many characters of each. A text has hundreds of hashes, which Spark does not foresee:
    texts are dealt out by their number, as a small table is one task's, and hashes meet by a shuffle, not in the driver.
    """

    def of(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.filter(F.col("n") <= SHORT + edits).select("id", "text", "n")
        hashes = rows.agg(F.coalesce(F.sum(F.pow(F.col("n") + 1, F.lit(edits)) / edits), F.lit(0))).first()[0]
        dealt = rows.repartition(max(1, min(partitions(rows.sparkSession), round(hashes / TASK))))
        return _left_out(dealt, edits).select(F.col("id").alias(name), "h")

    return of(questions, "q").join(_dealt(of(stored, "s")), "h").filter(F.col("q") != F.col("s")).select("q", "s").distinct()


def _log(x: float) -> float:
    import math

    return math.log(min(x, 0.999))


def best_match(questions: DataFrame, stored: DataFrame, threshold: float = 0.7, measure: Measure = SEQUENCE, others_only: bool = False, steps: tuple[float, ...] = STEPS, longest: int = LIST) -> DataFrame:
    """(qid, key, ratio): the best stored (key, stored_question) of each (qid, question) at the threshold or above; the smallest key wins ties.

    With ``others_only`` a question is not matched with the key that equals its qid.
    """
    low = F.lower("t")
    asked = questions.select("qid", F.col("question").alias("t")).filter(F.length("t") > 0).select("qid", low.alias("text"))
    kept = materialize(stored.select("key", F.col("stored_question").alias("t")).filter(F.length("t") > 0).select("key", low.alias("text")).distinct())
    asked = materialize(asked.distinct())
    # Ids are written once, so that a lost task cannot deal them anew.
    texts = materialize(asked.select("text", F.lit(True).alias("mine")).unionByName(kept.select("text", F.lit(False).alias("mine"))).groupBy("text").agg(F.bool_or("mine").alias("asked"), F.bool_or(~F.col("mine")).alias("stored")).select(F.monotonically_increasing_id().alias("id"), "*", F.length("text").alias("n")))
    indexed: DataFrame | None = None
    # The two smallest keys of a text: a question has to pass over one at most.
    few = Window.partitionBy("text").orderBy("key")
    keys = kept.withColumn("_n", F.row_number().over(few)).filter("_n <= 2").drop("_n")
    keys = materialize(texts.filter("stored").select("id", "text").join(_dealt(keys), "text").select(F.col("id").alias("s"), "key"))
    open_ = materialize(asked.join(_dealt(texts.select("id", "text", "n")), "text").select("qid", "id", "n"))
    found, done = [], [kept, asked]

    def step(pairs: DataFrame, t: float, settled: Column | None) -> None:
        """Take the best of the pairs that reach t; only questions for which that settles it are done."""
        nonlocal open_
        pairs = pairs.join(_dealt(texts.select(F.col("id").alias("q"), F.col("text").alias("a"))), "q").join(_dealt(texts.select(F.col("id").alias("s"), F.col("text").alias("b"))), "s")
        scored = pairs.select("q", "s", F.round(measure.score(F.col("a"), F.col("b"), t - _SLACK), DIGITS).alias("ratio")).filter(F.col("ratio") >= t)
        best = scored.join(_dealt(keys), "s").groupBy("q", "key").agg(F.max("ratio").alias("ratio"))
        first = Window.partitionBy("q").orderBy(F.desc("ratio"), "key")
        best = best.withColumn("_n", F.row_number().over(first)).filter("_n <= 2").drop("_n")
        own = Window.partitionBy("qid").orderBy(F.desc("ratio"), "key")
        met = open_.join(_dealt(best), F.col("id") == F.col("q"))
        met = met.filter(F.col("key") != F.col("qid")) if others_only else met
        met = met if settled is None else met.filter(settled)
        now = materialize(met.withColumn("_n", F.row_number().over(own)).filter("_n = 1").select("qid", "key", "ratio"))
        found.append(now)
        left = materialize(open_.join(_dealt(now.select("qid")), "qid", "left_anti"))
        done.append(open_)
        open_ = left

    n = F.col("n")
    for edits in range(EDITS + 1) if measure.edits else []:
        # Texts of n characters with so many edits are nearer than any with one more, whatever the longer text's length, if d * (d + 1) < n.
        mine = texts.join(_dealt(open_.select("id").distinct()), "id", "left_semi").filter((n > edits * (edits + 1)) & (n <= SHORT))
        pairs = _near(mine, texts.filter("stored"), edits) if edits else mine.filter("stored").select(F.col("id").alias("q"), F.col("id").alias("s"))
        step(pairs, threshold, F.round(F.lit(1.0) - F.lit(float(edits)) / n, DIGITS) <= F.col("ratio"))
        if open_.isEmpty():
            break
    # A question of this many characters is now known to have no text within EDITS.
    near = (n > EDITS * (EDITS + 1)) & (n <= SHORT) if measure.edits else F.lit(False)
    for t in [s for s in steps if s > threshold] + [threshold]:
        if found and open_.isEmpty():
            break
        may = texts.join(_dealt(open_.select("id").distinct()), "id", "left_semi").filter("asked").filter(~(near & (1 - F.lit(EDITS + 1.0) / (n + EDITS + 1) < t - _SLACK)))
        if found and may.isEmpty():
            continue
        if indexed is None:
            frequency = texts.filter("stored").select(F.explode(_tokens("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
            indexed = materialize(_indexed(texts, frequency))
            done.append(indexed)
        step(candidates(indexed.join(_dealt(may.select("id")), "id", "left_semi"), indexed.filter("stored"), measure, t - _SLACK, longest), t, None)
    discard(*done, open_, keys, texts)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
