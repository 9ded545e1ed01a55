"""Operator 8, benchmark decontamination, in DataFrame and SQL functions only.

Windows of a document, each as many words long as the item it is held against, get a 64-bit SimHash of their
weighted 5-word shingles (weight: letters and digits in it). Fingerprints are cut into BLOCKS blocks; of two within
RADIUS = BLOCKS * (FLIPS + 1) - 1 bits, one block at least differs in FLIPS bits or fewer. So each item is entered under every
value within FLIPS bits of each of its blocks, and the join on (length, block, value) finds all windows within RADIUS. Unrelated
fingerprints meet in 21 cases of 100 (blocks of equal bits alone would have to be two bits wide, and nearly all would meet).
Those pairs are verified by the exact weighted similarity 2 * shared / (window + item) of shingle sets.

Which windows are cut is decided without loss: a window that reaches the similarity shares more than
2/3 of the item's weight, so it holds one of any shingles that weigh over 1/3 of the item together. Those seeds are
looked up in one pass over the documents; only documents with a hit are read again. There every window that holds a
seed is tried, whatever its start, and cut if the item's shingles in it weigh those 2/3. Insertions, losses and
changes of order therefore lose nothing; what can be missed is a pair beyond RADIUS.

Defined cases: null or blank texts and items match nothing; an item (and a window) of fewer than five words has
one shingle, the whole sequence; a document shorter than the item is one window; equal rows and
repeated ids, null ones too, give one result row per (doc_id, item_id), but are judged text by text: of two texts of one id only those that hold an item go; an empty side gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import column, columns_of, free_name, materialize

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at the similarity differs in 13 of 64 bits on average, with a standard deviation of 3.2.
BLOCKS, FLIPS = 5, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
_EDGES = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
#: A side of a join that grows with the benchmark is broadcast only up to so many counted rows; beyond, Spark chooses the join.
MAX_BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def shingle_hashes(words: str, width: int) -> Column:
    """Hash of each run of ``width`` words of the array column ``words``; empty if there are fewer."""
    w = F.col(words)
    return F.when(
        F.size(w) >= width,
        F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _weighted(words: str, start: str, count: str, width: str) -> Column:
    """Distinct (h, w) of the shingles of words[start : start + count]."""
    one = "xxhash64({}) as h, cast({} as int) as w"
    cases = " ".join(
        f"when {width} = {k} then struct({one.format(', '.join(f'get({words}, i + {j})' for j in range(k)), ' + '.join(f'length(get({words}, i + {j}))' for j in range(k)))})" for k in range(1, SHINGLE + 1)
    )
    last = f"least({start} + {count}, size({words})) - {width}"
    return F.expr(f"case when {last} >= {start} then array_distinct(transform(sequence({start}, {last}), i -> case {cases} end)) else cast(array() as array<struct<h:bigint,w:int>>) end")


_FINGERPRINT = """aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft(
    case when aggregate({s}, 0L, (t, x) -> t + case when shiftright(x.h, b) & 1L = 1L then x.w else -x.w end) > 0 then 1L else 0L end, b))"""


def fingerprint(shingles: str) -> Column:
    return F.expr(_FINGERPRINT.format(s=shingles))


def weight(shingles: str) -> Column:
    return F.expr(f"aggregate({shingles}, 0L, (t, x) -> t + x.w)")


def _values(fp: str) -> list[tuple[int, Column]]:
    """(bits, value) of each block of a fingerprint."""
    return [(b - a, F.expr(f"shiftrightunsigned({fp}, {a}) & {2 ** (b - a) - 1}L")) for a, b in zip(_EDGES[:-1], _EDGES[1:], strict=True)]


def _blocks(fp: str) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("block"), v.alias("value")) for k, (_, v) in enumerate(_values(fp))])


def _neighbours(fp: str) -> Column:
    """(block, value) within FLIPS bits of each block."""

    def near(k: int, bits: int, value: Column) -> Column:
        flips = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(2**bits - 1).cast("long")), lambda m: F.bit_count(m) <= FLIPS)
        return F.transform(flips, lambda m: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*[near(k, *x) for k, x in enumerate(_values(fp))]))


#: Values that an item is entered under.
NEIGHBOURS = sum(math.comb(b - a, k) for a, b in zip(_EDGES[:-1], _EDGES[1:], strict=True) for k in range(FLIPS + 1))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), width, s (weighted shingles), weight, fp."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w"))
    items = materialize(items).filter(F.size("w") > 0).select("item_id", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("width"), F.lit(0).alias("zero"))
    # Written in between, so that no step's array is computed again for each element of the next.
    items = materialize(items.withColumn("s", _weighted("w", "zero", "n", "width")))
    return items.select("item_id", "n", "width", "s", "w", weight("s").alias("weight"), fingerprint("s").alias("fp"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def _cuts(held: DataFrame, items: DataFrame, n_items: int, similarity: float) -> DataFrame:
    """(row, n, width, start) of the windows that hold a seed of an item and enough weight of the item's shingles.

    A shingle counts each time it occurs, so the weight is the shared one at least.
    """
    own = items.select("item_id", "n", "weight", F.map_from_entries("s").alias("own"))
    rows = held.select("row", "w", F.explode("places").alias("p")).select("row", "w", "p.*").join(_small(own, n_items), ["item_id", "n"])
    # A window of fewer than five words starts at its only shingle.
    short = rows.filter(F.col("width") < SHINGLE).select("row", "n", "width", F.explode("at").alias("start"))
    weights = F.transform(shingle_hashes("w", SHINGLE), lambda h: F.coalesce(F.try_element_at("own", h), F.lit(0)))
    rows = materialize(rows.filter(F.col("width") == SHINGLE).select("row", "n", "width", "at", "weight", F.size("w").alias("size"), weights.alias("m")))
    around = f"sequence(greatest(0, p - n + {SHINGLE}), greatest(0, least(p, size - n)))"
    starts = F.expr(f"array_distinct(flatten(transform(at, p -> {around})))")
    shared = f"aggregate(slice(m, x + 1, n - {SHINGLE - 1}), 0L, (t, v) -> t + v)"
    enough = F.expr(f"filter(starts, x -> {shared} * {2 - similarity!r} >= {similarity!r} * weight - 1e-6)")
    rows = materialize(rows.withColumn("starts", starts)).select("row", "n", "width", F.explode(enough).alias("start"))
    return short.unionByName(rows)


def _row() -> Column:
    """What tells texts of one doc_id, or of none, apart; equal rows are alike."""
    return F.xxhash64("doc_id", "text")


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(row, doc_id, item_id, start, n_words, hamming, similarity): the best window of each text and item that match."""
    items = materialize(materialize(items_of(benchmark)).dropDuplicates(["item_id", "fp", "n", "weight"]))
    sizes = {r["width"]: r["n"] for r in items.groupBy("width").agg(F.sum(F.size("s")).alias("n")).collect()}  # five rows at most
    n_items = items.count()
    docs = docs.select(_row().alias("row"), "doc_id", "text")
    # Seeds: the heaviest shingles until they weigh over (2 - 2 s) / (2 - s) of the item, 1/3 at 0.8.
    spare = (2 - 2 * similarity) / (2 - similarity)
    hits = None
    for width, count in sorted(sizes.items()):
        own = items.filter(F.col("width") == width).withColumn("g", shingle_hashes("w", width))
        chosen = F.expr("""aggregate(array_sort(transform(s, x -> struct(-x.w as k, x.h as h))), cast(named_struct('t', 0L, 'hs', array()) as struct<t:bigint,hs:array<bigint>>),
            (a, x) -> case when a.t <= {} * weight then named_struct('t', a.t - x.k, 'hs', array_append(a.hs, x.h)) else a end).hs""".format(repr(spare)))
        seeds = own.withColumn("c", chosen).select("item_id", "n", "c", F.posexplode("g").alias("at", "h")).filter(F.array_contains("c", F.col("h"))).select("item_id", "n", "at", "h")
        found = docs.select("row", words_of(F.col("text")).alias("w")).withColumn("g", shingle_hashes("w", width)).select("row", F.size("w").alias("size"), F.posexplode_outer("g").alias("pos", "h"))  # outer: else Spark infers size(g) > 0 and computes g once more, below
        found = found.join(_small(seeds, count), "h")
        found = found.select("row", "item_id", "n", F.lit(width).alias("width"), "pos")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = docs.select("row", F.lit(0).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("n"), F.lit(1).alias("width"), F.lit(0).alias("pos")).filter("false")
    places = hits.groupBy("row", "item_id", "n", "width").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    places = places.groupBy("row").agg(F.collect_list(F.struct("item_id", "n", "width", "at")).alias("places"))
    # Documents with hits grow with the corpus: a merge join at every size.
    held = materialize(docs.hint("merge").join(places, "row").select("row", "doc_id", words_of(F.col("text")).alias("w"), "places"))
    cuts = materialize(_cuts(held, items, n_items, similarity).distinct()).groupBy("row").agg(F.collect_list(F.struct("n", "width", "start")).alias("cuts"))
    windows = held.select("row", "w").hint("merge").join(cuts, "row")
    windows = windows.select("row", "w", F.explode("cuts").alias("c")).select("row", "w", "c.*").withColumn("s", _weighted("w", "start", "n", "width")).drop("w")
    windows = materialize(windows.select("row", "n", "start", "s"))
    windows = materialize(windows.filter(F.size("s") > 0).withColumn("fp", fingerprint("s")))
    near = windows.select("row", "n", "start", "fp", F.explode(_blocks("fp")).alias("b")).select("row", "n", "start", "fp", "b.*")
    targets = items.select("item_id", "n", F.col("fp").alias("item_fp"), F.explode(_neighbours("fp")).alias("b")).select("item_id", "n", "item_fp", "b.*")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = near.join(_small(targets, n_items * NEIGHBOURS), ["n", "block", "value"]).filter(distance <= RADIUS).select("row", "n", "start", "fp", "item_id", "item_fp", distance.alias("hamming")).distinct()
    sets = items.select("item_id", "n", F.col("fp").alias("item_fp"), F.col("s").alias("item_s"), F.col("weight").alias("item_weight"))
    pairs = near.join(windows, ["row", "n", "start", "fp"]).join(_small(sets, n_items), ["item_id", "n", "item_fp"])
    shared = F.expr("aggregate(array_intersect(s, item_s), 0L, (t, x) -> t + x.w)")
    pairs = pairs.withColumn("similarity", 2 * shared / (weight("s") + F.col("item_weight"))).filter(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n", "hamming")).alias("b")
    pairs = pairs.groupBy("row", "item_id").agg(best).join(held.select("row", "doc_id").distinct(), "row")
    return pairs.select("row", "doc_id", "item_id", (-F.col("b.back")).alias("start"), F.col("b.n").alias("n_words"), "b.hamming", "b.similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, n_words, hamming, similarity): the best window of each document and item that match, null ids together."""
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words", "hamming")).alias("b")
    by = matches(docs, benchmark, similarity).groupBy("doc_id", "item_id").agg(best)
    return by.select("doc_id", "item_id", (-F.col("b.back")).alias("start"), "b.n_words", "b.hamming", "b.similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no benchmark item; same columns."""
    name = free_name(docs, "_leak")
    leaks = matches(docs, benchmark, similarity).select(F.col("row").alias(name)).distinct()
    return docs.hint("merge").join(leaks, _row() == column(name), "left_anti").select(*columns_of(docs))
