"""Operator 5, MinHash near-dedup with tensored banding.

Each document's set of 5-word shingles gets two small collections of min-hashes, A and B, of ``SIDE`` hashes
(each of ``ROWS`` min-hashes). A table key combines one of A with one of B: SIDE * SIDE tables from 2 * SIDE * ROWS
min-hashes. Texts with equal sets are one class and only its smallest doc_id goes on. A hash that no other
class shares can't make a shared key, so it is dropped before keys are formed.

Within a table's bucket nothing is paired with everything: members are compared with one centre, the class
whose hashes are shared most (in a group of edited copies, the one they were copied from). Links are
confirmed on full shingle sets. Where a bucket still holds several components after that, its members go
through an exact prefix-filter join across components, so no link inside a bucket is lost to the choice of centres.

Chance that a pair of similarity s shares a table: (1 - (1 - s**ROWS)**SIDE)**2: 0.99993 at 0.85, more above.

Defined cases: null or blank text has an empty set, component_id = doc_id, no links; under five words the
whole sequence is one shingle; rows with one doc_id are one document; a null doc_id is never linked to another
text and stays; other columns are carried by ``near_dedup``. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import U64, mix, shingles, text_pieces, word_hashes
from .scratch import column, columns_of, discard, free_name, materialize, partitions

SHINGLE = 5
SIDE, ROWS = 8, 2
PERCENT = 85
#: Members compared in one task with one centre.
STAR_SIZE = 100
_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(1, 2**63, 2 * SIDE * ROWS, dtype=np.uint64) * U64(2) + U64(1)
_ADD = _rng.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    n = len(offsets) - 1
    s, at = shingles(*word_hashes(data, offsets), n, SHINGLE)
    bounds = np.searchsorted(at, np.arange(n + 1))
    return [np.unique(s[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of min-hashes for each set; sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    return np.stack([np.minimum.reduceat(flat * m + a, starts) for m, a in zip(_MULTIPLY, _ADD, strict=True)], axis=1)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_pieces(batches):
        sets = shingle_sets(data, offsets)
        size = np.array([len(x) for x in sets], np.int64)
        full = np.flatnonzero(size)
        hashes: list = [None] * len(sets)
        keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
        if len(full):
            m = min_hashes([sets[i] for i in full])
            joined = mix(m[:, 0::2] * U64(0x9FB21C651E98DF25) + m[:, 1::2]).view(np.int64)
            for k, i in enumerate(full.tolist()):
                hashes[i] = joined[k]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(size), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_key", "hashes"],
        )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by star, the centre (role 0) first; only the centre's set is kept."""
    star, centre = None, None
    for rows, data, offsets in text_pieces(batches):
        us, salts, vs = (rows.column(i).to_pylist() for i in range(3))
        out_u, out_v, shared, union = [], [], [], []
        for u, salt, v, s in zip(us, salts, vs, shingle_sets(data, offsets), strict=True):
            if v is None:
                star, centre = (u, salt), s
            elif (u, salt) == star:
                k = len(np.intersect1d(centre, s, assume_unique=True))
                out_u.append(u)
                out_v.append(v)
                shared.append(k)
                union.append(len(centre) + len(s) - k)
        yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64()), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], names=["u", "v", "shared", "union"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v, shared, union) on full sets for pairs (u, v). A text travels once for each pair it is the v of, and the
    u of many pairs once for every STAR_SIZE of them."""
    n = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / STAR_SIZE).cast("int").alias("salts"))
    salted = pairs.join(n, "u").select("u", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), "v")
    heads = n.select("u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = salted.join(texts, salted["v"] == texts["doc_id"]).select("u", "salt", "v", "text")
    rows = rows.unionByName(heads.join(texts, heads["u"] == texts["doc_id"]).select("u", "salt", F.lit(None).cast("long").alias("v"), "text"))
    rows = rows.repartition(partitions(pairs.sparkSession), "u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
    return rows.mapInArrow(_verify, "u long, v long, shared long, union long")


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_pieces(batches, 1 << 20):
        sets = shingle_sets(data, offsets)
        size = np.array([len(x) for x in sets])
        repeat = np.repeat(np.arange(len(sets)), size)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).take(pa.array(repeat)), rows.column(1).take(pa.array(repeat)), pa.array(size[repeat]), pa.array(np.concatenate([np.zeros(0, U64), *sets]).view(np.int64))],
            names=["cls", "component", "n", "s"],
        )


def across_components(unsettled: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """All pairs (u, v) of unsettled (cls, component) rows in different components that can reach the similarity.

    Prefix filter: with J(x, y) at the threshold, x and y share percent of either set at least, so among the
    |x| - ceil(percent * |x|) + 1 shingles of x that fewest others hold, in one order for all, y has one in its
    own such prefix. Shingles that nobody else holds match nothing, so a text with many edits has no pairs.
    """
    rows = unsettled.join(texts, unsettled["cls"] == texts["doc_id"]).select("cls", "component", "text")
    held = materialize(rows.mapInArrow(_explode_sets, "cls long, component long, n long, s long"))
    common = held.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    order = F.array_sort(F.collect_list(F.struct("df", "s")))
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    prefix = held.join(common, "s").groupBy("cls", "component", "n").agg(order.alias("o")).select("cls", "component", "n", F.posexplode(F.slice("o", F.lit(1), length)).alias("i", "p"))
    prefix = prefix.filter("p.df > 1").select("cls", "component", "n", "i", F.col("p.s").alias("s"))
    # Of a pair, the smaller text needs only the prefix that the larger one's size leaves it: the overlap is 2 p / (1 + p) of it at least.
    short = (F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1).cast("int")
    other = prefix.filter(F.col("i") < short).withColumnsRenamed({"cls": "cls2", "component": "component2", "n": "n2", "i": "i2"})
    pairs = prefix.join(other, "s").filter("(n2 < n or (n2 = n and cls2 < cls)) and component <> component2")
    # What lies before the first shared shingle is not shared: enough must be left on either side.
    pairs = pairs.filter(F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")) * (100 + percent) >= (F.col("n") + F.col("n2")) * percent)
    return pairs.select(F.least("cls", "cls2").alias("u"), F.greatest("cls", "cls2").alias("v")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialize(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, set_key binary, hashes array<long>"))
    known = sets.filter("set_key is not null and doc_id is not null")
    first = materialize(known.groupBy("set_key").agg(F.min("doc_id").alias("cls")))
    classes = known.join(first, "set_key").filter("doc_id = cls").select("cls", "hashes")

    cells = classes.select("cls", F.posexplode("hashes").alias("i", "h"))
    shared = cells.groupBy("i", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    live = cells.join(shared, ["i", "h"]).groupBy("cls").agg(F.collect_list(F.struct("i", "h")).alias("cells"), F.sum("c").alias("score"))
    left, right = F.filter("cells", lambda x: x["i"] < SIDE), F.filter("cells", lambda x: x["i"] >= SIDE)
    table = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.xxhash64(a["i"], b["i"], a["h"], b["h"]))))
    # A struct orders by its fields: the highest score, then the smallest class.
    rank = F.struct(F.col("score").alias("s"), (-F.col("cls")).alias("c"))
    keys = materialize(live.select("cls", "score", F.explode(table).alias("key")))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max(rank)["c"].alias("c")).filter("members > 1").select("key", (-F.col("c")).alias("u"))
    members = materialize(keys.join(buckets, "key"))
    pairs = materialize(members.filter("u <> cls").select("u", F.col("cls").alias("v")).distinct())
    ids = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    # The ids grow with the corpus: a merge join at every size.
    texts = materialize(docs.hint("merge").join(ids, "doc_id", "left_semi"))

    tested = materialize(verified(pairs, texts))
    alike = F.col("shared") * 100 >= F.col("union") * percent
    links = tested.filter(alike).select("u", "v")
    groups = materialize(components(links))
    placed = members.select("key", "cls").join(groups, members["cls"] == groups["node"], "left").select("key", "cls", F.coalesce("component", "cls").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    unsettled = materialize(placed.join(mixed, "key", "left_semi").select("cls", "component").distinct())
    more = across_components(unsettled, texts, percent)
    done = tested.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    more = materialize(more.join(done, ["u", "v"], "left_anti"))
    if not more.isEmpty():
        links = links.unionByName(verified(more, texts).filter(alike).select("u", "v"))
        groups = materialize(components(links))
    of_class = first.join(groups, first["cls"] == groups["node"], "left").select("set_key", F.coalesce("component", "cls").alias("component"))
    out = sets.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that are the smallest doc_id of their component; same columns."""
    name = free_name(docs, "_gone")
    gone = near_duplicates(docs.select("doc_id", "text"), percent).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.hint("merge").join(gone, F.col("doc_id") == column(name), "left_anti").select(*columns_of(docs))
