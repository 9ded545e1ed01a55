"""Operator 12, approximate nearest neighbours: a hierarchical navigable small-world graph for each shard of the vectors.

Vectors are dealt to shards of about ``SHARD`` by a hash, so the number of shards grows with the table and a shard never does.
A task builds one shard's graph: vectors enter one after another, on random levels; a new one is linked to near ones that are nearer to it than to
each other, and they back to it. Candidates for its links are the exact nearest of those already in the level, from the shard's
distances, rather than what a search happens to find: the same graph with fewer flaws, at a cost bounded by the shard's size.
A graph is one row of an index table: ids, vectors and neighbours as flat arrays, a fixed number of places a vector and level.

A search takes a block of queries to every shard: greedy steps through the upper levels, then a beam of ``BEAM`` at the lowest, for
all queries of a block at once. Shards' results are merged by a top-k window.

Every row is in the index; equal vectors are one node, with the rows of their k + 1 smallest ids: no other row can be among
anyone's k nearest. Vectors of other lengths meet only their like.

Defined cases: null, empty or zero vectors and those with null or non-finite components take no part, nor do rows of null id;
repeated rows are candidates each; a query's own rows are all those of its id; of a query id with several vectors the smallest
vector counts; an empty table gives an empty table. Shards of at most ``BEAM`` vectors are compared with all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, partitions

SHARD = 4_096
QUERY_BLOCK = 1_024
#: Links of a vector in the upper levels, twice as many in the lowest; candidates for them; places of a search.
LINKS, CANDIDATES, BEAM = 16, 64, 96
#: Queries whose distances are computed at once.
STRIP = 256
INDEX = "dim int, shard int, ids array<long>, starts array<int>, vectors array<double>, levels array<int>, nodes array<int>, neighbours array<int>"


def _diverse(near: np.ndarray, to_new: np.ndarray, most: int, fill: bool) -> np.ndarray:
    """Places of the candidates, nearest first, that are nearer to the new vector than to any taken before; ``fill`` adds passed-over ones."""
    taken, blocked = [], np.zeros(len(to_new), bool)
    for t in range(len(to_new)):
        if not blocked[t]:
            taken.append(t)
            if len(taken) == most:
                break
            blocked |= near[t] < to_new
    if fill and len(taken) < most:
        rest = np.setdiff1d(np.arange(len(to_new)), taken)
        taken += rest[: most - len(taken)].tolist()
    return np.array(taken, np.int64)


def _level(far: np.ndarray, links: int, width: int) -> np.ndarray:
    """Neighbours of each vector of one level, padded with -1, from its distances; vectors enter in order."""
    n = len(far)
    out, count = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
    for i in range(1, n):
        row = far[i, :i]
        near = np.argpartition(row, CANDIDATES)[:CANDIDATES] if i > CANDIDATES else np.arange(i)
        near = near[np.argsort(row[near], kind="stable")]
        chosen = near[_diverse(far[np.ix_(near, near)], row[near], links, True)]
        out[i, : len(chosen)], count[i] = chosen, len(chosen)
        for j in chosen:
            if count[j] < width:
                out[j, count[j]] = i
                count[j] += 1
                continue
            all_ = np.append(out[j], i)
            all_ = all_[np.argsort(far[j, all_], kind="stable")]
            left = all_[_diverse(far[np.ix_(all_, all_)], far[j, all_], width, False)]
            out[j], count[j] = -1, len(left)
            out[j, : len(left)] = left
    return out


def graph(x: np.ndarray, links: int = LINKS, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, neighbours as places in the level) from the lowest level, which has all nodes, to the highest."""
    # A vector is on level l or above with probability links ** -l.
    height = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(x))) / np.log(links)).astype(int)
    squares = (x * x).sum(1)
    far = np.empty((len(x), len(x)), np.float32)
    for a in range(0, len(x), STRIP):
        far[a : a + STRIP] = np.maximum(squares[a : a + STRIP, None] + squares[None] - 2 * x[a : a + STRIP] @ x.T, 0)
    out = []
    for level in range(height.max() + 1):
        nodes = np.flatnonzero(height >= level)
        out.append((nodes, _level(far if level == 0 else far[np.ix_(nodes, nodes)], links, links if level else 2 * links)))
    return out


def _distances(x: np.ndarray, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Squared distances of each query from its row of nodes."""
    d = x[nodes] - q[:, None, :]
    return np.einsum("qnd,qnd->qn", d, d)


def beam(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the nearest found of each query, unsorted; infinite distances where there are none."""
    n, every = len(x), np.arange(len(q))
    if n <= width:
        nodes = np.broadcast_to(np.arange(n), (len(q), n))
        return nodes, _distances(x, q, nodes)
    at = np.full(len(q), levels[-1][0][0])
    best = _distances(x, q, at[:, None])[:, 0]
    for nodes, neighbours in levels[:0:-1]:
        moving = every
        while len(moving):
            near = neighbours[np.searchsorted(nodes, at[moving])]
            d = np.where(near >= 0, _distances(x, q[moving], nodes[near]), np.inf)
            j = d.argmin(1)
            found = d[np.arange(len(moving)), j]
            better = found < best[moving]
            to = nodes[near[np.arange(len(moving)), j]]
            moving, to, found = moving[better], to[better], found[better]
            at[moving], best[moving] = to, found
    neighbours = levels[0][1]
    dist, node, seen = np.full((len(q), width), np.inf), np.zeros((len(q), width), np.int64), np.ones((len(q), width), bool)
    met = np.zeros((len(q), n + 1), bool)
    dist[:, 0], node[:, 0], seen[:, 0], met[every, at] = best, at, False, True
    while True:
        open_ = np.where(seen, np.inf, dist)
        j = open_.argmin(1)
        rows = np.flatnonzero(open_[every, j] < np.inf)
        if not len(rows):
            return node, dist
        j = j[rows]
        seen[rows, j] = True
        near = neighbours[node[rows, j]]
        new = (near >= 0) & ~met[rows[:, None], near]
        met[rows[:, None], np.where(new, near, n)] = True
        d = np.where(new, _distances(x, q[rows], near), np.inf)
        all_d, all_n, all_s = np.hstack([dist[rows], d]), np.hstack([node[rows], near]), np.hstack([seen[rows], ~new])
        keep = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        dist[rows], node[rows], seen[rows] = (np.take_along_axis(a, keep, 1) for a in (all_d, all_n, all_s))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _build(links: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        # Copies side by side, then one node for each vector.
        x, ids = _matrix(rows["vector"], rows.num_rows), rows["vec_id"].to_numpy()
        order = np.lexsort((ids, *x.T))
        x, ids = x[order], ids[order]
        starts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(1)))
        # Vectors enter in a random order.
        mixed = np.random.default_rng(len(ids)).permutation(len(starts))
        length = np.diff(starts, append=len(ids))[mixed]
        rows_of = np.repeat(starts[mixed] - np.cumsum(length) + length, length) + np.arange(len(ids))
        x, ids, starts = x[starts[mixed]], ids[rows_of], np.append(0, np.cumsum(length))
        levels = graph(x, links)
        flat = {
            "dim": np.array([key[0].as_py()], np.int32), "shard": np.array([key[1].as_py()], np.int32), "ids": [ids], "starts": [starts.astype(np.int32)], "vectors": [x.ravel()], "levels": [np.array([len(n) for n, _ in levels], np.int32)],
            "nodes": [np.concatenate([n for n, _ in levels]).astype(np.int32)], "neighbours": [np.concatenate([b.ravel() for _, b in levels])],
        }
        return pa.table({k: pa.array(v) for k, v in flat.items()})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vector) of the rows that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.size(v).alias("dim"), v.cast("array<double>").alias("vector"))


def build_index(rows: DataFrame, k: int, shard: int = SHARD, links: int = LINKS) -> DataFrame:
    """The written index of rows (vec_id, dim, vector) for searches of up to k: one row a shard."""
    # Of equal vectors the k + 1 smallest ids; of equal rows k. Spark cuts a task's rows so before the shuffles.
    same = Window.partitionBy("vector", "vec_id").orderBy(F.lit(0))
    ids = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k).drop("_n")
    few = few.withColumn("_n", F.dense_rank().over(ids)).filter(F.col("_n") <= k + 1).drop("_n")
    few = materialize(few)
    shards = few.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards"))
    dealt = few.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
    # By number, so that shards are not put together by their bytes: the work is in the graphs.
    n = shards.agg(F.sum("shards")).first()[0] or 1
    dealt = dealt.select("dim", "shard", "vec_id", "vector").repartition(max(n, partitions(rows.sparkSession)), "dim", "shard")
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(_build(links), INDEX))


def _levels(row: dict, links: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, a, b = [], 0, 0
    for i, n in enumerate(row["levels"]):
        width = links if i else 2 * links
        out.append((row["nodes"][a : a + n].astype(np.int64), row["neighbours"][b : b + n * width].astype(np.int64).reshape(n, width)))
        a, b = a + n, b + n * width
    return out


def _meet(k: int, links: int, width: int):
    """The k nearest found in one shard for each query of a block."""

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if index.num_rows and asked.num_rows:
            row = {c: index[c].combine_chunks().flatten().to_numpy() for c in ("ids", "starts", "vectors", "levels", "nodes", "neighbours")}
            x, levels, ids, starts = row["vectors"].reshape(len(row["starts"]) - 1, -1), _levels(row, links), row["ids"], row["starts"]
            queries, qids = _matrix(asked["vector"], asked.num_rows), asked["query_id"].to_numpy()
            for a in range(0, len(qids), STRIP):
                for qid, nodes, d in zip(qids[a : a + STRIP], *beam(x, levels, queries[a : a + STRIP], width), strict=True):
                    nodes, d = nodes[d < np.inf], d[d < np.inf]
                    n = starts[nodes + 1] - starts[nodes]
                    found = ids[np.repeat(starts[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    d = np.repeat(d, n)[found != qid]
                    found = found[found != qid]
                    best = np.lexsort((found, d))[:k]
                    out.append((np.full(len(best), qid), found[best], np.sqrt(d[best])))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.array([]) for _ in range(3)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int, links: int = LINKS, width: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each of queries (query_id, dim, vector); rows of a query's own id do not count.

    Each block of queries meets each shard of its length in a task of its own.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = index.select(F.col("dim").alias("of"), F.col("shard").alias("to"))
    asked = queries.join(shards, queries["dim"] == shards["of"]).select(F.col("dim").alias("d"), F.col("to"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b"), "query_id", "vector")
    stored = index.select(*index.columns, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = stored.groupBy("dim", "shard", "block").cogroup(asked.groupBy("d", "to", "b")).applyInArrow(_meet(k, links, width), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, shard: int = SHARD) -> DataFrame:
    """The k nearest vectors found for each row (vec_id, embedding) whose id is divisible by ``every``, by Euclidean distance in doubles."""
    rows = usable(vectors)
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min("vector").alias("vector"))
    one = Window.partitionBy("vec_id").orderBy("dim")
    queries = queries.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select(F.col("vec_id").alias("query_id"), "dim", "vector")
    return search(build_index(rows, k, shard), queries, k)


