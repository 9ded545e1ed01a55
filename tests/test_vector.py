"""Batch search held against brute force, with queries held by the tasks and with both sides in blocks."""

import numpy as np
import pytest
from compare import differs

from ragspark.operators import vector
from ragspark.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("most", [100, 3])
def test_batch_top_k_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vector, "STORE_BLOCK", 10)
    rng = np.random.default_rng(5)
    vectors = {i: rng.integers(-2, 3, 4 if i % 10 else 3).astype(float) for i in range(120)}
    vectors[7] = np.zeros(4)
    store = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()] + [(500, None)], "vec_id long, embedding array<float>")
    queries = store.filter("vec_id < 12 or vec_id = 500").withColumnRenamed("vec_id", "qid")

    def score(a, b):
        norms = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / norms), 6) if norms else 0.0

    want = set()
    for q in range(12):
        ranked = sorted((-score(vectors[q], v), i) for i, v in vectors.items() if len(v) == len(vectors[q]))
        want |= {(q, i, -s + 0.0, n) for n, (s, i) in enumerate(ranked[:5], 1)}
    got = vector.batch_top_k(store, queries, 5, most).collect()
    assert {(r["qid"], r["vec_id"], r["score"] + 0.0, r["rank"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("most", [100, 0])
def test_batch_top_k_of_empty_sides(spark, most):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert vector.batch_top_k(one, none.withColumnRenamed("vec_id", "qid"), 5, most).count() == 0
    assert vector.batch_top_k(none, one.withColumnRenamed("vec_id", "qid"), 5, most).count() == 0


def test_blocks_meet_in_many_partitions(spark, monkeypatch):
    """Both sides of a pair of blocks reach one task also where small partitions are not put together."""
    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vector, "STORE_BLOCK", 10)
    rng = np.random.default_rng(6)
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 4)))], "vec_id long, embedding array<float>")
    queries = store.filter("vec_id < 30").withColumnRenamed("vec_id", "qid")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in vector.batch_top_k(store, queries, 5, 3).select("qid", "rank", "vec_id", "score").collect()}
        want = {tuple(r) for r in vector.batch_top_k(store, queries, 5, 100).select("qid", "rank", "vec_id", "score").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 150 and got == want


@pytest.mark.parametrize("name", ["ret_plain_context", "vec_hits_by_source", "vec_topk_batch", "ret_cited_context", "ret_debug_preview"])
def test_queries_in_blocks_equal_their_sql(spark, monkeypatch, name):
    """What over MAX_QUERIES queries take at 1 GB, forced on a small table: blocks, and partitions that are not put together."""
    for of, n in {"MAX_QUERIES": 5, "QUERY_BLOCK": 7, "STORE_BLOCK": 40, "STRIP": 16}.items():
        monkeypatch.setattr(vector, of, n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        x = differs(QUERIES[name](spark, "/root/testdata/sf0.01"), ORACLE_SQL[name], "/root/testdata/sf0.01")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert x is None, x[:600]
