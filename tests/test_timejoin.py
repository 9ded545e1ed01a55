"""Joins by time against loops: ties, nulls, keys with most of the rows, tolerances, buckets without rows."""

import collections
import datetime
import random

import pytest

from ragspark.operators import timejoin

START = datetime.datetime(2024, 1, 1)


def moment(s):
    return None if s is None else START + datetime.timedelta(seconds=s)


def sides():
    r = random.Random(1)
    at = lambda: r.choice([None, *range(0, 4000, 7)]) if r.random() < 0.1 else r.randrange(0, 4000)
    key = lambda: r.choice(["hot"] * 4 + ["a", "b", None])
    left = [(i, key(), at()) for i in range(150)] + [(0, "hot", 1500)] * 2 + [(900, "none", 5), (901, "hot", 3_000_000)]
    right = [(i, key(), at(), f"v{i}") for i in range(120)] + [(500, "hot", 700, "low"), (501, "hot", 700, "high"), (502, "a", 700, None)]
    return left, right


def frames(spark, left, right):
    a = spark.createDataFrame([(i, k, moment(t)) for i, k, t in left], "id long, key string, ts timestamp")
    return a, spark.createDataFrame([(i, k, moment(t), v) for i, k, t, v in right], "rid long, key string, ts timestamp, value string")


@pytest.mark.parametrize("bucket, tolerance", [(86_400, None), (60, None), (60, 300), (5, 0)])
def test_asof(spark, bucket, tolerance):
    left, right = sides()
    a, b = frames(spark, left, right)
    want = collections.Counter()
    for i, k, t in left:
        found = [(rt, ri, v) for ri, rk, rt, v in right if None not in (k, t, rt) and rk == k and rt <= t]
        best = max(found, key=lambda x: x[:2]) if found else None
        if best and tolerance is not None and t - best[0] > tolerance:
            best = None
        want[i, k, moment(t), best[1] if best else None, best[2] if best else None] += 1
    out = timejoin.asof_join(a, b, "ts", ["key"], ["rid", "value"], "rid", tolerance, bucket)
    assert out.columns == ["id", "key", "ts", "rid", "value"] and collections.Counter(map(tuple, out.collect())) == want


@pytest.mark.parametrize("before, after", [(100, 30), (0, 0), (0, 500)])
def test_interval(spark, before, after):
    left, right = sides()
    a, b = frames(spark, left, right)
    want = collections.Counter((i, ri) for i, k, t in left for ri, rk, rt, _ in right if None not in (k, t, rt) and rk == k and t - before <= rt <= t + after)
    assert collections.Counter((r.l.id, r.r.rid) for r in timejoin.interval_join(a, b, "ts", "key", before, after).collect()) == want


def test_empty_sides(spark):
    left, right = sides()
    a, b = frames(spark, left, right)
    assert timejoin.asof_join(a, b.limit(0), "ts", ["key"], ["value"], "rid").filter("value is null").count() == len(left)
    assert timejoin.asof_join(a.limit(0), b, "ts", ["key"], ["value"], "rid").count() == 0 and timejoin.interval_join(a, b.limit(0), "ts", "key", 5, 5).count() == 0
