"""The shared folder where the session names none, and numbers over a whole table."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ragspark import tables


def session(master, found=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: found or default), sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_a_local_master_gets_one_folder_of_its_own(monkeypatch):
    monkeypatch.setattr(tables, "_own", None)
    first = tables.shared_dir(session("local[2]"))
    assert first.startswith("file:///") and tables.shared_dir(session("local[4]")) == first
    assert tables.shared_dir(session("local[2]", "hdfs://x/y/")) == "hdfs://x/y" and tables.new_path(session("local[2]")).startswith(f"{first}/ragspark/app/table-")
    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(session("spark://host:7077"))


def test_a_table_is_written_without_a_named_folder(spark, monkeypatch):
    monkeypatch.setattr(tables, "_own", None)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default, of=type(spark.conf).get: default[0] if key == "spark.checkpoint.dir" and default else of(self, key, *default))
    out = tables.materialize(spark.range(10))
    assert out.count() == 10 and tables._own
    tables.discard(out)


def test_numbers(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("a.b"), (F.col("id") % 3).alias("_at")).unionByName(spark.range(400).select(F.lit(17).cast("long").alias("k"), F.lit("x").alias("a.b"), F.lit(0).cast("long").alias("_at"))).repartition(7)
    got = tables.numbered(rows, "n", "k").collect()
    assert got[0].asDict().keys() == {"k", "a.b", "_at", "n"} and sorted(r.n for r in got) == list(range(5400))
    assert [r.k for r in sorted(got, key=lambda r: r.n)] == sorted(r.k for r in got)
    assert tables.numbered(rows.limit(0), "n", "k").count() == 0
