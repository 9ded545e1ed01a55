"""Streams end where the batch operators do."""

from pyspark.sql import functions as F

from ragspark.operators import conversation
from ragspark.streaming import conversations

SF = "/root/testdata/sf0.01"


def test_keep_last_equals_batch(spark, tmp_path):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    many = turns.unionByName(spark.range(25).select(F.lit(9999).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text")))
    many.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(many.schema).parquet(str(tmp_path / "in"))
    q = conversations.keep_last(stream).writeStream.format("memory").queryName("kept").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {}
    for r in spark.table("kept").collect():
        if r.conv_id not in got or r.last_turn >= got[r.conv_id].last_turn:
            got[r.conv_id] = r
    want = conversation.last_messages(many).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi")).collect()
    assert {(r.conv_id, r.n_kept, r.first_turn, r.last_turn) for r in got.values()} == {(r.conv_id, r.n, r.lo, r.hi) for r in want}
    assert got[9999].n_kept == 20 and got[9999].first_turn == 5


def test_new_traces_once(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("trace_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = conversations.new_traces(stream).writeStream.format("memory").queryName("traces").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("traces").count() == rows.distinct().count()
