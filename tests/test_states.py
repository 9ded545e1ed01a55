"""Streams with state against batch results: list states through restarts, polls that are run again, late rows, sessions, monitors."""

import os
import shutil
import time

from pyspark.sql import functions as F

from ragspark.operators.transactions import TransactionalStore
from ragspark.streaming import conversations, messages, polling

SF = "/root/testdata/sf0.01"


def stores(spark, tmp_path, *names):
    return [TransactionalStore(spark, f"file://{tmp_path}/{n}") for n in names]


def batches(spark, tmp_path, parts, start):
    """Each part arrives, and the query runs from its checkpoint over what is new."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = start(spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/progress")
        assert query.awaitTermination(90)


def test_last_messages_equal_batch_after_restarts(spark, tmp_path):
    turns = spark.createDataFrame([(c, t, "user" if t % 2 else "assistant", f"{c}-{t}") for c, n in ((1, 50), (2, 7), (3, 20)) for t in range(n)] + [(4, 1, None, None), (4, 1, None, None)], "conv_id long, turn long, role string, text string")
    (store,) = stores(spark, tmp_path, "s")
    keep = lambda df, n: store.append(df.withColumn("batch", F.lit(n)), "w", n)
    # Turns come out of order, and some again.
    parts = [turns.filter("turn % 3 = 2"), turns.filter("turn % 3 = 0"), turns.filter("turn % 3 <> 0")]
    batches(spark, tmp_path, parts, lambda s, c: messages.start(messages.last_messages(s, kept=5), keep, c))
    rows = store.read().filter("event = 'window'").collect()
    newest = {c: max(r.batch for r in rows if r.conv_id == c) for c in (1, 2, 3, 4)}
    got = {(r.conv_id, r.turn, r.text) for r in rows if r.batch == newest[r.conv_id]}
    assert got == {(c, t, f"{c}-{t}") for c, n in ((1, 50), (2, 7), (3, 20)) for t in range(n - 5, n)} | {(4, 1, None)}


def test_silent_conversations_are_closed(spark, tmp_path):
    (store,) = stores(spark, tmp_path, "s")
    keep = lambda df, n: store.append(df, "w", n)
    part = lambda c: spark.createDataFrame([(c, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    part(1).coalesce(1).write.parquet(f"{tmp_path}/in")
    for c in (2, 3):
        time.sleep(1.2)
        batches(spark, tmp_path, [part(c)], lambda s, at: messages.start(messages.last_messages(s, idle=1000), keep, at))
    events = [(r.conv_id, r.event) for r in store.read().orderBy("conv_id").collect()]
    assert ("window" in [e for c, e in events if c == 3]) and {c for c, e in events if e == "closed"} >= {1, 2}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    scores = spark.createDataFrame([(f"t{i % 7}", "judge" if i % 3 else "other", float(i % 5)) for i in range(40)], "trace_id string, name string, value double")
    (store,) = stores(spark, tmp_path, "s")
    run = polling.low_scores_once(store, "poll", "judge", 2)
    start = lambda s, c: polling.poll(s, run, c)
    batches(spark, tmp_path, [scores.limit(15), scores], start)
    before = {tuple(r) for r in store.read().collect()}
    # The mark that the last batch ended is lost, as when the driver dies after it has written.
    commits = sorted((n for n in os.listdir(f"{tmp_path}/progress/commits") if n.isdigit()), key=int)
    os.remove(f"{tmp_path}/progress/commits/{commits[-1]}")
    shutil.rmtree(f"{tmp_path}/progress/commits/.{commits[-1]}.crc", ignore_errors=True)
    if os.path.exists(f"{tmp_path}/progress/commits/.{commits[-1]}.crc"):
        os.remove(f"{tmp_path}/progress/commits/.{commits[-1]}.crc")
    versions = store.versions()
    batches(spark, tmp_path, [scores.limit(0)], start)
    assert {tuple(r) for r in store.read().collect()} == before and store.versions()[: len(versions)] == versions
    want = scores.filter("name = 'judge' and value < 2").select("trace_id").distinct().count()
    assert len(before) == want == len({x[0] for x in before})


def test_late_rows_have_a_store_of_their_own(spark, tmp_path):
    on_time, late = stores(spark, tmp_path, "on_time", "late")
    at = lambda *hours: spark.createDataFrame([(h,) for h in hours], "h int").select("h", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.col("h") * F.expr("interval 1 hour")).alias("ts"))
    batches(spark, tmp_path, [at(10, 1), at(20, 8, 7, None), at(19, 17, 2)], lambda s, c: polling.poll(s, polling.route_late(on_time, late, "r", "2 hours"), c))
    assert sorted((r.batch, r.h) for r in on_time.read().collect()) == [(0, 1), (0, 10), (1, 8), (1, 20), (2, 19)]
    assert sorted((r.batch, r.h or 0) for r in late.read().collect()) == [(1, 0), (1, 7), (2, 2), (2, 17)]


def test_session_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts").filter("user_id < 5")
    (store,) = stores(spark, tmp_path, "s")
    edge = rows.agg(F.percentile_approx("ts", 0.5)).first()[0]
    end = rows.limit(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("ts"))
    parts = [rows.filter(F.col("ts") < edge), rows.filter(F.col("ts") >= edge), end, end]
    batches(spark, tmp_path, parts, lambda s, c: polling.poll(polling.sessions(s, "user_id", "6 hours"), lambda df, n: store.append(df, "s", n), c))
    want = polling.sessions(rows, "user_id", "6 hours")
    assert {tuple(r) for r in store.read().filter("user_id >= 0").collect()} == {tuple(r) for r in want.collect()}


def _last(spark, tmp_path, df, mode, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    return spark.table(name)


def test_monitors(spark, tmp_path):
    """Counts by type, hourly windows and the progress of jobs as streams equal their batch forms."""
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = {tuple(r) for r in _last(spark, tmp_path, conversations.live_counts(stream, "event_type"), "complete", "counts").collect()}
    assert got == {tuple(r) for r in rows.groupBy("event_type").count().collect()}
    windows = _last(spark, tmp_path, conversations.windowed_counts(stream).select("window.start", "event_type", "n"), "update", "windows")
    want = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count().select("w.start", "event_type", "count")
    assert {tuple(r) for r in windows.collect()} == {tuple(r) for r in want.collect()}
    message = F.concat(F.lit("Step "), (F.col("event_id") % 50).cast("string"), F.lit("/50, loss="), F.round("value", 2).cast("string"))
    jobs = lambda df: df.select((F.col("user_id") % 7).alias("job_id"), "ts", F.when(F.col("event_id") % 5 > 0, message).otherwise("started").alias("message"))
    since = "2024-01-10 00:00:00"
    got = {tuple(r) for r in _last(spark, tmp_path, conversations.job_progress(jobs(stream), since), "complete", "jobs").collect()}
    assert got == {tuple(r) for r in conversations.parse_progress(jobs(rows.filter(F.col("ts") > since))).groupBy("job_id").agg(F.max("step"), F.max("total"), F.min("loss")).collect()}
