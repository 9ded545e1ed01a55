"""Values that queries count only: vectors made from texts, stamped inserts, cleared stores, files found by globs, folders of trees."""

import datetime
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.operators import curation, feedback, rebuild, store, vector
from ragspark.sources import files

SF = "/root/testdata/sf0.01"


def embedded(text, dim):
    v = np.zeros(dim)
    for w in (text or "").lower().split():
        v[zlib.crc32(w.encode()) % dim] += 1
    return v / np.linalg.norm(v) if v.any() else v


def same(a, b):
    return np.allclose(np.array(a, float), b, atol=1e-12)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


def test_embedded_rows_hold_the_vectors_of_their_texts(docs):
    texts = {r.id: r.text for r in docs.collect()}
    rows = rebuild.embed_rows(docs, vector.embed_hashing, 32, "hashing-32").collect()
    assert len(rows) == len(texts) and all(same(r.embedding, embedded(texts[r.id], 32)) and (r.model_id, r.metadata) == ("hashing-32", "{}") for r in rows)


def test_migration_copies_or_makes_each_vector(spark, docs):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    before = {r.id: (r.text, r.embedding) for r in docs.join(given, "id").collect()}
    rows = docs.join(given, "id").withColumn("embedding", F.when(F.col("id") % 3 == 0, F.slice("embedding", 1, 9)).when(F.col("id") % 3 == 1, F.col("embedding")))
    for r in store.migrate_vectors(rows, 64, vector.embed_hashing).collect():
        text, vec = before[r.id]
        assert r.copied == (r.id % 3 == 1) and same(r.embedding, vec if r.copied else embedded(text, 64))


def test_only_texts_that_got_a_title_are_embedded_again(docs):
    rows = docs.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("# T\n"), "text")).otherwise(F.col("text")).alias("text"), F.array(F.lit(7.0)).alias("embedding"))
    texts = {r.id: r.text for r in docs.collect()}
    for r in rebuild.enrich_and_embed(rows, F.lit("Title"), vector.embed_hashing, 16).collect():
        if r.id % 2 == 0 or (texts[r.id] or "").startswith("# ") or texts[r.id] is None:
            assert not r.changed and (list(r.embedding) == [7.0])
        else:
            assert r.changed and r.text == f"# Title\n{texts[r.id]}" and same(r.embedding, embedded(r.text, 16))


def test_cleared_and_appended(spark, docs):
    assert rebuild.cleared(docs).count() == 0 and rebuild.cleared(docs).columns == docs.columns
    as_of = F.lit("2024-05-01 00:00:00").cast("timestamp")
    out = curation.appended(docs.filter("id < 3"), docs.filter("id = 5"), as_of).collect()
    assert sorted((r.id, r.created_at) for r in out if r.created_at) == [(5, datetime.datetime(2024, 5, 1))] and len(out) == 4


def test_lines_of_globbed_files_keep_their_order(spark, tmp_path):
    long = [f'{{"input": "q{i % 40}", "expectedOutput": "{"a" * 200} {i % 40}"}}' for i in range(3000)]
    (tmp_path / "unified.jsonl").write_text("\n".join(long))
    (tmp_path / "daily-1.jsonl").write_text('{"input": "x", "corrected_output": "y"}\nbroken\n\n{"input": "only"}\n')
    (tmp_path / "other.txt").write_text("not read")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # several splits
    try:
        lines = files.scan_json_lines(spark, f"{tmp_path}/unified*.jsonl", f"{tmp_path}/daily-*.jsonl").cache()
        found = sorted((r.n, r.line) for r in lines.collect() if r.file.endswith("unified.jsonl"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [x for _, x in found] == long and lines.select("n").distinct().count() == lines.count()
    assert {(r.file.rpartition("/")[2], r.format) for r in curation.file_format(lines).collect()} == {("unified.jsonl", "exported"), ("daily-1.jsonl", "standard")}
    totals = curation.convert_totals(feedback.convert_status(lines)).first()
    assert (totals.total, totals.valid, totals.duplicate, totals.invalid, totals.incomplete) == (3003, 41, 2960, 1, 1)


def test_folders_of_a_tree_are_read(spark, tmp_path):
    deep = tmp_path / "a" / "b" / "c"
    deep.mkdir(parents=True)
    for at, name in ((tmp_path, "one.txt"), (deep, "two.md"), (deep.parent, "three.png")):
        (at / name).write_text(name)
    got = {r.file_name: r.text for r in files.scan_folder(spark, str(tmp_path), recursive=True).collect()}
    assert got == {"one.txt": "one.txt", "two.md": "two.md", "three.png": ""}
