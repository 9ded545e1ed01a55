"""The pipeline's stages on the small table: what each promises of its own input."""

import corpus_pipeline
from ragspark.llm import decontaminate, near_dedup
from ragspark.llm.scratch import materialize

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns and docs.count() <= n
        n = docs.count()
        after[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not [i for i in after["quality_rules"] if labels.get(i) == 0]
    assert after["line_dedup"] == after["quality_rules"]
    assert near_dedup.near_duplicates(docs).filter("not kept").count() == 0
    assert decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == n


def test_near_duplicates_from_080(spark):
    """Texts of 100 words, so 96 shingles: a word replaced inside loses five of them, the last but one two."""
    words = {k: [f"w{k}x{i}" for i in range(100)] for k in range(30)}
    edits = {"0.81": [20, 50], "0.78": [20, 50, 98]}
    rows, similarity = [], {}
    for k, own in words.items():
        name = "0.81" if k % 2 else "0.78"
        copy = [f"edited{i}" if i in edits[name] else w for i, w in enumerate(own)]
        sets = [{tuple(x[i : i + 5]) for i in range(96)} for x in (own, copy)]
        similarity[name] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * k, " ".join(own), name), (2 * k + 1, " ".join(copy), name)]
    assert 0.80 <= similarity["0.81"] < 0.85 and similarity["0.78"] < 0.80
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()}
    assert got == {i for i, _, name in rows if name == "0.78" or i % 2 == 0}
    assert near_dedup.near_dedup(docs).count() == len(rows)
