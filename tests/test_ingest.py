"""Files stored one by one, maps, sketches, table functions, and small cases of text and listings that the tables do not hold."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ragspark.operators import crawl, ingest, sketches, store, text, udtfs, vector
from ragspark.operators.transactions import TransactionalStore
from ragspark.sources import files, paged


def test_a_file_that_fails_keeps_its_old_chunks(spark, tmp_path):
    table = TransactionalStore(spark, f"file://{tmp_path}/t")
    chunks = lambda *rows: spark.createDataFrame(list(rows), "file_name string, text string, page int")

    def embed(t):
        return [1.0 / len(t.replace("bad", ""))]

    first = {r.file_name: (r.n_chunks, r.status) for r in ingest.store_files(table, chunks(("a", "one", 1), ("b", "two", 1), (None, "three", 1)), embed).collect()}
    assert first == {"a": (1, "stored"), "b": (1, "stored"), "unknown": (1, "stored")}
    log = {r.file_name: (r.n_chunks, r.status, r.error and r.error.split(":")[0]) for r in ingest.store_files(table, chunks(("a", "new", 1), ("a", "bad", 2), ("b", "x", 1), ("b", "y", 2), ("c", None, 1)), embed).collect()}
    assert log == {"a": (2, "failed", "ZeroDivisionError"), "b": (2, "stored", None), "c": (1, "failed", "ValueError")}
    assert {(r.file_name, r.text, r.embedding[0]) for r in table.read().collect()} == {("a", "one", 1 / 3), ("b", "x", 1.0), ("b", "y", 1.0), ("unknown", "three", 0.2)}


def test_maps(spark):
    rows = spark.createDataFrame([(1, {"a": "x", "b": None}, {"b": "y", "c": "z"}), (2, None, {"c": "z"}), (3, {"a": "x"}, None), (4, None, None)], "id int, p map<string,string>, q map<string,string>")
    got = {r.id: (r.m, r.a, r.n) for r in rows.select("id", ingest.merged(F.col("p"), F.col("q")).alias("m"), ingest.get_or(F.col("p"), F.lit("a"), F.lit("none")).alias("a"), ingest.get_or(F.col("p"), F.lit("b"), F.lit("none")).alias("n")).collect()}
    assert got == {1: ({"a": "x", "b": "y", "c": "z"}, "x", None), 2: ({"c": "z"}, "none", "none"), 3: ({"a": "x"}, "x", "none"), 4: (None, "none", "none")}
    maps = spark.createDataFrame([('{"u": {"messages": [1, {"q": 2}]}, "v": {}}',), ("broken",), (None,), ('{"w": {"messages": []}}',)], "payload string")
    assert tuple(ingest.stored_conversations(maps).first()) == (3, 2) and tuple(ingest.stored_conversations(maps.limit(0)).first()) == (0, 0)


def test_sketches_of_polls_merge(spark):
    """Merged polls against exact counts, ranks and differences, within three deviations."""
    rows = spark.range(60_000).select((F.col("id") % 3).alias("poll"), (F.col("id") % 3 * 5_000 + F.col("id") / 3 % 20_000).cast("long").alias("key"), F.sqrt("id").alias("value"), F.lit("c").alias("name"))
    polls = sketches.polled(rows, ["name", "poll"], "key", "value")
    one = sketches.merged(polls, ["name"]).select("n", sketches.n_ids().alias("ids"), *[sketches.quantile(q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.99))]).first()
    exact = rows.select("key").distinct().count()
    assert one.n == 60_000 and abs(one.ids - exact) <= 3 * sketches.ID_ERROR * exact
    for value, rank in ((one.q0, 0.1), (one.q1, 0.5), (one.q2, 0.99)):
        assert abs(rows.filter(F.col("value") <= value).count() / 60_000 - rank) <= 3 * sketches.RANK_ERROR
    changed = sketches.changes(polls, ["name"], "poll").orderBy("poll").collect()
    assert changed[0].n_new is None and all(abs(r.n_new - 5_000) <= 3 * sketches.ID_ERROR * 25_000 and abs(r.n_gone - 5_000) <= 3 * sketches.ID_ERROR * 25_000 for r in changed[1:])


def test_table_functions(spark):
    udtfs.register(spark)
    pages = spark.createDataFrame([(1, "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table>"), (2, None), (3, "no table")], "id int, html string")
    got = spark.sql("select p.id, t.n, t.headers, t.cells from {p} p, lateral page_tables(p.html) t", p=pages).collect()
    assert [(r.id, r.n) for r in got] == [(1, i) for i in range(len(text.html_tables(pages.first().html)))] and got[0].headers == ["A", "B"] and got[0].cells == [["1", ""]]
    notes = "before\n# One\na\n\nb\n## Two ##\n#no heading\n### \n"
    sections = spark.sql("select t.* from {p} p, lateral page_sections(p.x) t", p=spark.createDataFrame([(notes,), (None,), ("",)], "x string")).collect()
    assert [(r.n, r.level, r.heading, r.body) for r in sections] == [(0, 0, None, "before"), (1, 1, "One", "a\n\nb"), (2, 2, "Two", "#no heading"), (3, 3, "", "")]


def test_word_tables_follow_the_paragraphs():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    body = f"<w:document {w}><w:body><w:tbl><w:tr>{cell.format('a')}{cell.format(' ')}{cell.format('b')}</w:tr></w:tbl><w:p><w:r><w:t>After </w:t></w:r><w:r><w:t>it</w:t></w:r></w:p></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    assert files.word_text(out.getvalue(), "x.docx").split("\n")[2:] == ["After it", "a | b"] and files.word_summary(out.getvalue()) == (1, 1, 8)


@pytest.mark.parametrize("most, want", [(None, {1: 0, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2}), (2, {1: 0, 2: 1, 3: 1, 5: 2}), (1, {1: 0, 2: 1, 5: 2})])
def test_walk_with_few_children(spark, most, want):
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 5), (2, 1), (4, 6), (5, 7), (7, 8), (9, 1)], "src long, dst long").filter("not (src = 2 and dst = 1)" if most == 1 else "true")
    got = {r.node: r.depth for r in crawl.walk(edges, spark.createDataFrame([(1,)], "node long"), 2, most).collect()}
    assert got == want


def test_small_cases(spark):
    one = lambda value, c: spark.createDataFrame([(value,)], "x string").select(c(F.col("x")).alias("y")).first().y
    assert one("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\nHello there\n\nNOTE x\n2\n00:00:03.000 --> 00:00:04.000\n Second line \n", text.parse_vtt) == "Hello there\nSecond line"
    assert one("see http://a.b/c and https://d.e or http://a.b/c", text.urls) == ["http://a.b/c", "https://d.e"]
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0])], "id int, v array<double>")
    assert {r.id: r.s for r in rows.select("id", vector.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("s")).collect()} == {1: 0.0, 2: 1.0, 3: -1.0}
    users = spark.createDataFrame([('{"u1":["a",{"q":1}],"u2":{"k":"v"},"u3":7}',)], "payload string")
    assert {tuple(r) for r in store.flatten_users(users).collect()} == {("u1", 0, "a"), ("u1", 1, '{"q":1}'), ("u2", 0, '{"k":"v"}'), ("u3", 0, "7")}
    answers = {1: '["a1","b1"]', 2: '["a2"]', 3: "[]", 4: '["never read"]'}
    assert {tuple(r) for r in paged.items_of_pages(paged.fetch_pages(spark, answers.__getitem__, 1, 5)).collect()} == {(1, 0, "a1"), (1, 1, "b1"), (2, 0, "a2")}
    found = [("a.pdf", 1024, "u1"), ("z.pdf", 10, "u1"), ("b.DOCX", 2500, "u2"), ("c.png", 5, "u3"), ("d.txt", 60 << 20, "u4")]
    assert {tuple(r) for r in crawl.eligible(spark.createDataFrame(found, "name string, size long, url string")).select("name", "file_type", "file_size_kb").collect()} == {("a.pdf", "pdf", 1.0), ("b.DOCX", "docx", 2.44)}
