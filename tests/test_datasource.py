"""Remote listings: ends, failures, links in a circle, corrupt pages, and streams that go on where they ended."""

import json

import pytest

from ragspark.sources import datasource

HERE = "ragspark.sources.datasource:Folder"


@pytest.fixture
def serve(spark, tmp_path):
    datasource.register(spark)

    def put(payloads, name="served"):
        path = f"file://{tmp_path}/{name}"
        datasource.write_payloads(spark.createDataFrame([(str(a), p) for a, p in payloads.items()], "address string, payload string"), path)
        return path

    return put


def pages(n, size=3):
    return {i: json.dumps([{"id": i * 10 + k} for k in range(size)]) for i in range(1, n + 1)}


def read(spark, path, kind="json_pages", **options):
    return spark.read.format(kind).options(server=HERE, path=path, **options).load()


@pytest.mark.parametrize("per_task", [1, 2, 50])
@pytest.mark.parametrize("broken, end", [({}, 12), ({5: "[]"}, 4), ({7: "[{"}, 6), ({3: '{"error": 1}', 9: "[]"}, 2), ({1: "[]"}, 0)])
def test_listing_ends_at_the_first_page_without_items(spark, serve, per_task, broken, end):
    path = serve(pages(12) | broken)
    got = datasource.listing(read(spark, path, start=1, last=20, pages_per_task=per_task)).collect()
    assert sorted((r.page, r.pos, json.loads(r.item)["id"]) for r in got) == [(p, k, p * 10 + k) for p in range(1, end + 1) for k in range(3)]


def test_a_range_is_a_partition(spark, serve):
    assert read(spark, serve(pages(9)), start=2, last=8, pages_per_task=3).rdd.getNumPartitions() == 3


def test_links(spark, serve):
    of = lambda items, then: json.dumps({"value": items, "next": then})
    path = serve({"a": of([1, 2], "a2"), "a2": of([3], "a"), "b": of([], "b2"), "b2": of(["x"], None), "c": of([9], "gone")})
    got = sorted((r.root, r.n, r.pos, r.item, r.state) for r in read(spark, path, "linked_pages", roots=json.dumps(["a", "b", "c", "a", "d"])).collect() if r.item)
    assert got == [("a", 1, 0, "1", "item"), ("a", 1, 1, "2", "item"), ("a", 2, 0, "3", "item"), ("b", 2, 0, "x", "item"), ("c", 1, 0, "9", "item")]
    states = {(r.root, r.n): r.state for r in read(spark, path, "linked_pages", roots='["c", "d", "b"]').collect()}
    assert states == {("c", 1): "item", ("c", 2): "failed", ("d", 1): "failed", ("b", 1): "empty", ("b", 2): "item"}


def test_corrupt_pages_are_read_row_by_row(spark, serve):
    one = {f"{i}-1": "[{" if i == 5 else json.dumps([f"r{i}"]) for i in range(10)}
    path = serve(one | {"0-4": '["r0","r1","r2","r3"]', "4-4": "[{", "8-2": '["r8"]'})
    got = {r.offset: (r.ok, r.item) for r in read(spark, path, "offset_rows", total=10, page=4, pages_per_task=1).collect()}
    assert got == {i: (i != 5, None if i == 5 else f"r{i}") for i in range(10)}


def test_stream_goes_on_after_the_last_page_it_read(spark, serve, tmp_path):
    path, seen = serve(pages(4)), []

    def run():
        stream = spark.readStream.format("json_pages").options(server=HERE, path=path, start=1, pages_per_task=2).load()
        query = stream.writeStream.foreachBatch(lambda df, n: seen.append(sorted({r.page for r in df.collect()}))).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        query.awaitTermination(60)
        query.stop()

    run()
    assert [p for batch in seen for p in batch] == [1, 2, 3, 4]
    serve({5: '[{"id": 50}]', 6: '[{"id": 60}]'})
    run()
    run()
    assert [p for batch in seen for p in batch] == [1, 2, 3, 4, 5, 6]


def test_nothing(spark, serve):
    path = serve({"x": "y"})
    assert datasource.listing(read(spark, path, start=1, last=0)).count() == 0 and read(spark, path, "linked_pages", roots="[]").count() == 0 and read(spark, path, "offset_rows", total=0).count() == 0


def test_addresses_are_read_alone_or_page_by_page(spark, serve):
    post = lambda i, text=None: {"id": i} | ({"content": {"rendered": text}} if text else {})
    path = serve({
        "http://h/a?tag=x&per_page=2&page=1": json.dumps([post(1, "one"), post(2)]), "http://h/a?tag=x&per_page=2&page=2": json.dumps([post(3, "three")]), "http://h/a?tag=x&per_page=2&page=4": json.dumps([post(9, "after the end")]),
        "http://h/b?page=7": json.dumps([post(4, "seven")]), "http://h/c?per_page=2&page=1": "[{", "http://h/c?per_page=2&page=2": json.dumps([post(5, "lost")]),
    })
    rows = read(spark, path, "web_listing", urls=json.dumps(["http://h/a?tag=x&per_page=50#top", "http://h/b?page=7", "http://h/c", "http://h/d"]), last=5, per_page=2, pages_per_task=2)
    listed = datasource.listing(rows)
    assert {(r.url, r.n_posts, r.text) for r in datasource.joined_posts(listed).collect()} == {("http://h/a?tag=x&per_page=50#top", 2, "one\n\nthree"), ("http://h/b?page=7", 1, "seven")}
    assert sorted((r.url, r.page, r.pos) for r in listed.collect() if r.url.startswith("http://h/a")) == [("http://h/a?tag=x&per_page=50#top", p, i) for p, i in ((1, 0), (1, 1), (2, 0))]


def test_payloads_lie_in_files_of_many_addresses(spark, serve, tmp_path):
    """Files grow with the addresses divided by PER_FILE; what each address gets stays, also of a second write."""
    many = {i: json.dumps([i]) for i in range(3000)} | {f"http://h/p?page={i}": json.dumps([f"p{i}"]) for i in range(500)} | {f"{i}-1": f'["{i}"]' for i in range(500)}
    path = serve(many)
    serve({"1": "[7]", "new": "[8]"})
    files = [f for f in (tmp_path / "served").rglob("part-*")]
    assert len(files) <= 2 + len(many) // datasource.PER_FILE + 1
    folder = datasource.Folder({"path": path})
    assert all(folder.fetch(str(a)) == p + "\n" for a, p in many.items() if a != 1)
    assert folder.fetch("1") == "[7]\n[1]\n" and folder.fetch("new") == "[8]\n" and folder.fetch("nobody") is None and folder.last() == 2999 and len(folder.read) <= datasource.KEPT


def test_many_ranges_share_tasks(spark, serve, monkeypatch):
    monkeypatch.setattr(datasource, "MAX_TASKS", 3)
    grouped = datasource._grouped(datasource._ranges(1, 21, 2))
    assert len(grouped) <= 3 and [(r.start, r.end) for g in grouped for r in g.parts] == [(a, a + 2) for a in range(1, 21, 2)]
