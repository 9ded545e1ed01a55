"""Edge cases of lookups, paging, user times and vectors that the tables do not hold."""

import datetime

import pytest
from pyspark.sql import functions as F

from ragspark.operators import lookup, store, vector
from ragspark.sources import paged


def test_any_rule_matches_and_the_first_page_wins(spark):
    pages = [(2, "http://h/a/Setup%20Guide.aspx", "Setup Guide.aspx", "Guide"), (1, "http://h/b", None, "Set Up"), (3, None, "", None)]
    df = spark.createDataFrame(pages, "pos int, url string, name string, title string")
    got = {r["path"]: r["pos"] for r in lookup.page_lookup(df, ["/a/Setup Guide.aspx", "setup_guide", "absent"]).collect()}
    # The title of page 1 lies within both file names, so it comes before the exact name of page 2.
    assert got == {"/a/Setup Guide.aspx": 1, "setup_guide": 1}


def test_too_many_targets_are_refused(spark):
    with pytest.raises(ValueError):
        lookup.first_mention(spark.createDataFrame([(1, "t")], "doc_id int, text string"), [str(i) for i in range(lookup.MAX_TARGETS + 1)], "text")


def test_unquote_keeps_plus_and_broken_escapes(spark):
    df = spark.createDataFrame([("a+b%20c",), ("100%zz",), (None,)], "u string")
    assert [r[0] for r in df.select(lookup.unquote(F.col("u"))).collect()] == ["a+b c", "100%zz", None]


def test_site_address(spark):
    df = spark.createDataFrame([("https://h/sites/x/page?q=1",), ("https://h/sites",), ("https://h/a/b",), (None,)], "u string")
    assert [r[0] for r in df.select(lookup.site_address(F.col("u"), "api/")).collect()] == ["api/h:/sites/x", None, None, None]


def test_listing_ends_at_the_first_bad_page(spark):
    df = spark.createDataFrame([(1, '["a"]'), (2, "{broken"), (3, '["b"]')], "page long, payload string")
    assert [tuple(r) for r in paged.items_of_pages(df).collect()] == [(1, 0, "a")]
    assert paged.items_of_pages(df.filter("page = 2")).count() == 0
    assert paged.items_of_pages(df.filter("page <> 2")).count() == 2
    assert paged.items_of_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("last", [None, "p/0", "p/90", "gone"])
def test_links_are_followed_to_the_end(spark, last):
    rows = [(f"p/{i}", f"x{i}", f"p/{i + 1}" if i < 259 else last) for i in range(260)] + [("stray", "y", "p/5"), (None, "z", None)]
    df = spark.createDataFrame(rows[::-1], "address string, payload string, next string").coalesce(2)
    assert sorted(map(tuple, paged.follow_links(df, "p/0").collect())) == [(i + 1, f"p/{i}", f"x{i}") for i in range(260)]
    assert paged.follow_links(df, "absent").count() == 0


def test_iso_times(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02 03:04", "2024-01-02", "2024", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(store.coerce_time(F.col("t"))).collect()]
    assert got[1:] == [datetime.datetime(2024, 1, 2, 3, 4), datetime.datetime(2024, 1, 2), None, None, None]
    assert got[0] is not None


def test_vectors_that_do_not_fit_are_made_anew(spark):
    rows = spark.createDataFrame([(1, "a b", [1.0, 0.0]), (2, "a b", [1.0]), (3, None, None)], "id int, text string, embedding array<double>")
    got = {r["id"]: r for r in store.migrate_vectors(rows, 2, vector.embed_hashing).collect()}
    assert [got[i]["copied"] for i in (1, 2, 3)] == [True, False, False]
    assert got[1]["embedding"] == [1.0, 0.0] and len(got[2]["embedding"]) == 2 and got[3]["embedding"] == [0.0, 0.0]


def test_query_passes_give_the_same_hits(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    queries = rows.filter("vec_id < 9").withColumnRenamed("vec_id", "qid")
    once = sorted(map(tuple, vector.batch_top_k(rows, queries, 4).collect()))
    monkeypatch.setattr(vector, "MAX_QUERIES", 6)
    assert sorted(map(tuple, vector.batch_top_k(rows, queries, 4).collect())) == once and len(once) == 36
    assert vector.batch_top_k(rows, queries.limit(0), 4).count() == 0
