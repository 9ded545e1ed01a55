"""Documents of a page: all from one pass over it."""

from ragspark.operators import pages


def test_a_page_is_parsed_once(spark):
    grid = "<table><tr><th>Feature</th><th>yes</th></tr><tr><td>a</td><td>b</td></tr></table>"
    rows = [("http://h/a?x=1", "A", grid + grid), ("http://h/b", "B", "  "), ("http://h/c", "C", None), ("http://h/d", "D", "<p>tail</p>")]
    made = pages.page_documents(spark.createDataFrame(rows, "url string, title string, html string"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = sorted((r.page_path, r.page_title, r.content_type, r.n, r.table_kind) for r in made.collect() if r.content_type == "table")
    assert got == [("/a", "A", "table", 0, "feature_matrix"), ("/a", "A", "table", 1, "feature_matrix")]
    assert sorted((r.page_title, r.content) for r in made.collect() if r.content_type == "text") == [("A", "Feature yes a b Feature yes a b"), ("D", "tail")]
