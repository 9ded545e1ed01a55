"""Chunking: cuts found by search against pieces put together one by one, and every text cut or parsed once."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from ragspark.operators import composition, rebuild, text
from ragspark.plans import QUERIES


def put_together(pieces, size, overlap):
    out, held, total = [], deque(), 0
    for piece in pieces:
        if held and total + len(piece) > size:
            out.append("".join(held))
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.popleft())
        held.append(piece)
        total += len(piece)
    return [x for x in (t.strip() for t in [*out, "".join(held)]) if x]


def by_pieces(body, size, overlap, separators):
    at = next((i for i, s in enumerate(separators) if s == "" or s in body), None)
    if at is None or separators[at] == "":
        return put_together(list(body) if at is not None else [body], size, overlap)
    first, *rest = body.split(separators[at])
    out, short = [], []
    for piece in [first, *(separators[at] + x for x in rest)]:
        if len(piece) < size:
            short += [piece] if piece else []
            continue
        out += put_together(short, size, overlap)
        short = []
        out += by_pieces(piece, size, overlap, separators[at + 1 :]) if separators[at + 1 :] else [piece]
    return out + put_together(short, size, overlap)


def test_cuts_are_those_of_pieces_put_together():
    r = random.Random(2)
    every = [p[2] for p in text.PROFILES.values()] + [["---"], ["\n\n", " "], ["a", " | ", ""]]
    for _ in range(5000):
        body = "".join(r.choices(["a", "b", " ", "\n", "\n\n", ". ", " | ", "---", "é", "-", "cc" * r.randint(1, 12)], k=r.randint(1, 40)))
        size, overlap, separators = r.choice([1, 2, 3, 5, 8, 13, 30]), r.choice([0, 1, 2, 4, 7, 12]), r.choice(every)
        assert text.split_text(body, size, overlap, separators) == by_pieces(body, size, overlap, separators), (body, size, overlap, separators)


def passes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_a_text_is_cut_once(spark):
    docs = spark.createDataFrame([(1, "a b " * 900), (2, ""), (3, None)], "doc_id long, text string")
    cut, recursive = composition.chunk_by_profile(docs, F.lit("pdf")), text.chunk_recursive(docs)
    assert passes(cut) == 1 and passes(recursive) == 1
    assert {r.doc_id for r in cut.collect()} == {1} == {r.doc_id for r in recursive.collect()}


@pytest.mark.parametrize("body, want", [("", ""), (" \n ", ""), ("  a\t\tb ", "a b"), (" ".join(map(str, range(30))), " ".join(map(str, range(20)))), ("x\n" * 20, " ".join("x" * 20))])
def test_first_words(spark, body, want):
    assert spark.createDataFrame([(body,)], "t string").select(text.first_words(F.col("t"))).first()[0] == want
    assert spark.createDataFrame([(None,)], "t string").select(text.first_words(F.col("t"))).first()[0] is None


@pytest.mark.parametrize("name", ["chunk_again", "chunk_file_metadata"])
def test_few_bytes_that_make_long_texts_are_dealt_out(spark, name):
    assert "Repartition" in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_a_post_is_cleaned_and_cut_in_one_pass(spark):
    page = "<h1>T</h1><script>x</script><p>" + "a b " * 900 + "</p>"
    bodies = {1: page, 2: "<p> </p>", 3: None, 4: ""}
    posts = spark.createDataFrame([(i, json.dumps({"content": {"rendered": b}})) for i, b in bodies.items()] + [(5, None), (6, "{}")], "id long, item string")
    made = rebuild.web_documents(posts, "all")
    assert passes(made) == 1
    got = sorted((r.id, r.chunk_index, r.total_chunks, r.text) for r in made.collect())
    want = text.split_text(text.html_text(page), *text.PROFILES["web"])
    assert len(want) > 2 and got == [(1, i, len(want), t) for i, t in enumerate(want)]
