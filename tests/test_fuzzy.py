"""Best matches by q-grams against all pairs."""

import difflib
import random

import pytest

from ragspark.operators import fuzzy

WORDS = ["how", "do", "i", "reset", "my", "password", "the", "portal", "open", "invoice", "late", "é", "ß"]


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


RATIOS = {fuzzy.SEQUENCE: lambda a, b: difflib.SequenceMatcher(None, a, b).ratio(), fuzzy.LEVENSHTEIN: lambda a, b: 1 - edits(a, b) / max(len(a), len(b), 1)}


def texts():
    r = random.Random(3)
    base = [" ".join(r.choices(WORDS, k=r.randint(1, 9))) for _ in range(50)]

    def changed():
        s = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            if s:
                s[r.randrange(len(s))] = r.choice("abcxyz ")
        return "".join(s)

    long = " ".join(r.choices(WORDS, k=120))
    same = [(500 + i, f"Customer#{i:09d}") for i in range(30)]
    stored = [(i, changed()) for i in range(120)] + same + [(600, ""), (601, None), (602, "a"), (603, "ab"), (604, "A"), (605, long), (606, long[:-40]), *[(700 + i, "the same text") for i in range(60)]]
    asked = [(i, changed().upper()) for i in range(80)] + same + [(800, None), (801, ""), (802, "a"), (803, "b"), (804, long[9:]), *[(700 + i, "The same text") for i in range(3)]]
    return asked, stored


def brute(asked, stored, ratio, threshold, others):
    out = set()
    for q, a in asked:
        found = [(-round(ratio(a.lower(), b.lower()), fuzzy.DIGITS), k) for k, b in stored if a and b and not (others and k == q)]
        found = [x for x in found if -x[0] >= threshold]
        out |= {(q, k, -r) for r, k in [min(found)]} if found else set()
    return out


@pytest.mark.parametrize("measure, threshold, others, steps, longest", [(fuzzy.SEQUENCE, 0.7, False, fuzzy.STEPS, fuzzy.LIST), (fuzzy.SEQUENCE, 0.5, True, (0.9,), 7), (fuzzy.LEVENSHTEIN, 0.7, True, fuzzy.STEPS, 7)])
def test_best_match(spark, measure, threshold, others, steps, longest):
    asked, stored = texts()
    q, s = spark.createDataFrame(asked, "qid long, question string"), spark.createDataFrame(stored, "key long, stored_question string")
    got = [(r.qid, r.key, r.ratio) for r in fuzzy.best_match(q, s, threshold, measure, others, steps, longest).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(asked, stored, RATIOS[measure], threshold, others)


def test_texts_of_one_length_do_not_all_meet(spark):
    """Candidates of 2,000 texts of one length are a small part of all pairs, and hold every pair that is similar enough."""
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    rows = [(i, "".join(r.choices(letters, k=40))) for i in range(2000)]
    rows = [(i, rows[i - 1][1][:37] + "xyz") if i % 100 == 1 else (i, t) for i, t in rows]
    texts = spark.createDataFrame([(i, t, 40) for i, t in rows], "id long, text string, n int")
    from pyspark.sql import functions as F

    frequency = texts.select(F.explode(fuzzy._tokens("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    indexed = fuzzy._indexed(texts, frequency)
    pairs = {(x.q, x.s) for x in fuzzy.candidates(indexed, indexed, fuzzy.LEVENSHTEIN, 0.9, 50).collect()}
    assert len(pairs) < 0.05 * len(rows) ** 2 and all((i, i - 1) in pairs and (i - 1, i) in pairs for i in range(1, 2000, 100))


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_texts_much_alike(spark, threshold):
    """Names of few words and numbers, where tokens tell little: texts of few edits are found without the index of tokens."""
    r = random.Random(7)
    rows = [(i, f"{r.choice(['hot', 'old', 'blue'])} {r.choice(['bolt', 'ring'])} Brand#{r.randint(1, 12)} {r.randint(1, 40)}") for i in range(150)] + [(150 + i, t) for i, t in enumerate(["a", "ab", "abc", "b", "x" * 47, "x" * 48, "x" * 49, "x" * 50, "hot bolt"])]
    rows += [(200, None), (201, "")]
    q, s = spark.createDataFrame(rows, "qid long, question string"), spark.createDataFrame(rows, "key long, stored_question string")
    got = {(x.qid, x.key, x.ratio) for x in fuzzy.best_match(q, s, threshold, fuzzy.LEVENSHTEIN, others_only=True).collect()}
    assert got == brute(rows, rows, RATIOS[fuzzy.LEVENSHTEIN], threshold, True)


def test_numbered_names_need_no_tokens(spark, monkeypatch):
    """Names that differ in a digit are settled by one edit; most tokens are in all of them, so their index is not made."""
    monkeypatch.setattr(fuzzy, "_indexed", lambda *_: pytest.fail("index of tokens made"))
    names = spark.range(3000).selectExpr("id as qid", "concat('Supplier#', lpad(id, 9, '0')) as question")
    got = fuzzy.best_match(names, names.toDF("key", "stored_question"), 0.7, fuzzy.LEVENSHTEIN, others_only=True).collect()
    assert len(got) == 3000 and all(x.ratio == round(1 - 1 / 18, 6) for x in got)


def test_empty(spark):
    q, s = spark.createDataFrame([], "qid long, question string"), spark.createDataFrame([(1, "a")], "key long, stored_question string")
    assert fuzzy.best_match(q, s).count() == 0 and fuzzy.best_match(s.toDF("qid", "question"), q.toDF("key", "stored_question")).count() == 0


def test_query_against_all_pairs(spark):
    """The registered query without SQL, over its whole table."""
    from ragspark.plans import QUERIES

    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.qid, r.key, r.ratio) for r in QUERIES["join_fuzzy_ratio"](spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(items, items, RATIOS[fuzzy.SEQUENCE], 0.3, True)


@pytest.mark.parametrize("apart", [1, 2])
def test_near_pairs(spark, apart):
    """Every pair of different texts within so many edits is found once, texts with runs of equal characters included."""
    r = random.Random(11)
    rows = sorted({"", "a", "aa", "aaaa", "a" * fuzzy.SHORT, "a" * (fuzzy.SHORT + apart), *("".join(r.choices("abé", k=r.randint(1, 9))) for _ in range(150))})
    table = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(rows)], "id long, text string, n int")
    got = [tuple(x) for x in fuzzy._near(table.filter(table["n"] <= fuzzy.SHORT), table, apart).collect()]
    wanted = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and len(a) <= fuzzy.SHORT and edits(a, b) <= apart}
    assert len(got) == len(set(got)) and wanted <= set(got) and all(q != s for q, s in got)


def test_texts_do_not_pass_through_the_driver(spark):
    """What is left of texts is far more than their file, by whose size Spark chooses broadcasts; none of more than 24 MB is made (Spark takes 16 for the smallest by text)."""
    r = random.Random(13)
    rows = [(i, f"{r.choice(['hot', 'old', 'blue'])} {r.choice(['bolt', 'ring'])} Brand#{r.randint(1, 99)} {r.randint(1, 99)}") for i in range(3000)] + [(3000, "quite another text"), (3001, "yet quite another text")]
    names = spark.createDataFrame(rows, "qid long, question string")
    limit = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "24m")
    try:
        got = {x.qid: x.ratio for x in fuzzy.best_match(names, names.toDF("key", "stored_question"), 0.8, fuzzy.LEVENSHTEIN, others_only=True).collect()}
    finally:
        spark.conf.set(limit, before)
    assert got[3001] == round(1 - 4 / 22, 6) and got[3000] == got[3001] and got.keys() >= set(range(3000))
