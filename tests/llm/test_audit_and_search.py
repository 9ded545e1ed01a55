"""Source divergence, nearest neighbours and lexical search against brute force, with nulls, ties, repeats and empty tables."""

import collections
import math
import re

import numpy as np
import pytest

from ragspark.llm import divergence, hnsw, lexical
from ragspark.llm.terms import WORDS, WORDS_AND_DIGITS, terms_of

LETTERS, ALNUM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
rng = np.random.default_rng(11)
VOCABULARY = ["".join(rng.choice(list("abcdeéß"), 3)) for _ in range(60)]
BY_ZIPF = 1 / np.arange(1, len(VOCABULARY) + 1)


def prose(n):
    return " ".join(rng.choice(VOCABULARY, n, p=BY_ZIPF / BY_ZIPF.sum()))


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


#: (doc_id, text, lang, source): a source with over a third of the rows, equal rows, nulls and empty texts, a language without kept terms, one of one source.
ROWS = [(i, prose(int(rng.integers(1, 80))), "en", "hot" if i % 5 < 2 else f"s{i % 4}") for i in range(120)]
ROWS += [(7, "Same ROW again, same row", "en", "s1")] * 4 + [(200, None, "en", "silent"), (201, "", None, None), (202, "x1y2 é_É Straße", None, "s0"), (None, prose(30), "fr", "one"), (None, prose(30), "fr", "one"), (203, prose(30), "fr", "one")]
ROWS += [(300 + i, prose(20), "de", f"d{i}") for i in range(2)] + [(310, prose(3000), "en", "long")]
SCHEMA = "doc_id long, text string, lang string, source string, `a.b` string, term string, g int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in ROWS], SCHEMA).repartition(5)


def test_terms_are_the_patterns_matches():
    for text in ("", "A1b-c É\x7fß\n12 _x\x00y", prose(50), "Zürich 2024: ÀB c"):
        assert [t.decode() for t in terms_of(text.encode(), WORDS)] == [fold(t) for t in LETTERS.findall(text)]
        assert [t.decode() for t in terms_of(text.encode(), WORDS_AND_DIGITS)] == [fold(t) for t in ALNUM.findall(text)]


def brute_audit(rows, min_docs, k):
    counts, holders = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        terms = [fold(t) for t in LETTERS.findall(text or "")]
        counts[lang or "", source or ""].update(terms)
        holders[lang or ""].update(set(terms))
    out = set()
    for lang in {x for x, _ in counts}:
        kept = [t for t, n in holders[lang].items() if n >= min_docs]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = collections.Counter()
        for c in groups.values():
            whole.update({t: c[t] for t in kept if c[t]})

        def chance(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: chance(c) for s, c in groups.items()}, chance(whole)
        for s, c in groups.items():
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, k)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])}
    return out


@pytest.mark.parametrize("k", [200, 3])
def test_divergence(docs, k):
    got = [tuple(r) for r in divergence.audit(docs, 3, k).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(ROWS, 3, k)


def test_divergence_stops_early(spark):
    """Terms whose bucket cannot reach the k-th value are not evaluated."""
    rows = [(0, f"t{i}", 1 + i % 900, 1_000 + 100 * (i % 900), 1_000) for i in range(20_000)]
    scored, rounds = spark.createDataFrame(rows, "g long, term string, n long, p long, q long"), []
    got = [(r.term, r.value, r.rank) for r in divergence.top_terms(scored, 20, rounds).orderBy("rank").collect()]
    want = sorted(((f"t{i}", (p - q) ** 2 // q) for _, (_, _, _, p, q), i in ((0, r, int(r[1][1:])) for r in rows) if p > q), key=lambda x: (-x[1], x[0]))[:20]
    assert [g[:2] for g in got] == want and sum(rounds) < 6_000


def test_pair_sums_in_steps(spark, docs, monkeypatch):
    """Few pairs at once and few held terms give the same."""
    want = brute_audit(ROWS, 3, 5)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(divergence, "HELD_TERMS", 10)
    assert {tuple(r) for r in divergence.audit(docs, 3, 5).collect()} == want


def brute_nearest(rows, every, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    queries = {}
    for i, v in ok:
        if i % every == 0 and (i not in queries or (len(v), tuple(v)) < (len(queries[i]), tuple(queries[i]))):
            queries[i] = v
    out = {}
    for i, v in queries.items():
        found = sorted((math.sqrt(((w - v) ** 2).sum()), j) for j, w in ok if j != i and len(w) == len(v))
        out[i] = [(j, d) for d, j in found[:k]]
    return out


def vectors():
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + r.normal(size=8) * (0.001 if i % 6 == 0 else 0.4)).tolist()) for i in range(900)]
    rows += [(i, rows[5][1]) for i in range(1000, 1030)] + [rows[0]] * 3 + [(2000 + i, [1.0, float(i)]) for i in range(4)]
    return rows + [(3000, None), (3010, [0.0] * 8), (3020, [1.0, None] * 4), (3030, [float("nan")] * 8), (3040, [float("inf")] + [1.0] * 7), (None, rows[1][1]), (3050, [])]


@pytest.mark.parametrize("shard", [4096, 200, 60])
def test_nearest(spark, shard):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, shard int").repartition(4)
    want, got = brute_nearest(rows, 10, 10), collections.defaultdict(list)
    for r in hnsw.nearest(df, 10, 10, shard).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == {q for q, found in want.items() if found}
    exact = sum(len({j for j, _ in got[q]} & {j for j, _ in w}) for q, w in want.items()) / sum(len(w) for w in want.values())
    assert exact >= 0.97 and all(len(got[q]) == len(w) and got[q] == sorted(got[q], key=lambda x: (x[1], x[0])) for q, w in want.items())
    by_id = {j: v for j, v in rows if v}
    assert all(abs(math.dist(by_id[q], by_id[j]) - d) < 1e-12 for q, found in got.items() for j, d in found)


def test_graph_finds_its_way():
    """Recall of one shard's graph, near copies in the way, against all distances."""
    r = np.random.default_rng(8)
    x = np.vstack([r.normal(size=(1500, 32)), np.ones(32) + 1e-4 * r.normal(size=(600, 32))])
    q = r.normal(size=(50, 32))
    nodes, d = hnsw.beam(x, hnsw.graph(x), q)
    hit = 0
    for i in range(len(q)):
        far = ((x - q[i]) ** 2).sum(1)
        hit += len(set(np.argsort(far)[:10]) & set(nodes[i][np.argsort(d[i])[:10]]))
    assert hit / (10 * len(q)) >= 0.95


def test_links_are_bounded_and_levels_thin_out():
    x = np.random.default_rng(1).normal(size=(800, 4))
    levels = hnsw.graph(x, 8)
    assert [b.shape[1] for _, b in levels] == [16] + [8] * (len(levels) - 1) and len(levels) > 1
    assert all(len(a[0]) > len(b[0]) and set(b[0]) <= set(a[0]) for a, b in zip(levels, levels[1:], strict=False))
    assert all((row[row >= 0] != i).all() for i, row in enumerate(levels[0][1]))


def brute_search(docs, items, k):
    terms = [(i, [fold(t) for t in ALNUM.findall(text)]) for i, text in docs if text is not None]
    terms = [(i, collections.Counter(t), len(t)) for i, t in terms if t]
    n_docs, n_terms = len(terms), sum(n for _, _, n in terms)
    df = collections.Counter(t for _, c, _ in terms for t in c)
    out = collections.Counter()
    for item, text in items:
        asked, scores = [fold(t) for t in ALNUM.findall(text or "")], []
        for i, c, n in terms:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scores)[:k]):
            out[item, rank + 1, i, -score] += 1
    return out


ITEMS = [(1, "Straße aab X1Y2"), (2, None), (3, ""), (4, "nothing known here"), (5, "Same same ROW"), (5, "Same same ROW"), (6, "the same"), *[(10 + i, prose(6)) for i in range(12)]]


@pytest.mark.parametrize("tiers", [lexical.TIERS, ((0.02, 1), (0.2, 4)), ()])
def test_ranked_search(spark, docs, tiers, monkeypatch):
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id long, text string, doc_id int")
    proven = []
    got = collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.ranked_search(docs, items, 10, tiers, proven.append).collect())
    assert got == brute_search([r[:2] for r in ROWS], ITEMS, 10)
    assert all(len(p) <= len(tiers) + 1 for p in proven)


def test_search_in_blocks_and_tiers(spark, monkeypatch):
    """Small blocks; rare terms that a few documents repeat are proven in the first tier, common ones fall through."""
    rows = [(i, "common words " * int(1 + i % 7) + ("rare " * 9 if i % 40 == 0 else "") + prose(3)) for i in range(800)]
    items = [(1, "rare rare rare"), (2, "common"), (3, "rare common words"), (4, VOCABULARY[0])]
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 20)
    docs, asked, proven = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), []
    got = collections.Counter(map(tuple, lexical.ranked_search(docs, asked, 10, ((0.05, 12), (0.3, 30)), proven.append).collect()))
    assert got == brute_search(rows, items, 10) and len(proven) > 1 and sum(p[0] for p in proven) >= 1


def test_empty_tables(spark):
    docs, items, store = (spark.createDataFrame([], s) for s in (SCHEMA, "item_id long, text string", "vec_id long, embedding array<float>"))
    some, asked = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [df.count() for df in (divergence.audit(docs), hnsw.nearest(store), lexical.ranked_search(docs, asked), lexical.ranked_search(some, items), lexical.ranked_search(docs, items))] == [0] * 5
