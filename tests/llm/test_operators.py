"""Each operator against brute force, on a fixture with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from ragspark.llm import classifier, decontaminate, license_scan, line_dedup, near_dedup, packing, quality_rules, queries, sharding, suffix_dedup, wavelet
from ragspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(3)
WORDS = re.compile(r"[a-z0-9]+")
VOCAB = ["w" + "".join(rng.choice(list("abcdefghé"), 5)) for _ in range(400)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(VOCAB, n)).replace(" wa", ". Wa")


BASE = prose(300, 1)
PASSAGE = prose(60, 2)
TEXTS = [
    None, "", "  \n\t ", "one two three", BASE, BASE, BASE.replace(VOCAB[5], "edited"), BASE[:-40], prose(120, 3) + "\n" + PASSAGE + "\n" + prose(80, 4), prose(90, 5) + "\n" + PASSAGE, PASSAGE + "\n" + PASSAGE,
    "All rights reserved.\n" + prose(70, 6), "x " * 400, prose(9000, 7), "Released under the MIT License.\n" + prose(60, 8), "a b  c d  e\x1fz\r\n" + prose(55, 9), prose(64, 10) + "!!! ### | | |", "ONE, two. THREE!\n" * 30,
]
DOCS = [(i, t, "zz", "keep") for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, _quality string, _lines string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    rows = df.collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows) == len(DOCS)
    return out


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_quality_rules(docs, empty):
    got = by_id(quality_rules.quality_report(docs))
    for i, t, *_ in DOCS:
        t = t or ""
        w = WORD.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k + j for k in range(len(w) - 2) for j in range(3) if grams[tuple(w[k : k + 3])] > 1}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert got[4].kept and got[8].kept and not got[12].kept
    clean = {r.doc_id: r for r in quality_rules.clean_documents(docs).collect()}
    assert clean[11].text == TEXTS[11].split("\n")[1] and clean[4]._quality == "zz"
    assert quality_rules.quality_report(empty).count() == 0 and quality_rules.clean_documents(empty).columns == docs.columns


@pytest.mark.parametrize("n", [2, 7])
def test_line_dedup(spark, docs, empty, n):
    rows = [(i, "\n".join(["common line of text", f"own line number {i}", "short", " Common LINE of text\t"])) for i in range(n * 40)]
    hot = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
    for df, data in ((docs, [(i, t) for i, t, *_ in DOCS]), (hot, rows)):
        where = collections.defaultdict(set)
        key = lambda x: fold(x.strip(" \t\n\x0b\x0c\r"))
        for i, t in data:
            for x in (t or "").split("\n"):
                where[key(x)].add(i)
        got = {r.doc_id: r["_out"] for r in line_dedup.deduplicated(df, "_out").collect()}
        for i, t in data:
            lines = (t or "").split("\n")
            kept = [x for x in lines if len(key(x)) < 10 or min(where[key(x)]) == i]
            assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.line_dedup(docs).columns == docs.columns
    assert line_dedup.line_dedup(empty).count() == 0


def test_wavelet_matrix_queries():
    ids = rng.integers(0, 700, 5000).astype(np.uint16)
    m, docs, lengths = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes(np.array([7, 9]), np.array([2000, 3000])))
    assert np.array_equal(m.decode(), ids) and docs.tolist() == [7, 9] and lengths.tolist() == [2000, 3000]
    for t in (0, 5, 699, 700, 65535):
        at = np.flatnonzero(ids == t)
        assert m.locate(t) == at.tolist() and m.count(t, 100, 4000) == int(((at >= 100) & (at < 4000)).sum())
    assert [m.access(i) for i in range(0, 5000, 371)] == ids[::371].tolist()
    assert m.select(int(ids[17]), 0) == int(np.flatnonzero(ids == ids[17])[0])


def encoded(name, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: t.encode(x or "", add_special_tokens=False).ids + [end] for i, x, *_ in DOCS}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_token_files(docs, empty, shard):
    want, at = encoded(wavelet.VOCABULARY, 1), 0
    got = by_id(wavelet.token_files(docs, shard_tokens=shard))
    for i in sorted(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want[i]), crc(want[i]))
        at += len(want[i])
    assert wavelet.token_files(empty).count() == 0


def test_packing(docs, empty):
    want = encoded(packing.VOCABULARY, 0)
    rows = packing.pack(docs, capacity=512).collect()
    bins = collections.defaultdict(list)
    for i, ids in want.items():
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert crc(ids[r.start : r.start + r.length]) == r.ids_crc32
            assert r.piece == 0 or r.length == 512
            bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) == -(-sum(map(len, want.values())) // 512)
    assert packing.pack(empty).count() == 0


def test_plan_is_tight():
    for seed in range(5):
        sizes = np.random.default_rng(seed).integers(1, 2049, 3000)
        histogram = dict(collections.Counter(sizes.tolist()))
        got = packing.plan(histogram)
        used = collections.Counter()
        for p, n in got:
            assert sum(p) <= 2048
            for s in p:
                used[s] += n
        assert used == histogram
        big = int((sizes > 1024).sum())
        assert sum(n for _, n in got) <= max(-(-int(sizes.sum()) // 2048), big) * 1.02 + 1
        assert packing.bounds(histogram) == (sum(n for _, n in got), packing.lower_bound(histogram, 2048))
    assert packing.pack_tail([6, 5, 5, 4, 4, 3, 3], 10) and len(packing.pack_tail([6, 4, 5, 5, 7, 3], 10)) == 3


def fewest(items, capacity):
    best = [len(items)]

    def place(i, bins):
        if i == len(items):
            best[0] = min(best[0], len(bins))
        elif len(bins) < best[0]:
            for b in range(len(bins)):
                if bins[b] + items[i] <= capacity:
                    place(i + 1, [*bins[:b], bins[b] + items[i], *bins[b + 1 :]])
            place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_tail_is_optimal_and_fillings_undominated():
    r = np.random.default_rng(8)
    for _ in range(60):
        capacity = int(r.choice([10, 20, 50]))
        items = sorted(r.integers(1, capacity + 1, int(r.integers(1, 9))).tolist(), reverse=True)
        got = packing.pack_tail(items, capacity)
        assert sorted(sum(got, [])) == sorted(items) and all(sum(x) <= capacity for x in got)
        assert packing.lower_bound(collections.Counter(items), capacity) <= len(got) == fewest(items, capacity)
    found = {x for _, x in packing.fillings(10, {6: 1, 4: 1, 3: 2, 2: 2, 1: 1}, better_than=False)}
    assert (6, 4) in found and (6, 3, 1) not in found  # 4 takes the place of 3 and 1
    assert packing.dominated((3, 1), 0, 1 << 4) and packing.dominated((3,), 1, 1 << 4) and not packing.dominated((4,), 0, 1 << 4)


def test_near_dedup(docs, empty):
    sets = {}
    for i, t, *_ in DOCS:
        w = WORD.findall(fold(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    got = by_id(near_dedup.near_duplicates(docs))
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), root[i], root[i] == i)
    assert sorted(r.doc_id for r in near_dedup.near_dedup(docs).collect()) == sorted(i for i in root if root[i] == i)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 160)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[j] == 100 for j in range(100, 160)) and 200 not in got


def test_suffix_dedup(docs, empty):
    raw = {i: (t or "").encode() for i, t, *_ in DOCS}
    seen = collections.Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    got = by_id(suffix_dedup.remove_repeats(docs))
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", gone.astype(np.uint8).tobytes()))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert len({(a - b) % 133 for a in suffix_dedup.COVER for b in suffix_dedup.COVER}) == 133


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE.replace(PASSAGE.split()[30], "other", 1)), (3, prose(40, 99)), (4, None), (5, "one two three"), (6, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(i, j) for i in (8, 9, 10) for j in (1, 2)} | {(3, 5), (17, 5)}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()} == set(range(len(DOCS))) - {3, 8, 9, 10, 17}
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def weights(words):
    return {tuple(words[i : i + 5]): sum(map(len, words[i : i + 5])) for i in range(len(words) - 4)}


def test_decontaminate_against_all_windows(spark):
    """Copies with words inserted, lost and replaced, and with their halves exchanged: the best of all windows is found."""
    r = np.random.default_rng(17)
    items = {i: prose(int(r.integers(20, 60)), 700 + i).replace(".", "").lower().split() for i in range(12)}
    rows = []
    for i, own in items.items():
        for j in range(10):
            copy = list(own)
            for _ in range(int(r.integers(0, 4))):
                at = int(r.integers(len(copy)))
                copy[at : at + int(r.integers(0, 3))] = ["new"] * int(r.integers(0, 3))
            if j % 4 == 3:
                copy = copy[len(copy) // 2 :] + copy[: len(copy) // 2]
            rows.append((100 * i + j, " ".join([*prose(25, 800 + i).replace(".", "").lower().split(), *copy, "end", "of", "text"])))
    want = {}
    for d, text in rows:
        words = text.split()
        for i, own in items.items():
            target = weights(own)
            for at in range(len(words) - len(own) + 1):
                x = weights(words[at : at + len(own)])
                alike = 2 * sum(v for g, v in x.items() if g in target) / (sum(x.values()) + sum(target.values()))
                if alike >= 0.8 and alike > want.get((d, i), (0, 0))[0] + 1e-12:
                    want[d, i] = (alike, at)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.similarity, x.start) for x in decontaminate.contaminated(docs, benchmark).collect()}
    # A pair beyond the fingerprints' radius may be missed; none here is.
    assert len(want) > 60 and set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_blocks_find_all_within_the_radius_and_few_others(spark):
    r = np.random.default_rng(3)
    fps = [int(x) for x in r.integers(-(2**63), 2**63, 400)]
    rows = []
    for i, x in enumerate(fps):
        flips = sum(1 << int(b) for b in r.choice(64, decontaminate.RADIUS, replace=False))
        rows.append((i, x, int(np.uint64((x & (1 << 64) - 1) ^ flips).astype(np.int64)), fps[(i + 1) % 400]))
    df = spark.createDataFrame(rows, "i int, x long, y long, z long").select("i", decontaminate._neighbours("x").alias("n"), decontaminate._blocks("y").alias("y"), decontaminate._blocks("z").alias("z"))
    near, far = df.selectExpr("sum(int(arrays_overlap(n, y)))", "avg(int(arrays_overlap(n, z)))").first()
    assert near == 400 and far < 0.3
    assert len(df.first().n) == decontaminate.NEIGHBOURS


def test_sharding(spark, docs, empty):
    rows = [(i, prose(20 + i % 30, i % 50)) for i in range(3000)] + [(3000 + i, "same text") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(df).collect()
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == 4500 and max(size.values()) - min(size.values()) < 0.02 * max(size.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len(by_id(sharding.shard(docs))) == len(DOCS) and sharding.shard(empty).count() == 0


def test_license_scan(docs, empty):
    got = {(r.doc_id, r.license): r for r in license_scan.scan_licenses(docs).collect()}
    assert set(got) == {(14, "MIT")} and got[14, "MIT"].start_word == 0
    assert license_scan.scan_licenses(empty).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan_licenses(docs, {"x": "too short"})


def test_license_scan_is_exact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs).collect()}
    want = {(r.doc_id, k) for r in docs.collect() for k in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0") if license_scan.TEMPLATES[k] in r.text}
    assert want <= got


def test_license_scan_finds_every_license_line(spark):
    """Against plain search for the five licence lines of the table, in both directions."""
    sf = "/root/testdata/sf0.01"
    names = {"MIT": license_scan.TEMPLATES["MIT"], "Apache-2.0": license_scan.TEMPLATES["Apache-2.0"], "GPL-3.0": license_scan.TEMPLATES["GPL-3.0"], "CC-BY-NC-4.0": license_scan.TEMPLATES["CC-BY-NC-4.0"], "All-rights-reserved": "All rights reserved."}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(i, k) for i, t in texts.items() for k, x in names.items() if x in (t or "")}
    got = {(r.doc_id, r.license) for r in queries.op4_license_scan(spark, sf).collect()}
    assert want == {(i, k) for i, k in got if k in names} and {k for _, k in want} == set(names)


def test_license_scan_finds_every_template(spark):
    templates = license_scan.all_templates()
    short = {k for k, x in templates.items() if len(re.findall(r"[A-Za-z0-9]+", x)) < 5}
    assert "All-rights-reserved" in short and "GPL-3-text" in templates
    rows = [(i, f"{prose(30, i)}\n{x}\n{prose(40, i)}") for i, x in enumerate(templates.values())]
    # Every thirtieth word of a longer template is lost: five of thirty shingles.
    rows += [(1000 + i, " ".join(w for j, w in enumerate(x.split()) if j % 30 != 29)) for i, (k, x) in enumerate(templates.items()) if k.endswith("-text")]
    rows += [(2000, "all rights"), (2001, "All rights not reserved."), (2002, "All rights\nRESERVED")]
    got = {(r.doc_id, r.license): r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), templates).collect()}
    for i, k in enumerate(templates):
        assert got[i, k].containment == 1.0 and (k not in short or got[i, k].start_word == 30)
        inside = {x for x, y in templates.items() if " ".join(["", *WORDS.findall(y.lower()), ""]) in " ".join(["", *WORDS.findall(templates[k].lower()), ""])}
        assert k.endswith("-text") or {x for d, x in got if d == i} == inside
        assert not k.endswith("-text") or any(d >= 1000 and x == k for d, x in got)
    assert {k for k in got if k[0] >= 2000} == {(2002, "All-rights-reserved")}


def test_classifier(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = classifier.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    got = by_id(classifier.score_quality(docs, labels.limit(0)))
    assert all(r.score == 0.5 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert classifier.score_quality(empty, labels).count() == 0
