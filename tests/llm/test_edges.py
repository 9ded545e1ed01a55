"""Repeated and null doc_ids, awkward column names, added tokens and very long texts."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from test_operators import fold, prose

from ragspark.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules, sharding, suffix_dedup, wavelet

PASSAGE = prose(70, 501)
OWN = [f"the own line number {i} of a text" for i in range(8)]
#: doc_id repeated with other texts and with the same text, null doc_ids, null and empty texts.
ROWS = [
    (1, "a line that is shared\n" + OWN[0]), (2, "a line that is shared\n" + OWN[1] + "\n" + PASSAGE), (2, OWN[2] + "\n" + OWN[3]), (2, OWN[2] + "\n" + OWN[3]), (2, PASSAGE), (3, None), (3, ""), (3, "A LINE that is shared \n" + prose(12_000, 502)),
    (None, "a line that is shared\n" + OWN[4] + "\n" + prose(40, 503) + PASSAGE), (None, prose(40, 503)), (None, None), (4, OWN[2] + "\nshort\n" + PASSAGE[:300]), (5, PASSAGE[:-3] + "é" + prose(80, 504)), (1, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)


def test_line_dedup_by_row(docs):
    holders = collections.defaultdict(set)
    key = lambda x: fold(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in ROWS:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                holders[key(x)].add(i)
    want = collections.Counter()
    for i, t in ROWS:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or key(x) not in holders or min(holders[key(x)]) == i]
        want[i, len(lines), len(lines) - len(left), "\n".join(left)] += 1
    got = collections.Counter((r.doc_id, r.x.n_lines, r.x.n_dropped, r.x.text) for r in line_dedup.deduplicated(docs, "x").collect())
    assert got == want


def test_suffix_dedup_by_row(docs):
    raw = [(i, (t or "").encode()) for i, t in ROWS]
    seen = collections.Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = collections.Counter()
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == want and any(k[0] is None and k[2] for k in got)


def test_strings_with_equal_polynomial_hashes_stay_apart(spark):
    """The Thue-Morse word of 4096 letters and its complement have equal hashes modulo 2**64, whatever the base."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    raw = [word.encode(), ("-" + other).encode()]
    seen = collections.Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    want = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            gone[k : k + 200] |= seen[b[k : k + 200]] > 1
        want.append(int(gone.sum()))
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(b.decode() for b in raw)), "doc_id long, text string")).collect()
    assert [r.n_removed for r in sorted(rows, key=lambda r: r.doc_id)] == want


def test_columns_of_any_name(spark):
    names = ["doc_id", "text", "a.b", "_lines_keep", "_lines_doc_id", "_lines_version", "_gone", "_leak", "_lines", "_quality", "c`d", "n_chars"]
    rows = [(i, f"{t}\n{prose(60, i)}.", *["v"] * 9, 5) for i, t in enumerate(["one common line of text", "one common line of text"])]
    df = spark.createDataFrame(rows, ", ".join("`{}` {}".format(n.replace("`", "``"), "long" if n in ("doc_id", "n_chars") else "string") for n in names))
    items = spark.createDataFrame([(1, "nothing that any of the texts holds")], "item_id long, text string")
    for out in (quality_rules.clean_documents(df), line_dedup.line_dedup(df), near_dedup.near_dedup(df), decontaminate.decontaminate(df, items)):
        got = out.collect()
        assert out.columns == names and len(got) == 2 and all(r["a.b"] == "v" and r["_lines_keep"] == "v" for r in got)


TOKENS = ["hello <|endoftext|> world", "<|startoftext|><|endoftext|>", "x<|ENDOFTEXT|>y", "a <|endoftext| > b, c.", None, "plain words only.", "ends in <|endoftext|>", "né <|endoftext|>é"]


def test_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(list(enumerate(TOKENS)), "doc_id long, text string").coalesce(1)
    for name, end, got in ((wavelet.VOCABULARY, 1, wavelet.token_files(docs)), (packing.VOCABULARY, 0, packing.pack(docs))):
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        ids = [plain.encode(t or "", add_special_tokens=False).ids + [end] for t in TOKENS]
        assert {r.doc_id: r.ids_crc32 for r in got.collect()} == {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in enumerate(ids)}


@pytest.mark.parametrize("doc_id", [7, None])
def test_sharding_splits_rows_that_are_equal_in_all(spark, doc_id):
    """Half of the rows are one text of one doc_id, or of none; a law of equal bytes holds for these too."""
    rows = [(i, prose(1 + i % 9, i)) for i in range(1500)] + [(doc_id, PASSAGE[:60])] * 1500
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = collections.Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    sizes = [sum(r.size for r in shards[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 8 and all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in shards.values())
    # No other text is split.
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r.text_crc32].add(r.shard)
    assert all(len(k) == 1 for c, k in by_text.items() if c != zlib.crc32(PASSAGE[:60].encode()))


def test_decontamination_of_repeated_and_null_ids(spark):
    item, clean = prose(30, 601), prose(50, 602)
    rows = [(None, f"{prose(20, 603)} {item} {prose(9, 604)}"), (1, f"{item} {prose(30, 605)}"), (1, clean), (None, clean), (None, item), (2, clean), (None, None), (3, ""), (1, f"{item} {prose(30, 605)}")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, item), (None, None)], "item_id long, text string")
    assert sorted((r.doc_id is None, r.item_id, r.similarity) for r in decontaminate.contaminated(docs, items).collect()) == [(False, 5, 1.0), (True, 5, 1.0)]
    kept = collections.Counter((r.doc_id, r.text) for r in decontaminate.decontaminate(docs, items).collect())
    assert kept == collections.Counter({(1, clean): 1, (None, clean): 1, (2, clean): 1, (None, None): 1, (3, ""): 1})
