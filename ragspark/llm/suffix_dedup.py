"""Operator 7, exact substring dedup: every byte of a 200-byte string that also starts elsewhere is removed.

Suffixes are compared blockwise, by hashes: equal ones are found, no order among unequal ones is kept and no ranks are made. Positions whose offset in the text lies in a difference cover modulo 133 are
the samples: for any two positions i, j there is one shift below 133 that takes both to samples, so two equal 200-byte
strings always hold equal sample cores (the 68 bytes after a sample) at the same shift. Samples come
first: the hashes of their cores are dealt into buckets and one bucket at a time is sorted, equal neighbours being
ties. Only suffixes whose 200 bytes hold a tied sample can have an equal partner; all others are settled.
Long ties (copies of whole passages) are resolved in the same pass by longer sampled strings, from one
content-chosen position to the next plus 200 bytes: where such a string is tied, every suffix in it is, and
only one of the equal strings goes on to be compared with others. The suffixes that are left, those near the
ends of common passages, and those of the one string kept of each tie, are sorted bucket by bucket in turn, by
all 200 bytes.

Equal strings always have equal keys, so nothing is missed. The keys that only choose candidates (sampled cores) are 40 bits inside a
bucket chosen by other bits. The keys that decide a removal are 56 bits of that hash and, of another with a base and byte values of
its own, 32 bits for long strings and 8 for windows, again inside a bucket; strings of over LONG_SPAN bytes, long enough for unequal ones whose polynomial
hashes agree to be constructed, are keyed by BLAKE2 instead.

What a task holds is one bucket. A string that very many texts share doesn't swell its bucket: repeats inside a map
task's few MB are settled there and one of them is sent on.

Defined cases: null text is empty; texts under 200 bytes lose nothing; equal texts of 200 bytes or more are
removed whole; every row is a text of its own, whether its doc_id is repeated or null (such rows are told apart by a hash of
doc_id and text, others by doc_id); doc_id is of an integer type; other columns are not carried. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BYTE_VALUES, U64, mix, powers, prefix_hash, spans_hash, text_pieces
from .scratch import materialize, partitions

LENGTH = 200
#: A perfect difference set: every residue modulo 133 is a difference of two members exactly once.
MODULUS = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
CORE = LENGTH - MODULUS + 1
#: One window in so many, chosen by its own bytes, ends a long string.
SPAN_RATE = 32
#: A text's marks come back from each bucket that has some, so small inputs use as many buckets as medium ones.
MIN_BUCKETS = 64
CORES, SPANS, WINDOWS, KEEPERS = 0, 1, 2, 3
#: Bytes of a key that travel, and of its second part.
_KEY_BYTES = {CORES: (5, 0), SPANS: (7, 4), WINDOWS: (7, 1)}
#: Longer strings are keyed by BLAKE2.
LONG_SPAN = 700
_BASE2 = 0xD1342543DE82EF95
_VALUES2 = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def _second(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    """A few bits of a hash of data[start:end] that shares neither base nor byte values with the first."""
    bits = 8 * _KEY_BYTES[kind][1]
    pw, ip = powers(len(data) + 1, _BASE2)
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(_VALUES2[data] * pw[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * ip[starts]) >> U64(64 - bits)


def _rekey_long(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, second: np.ndarray) -> None:
    for i in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        keys[i] = int.from_bytes(digest[:8], "little")
        second[i] = int.from_bytes(digest[8:12], "little")


def _order(keys: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal strings together, and where a string differs from the one before."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    k = keys[order]
    new[1:] = k[1:] != k[:-1]
    if second is not None and len(keys):
        x = second[order]
        if (~new[1:] & (x[1:] != x[:-1])).any():  # equal first parts of unequal strings: very rare
            order = np.lexsort((second, keys))
            k, x = keys[order], second[order]
            new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
    return order, new


def _planes(x: np.ndarray, width: int) -> bytes:
    """Little-endian integers, byte position by byte position: the high bytes are mostly zero and compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _bundles(kind: int, keys: np.ndarray, second: np.ndarray | None, pos: np.ndarray, doc: np.ndarray, ids: np.ndarray, buckets: int, out: list) -> None:
    """Rows for keys found at ``pos`` of the texts ``doc``: one for each bucket, and marks for repeats found right here."""
    if not len(keys):
        return
    order, new = _order(keys, second)
    alone = new.copy()
    alone[:-1] &= new[1:]
    tied = np.zeros(len(keys), bool)
    tied[order[~alone]] = True
    _marks(kind, pos[tied], doc[tied], ids, buckets, out)
    first = np.zeros(len(keys), bool)
    first[order[new]] = True
    first = np.flatnonzero(first)  # in the order of text and position
    bucket = ((keys[first] >> U64(40)) % U64(buckets)).astype(np.uint32 if buckets > 65535 else np.uint16)
    order = np.argsort(bucket, kind="stable")
    first, bucket = first[order], bucket[order]
    again = tied[first]
    ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
    a = 0
    for b in ends.tolist():
        at = first[a:b]
        d, counts = np.unique(doc[at], return_counts=True)
        p = pos[at]
        step = np.diff(p, prepend=0)
        heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
        step[heads] = p[heads]
        width, more = _KEY_BYTES[kind]
        raw = _planes(mix(keys[at]), width) + (_planes(second[at], more) if more else b"")
        out.append((kind, int(bucket[a]), None, raw, _planes(step, 4), np.packbits(again[a:b]).tobytes(), _planes(np.diff(ids[d].view(np.uint64), prepend=U64(0)), 8), _planes(counts, 4)))
        a = b


def _marks(kind: int, pos: np.ndarray, doc: np.ndarray, ids: np.ndarray, buckets: int, out: list) -> None:
    """One row for each text: positions whose key occurs elsewhere, each as its distance from the one before."""
    if not len(pos):
        return
    heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    for a, b in zip(heads.tolist(), np.append(heads[1:], len(doc)).tolist(), strict=True):
        out.append((kind, int(ids[doc[a]]) % buckets, int(ids[doc[a]]), np.diff(pos[a:b], prepend=0).astype("<u4").tobytes(), None, None, None, None))


_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("text_id", pa.int64()), ("keys", pa.binary()), ("step", pa.binary()), ("again", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])
_DDL = "kind int, bucket int, text_id long, keys binary, step binary, again binary, docs binary, counts binary"


def _batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _span_ends(prefix: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions, and their texts, of the 200-byte windows chosen by their own bytes."""
    m = len(prefix) - LENGTH
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, ip = powers(len(prefix))
    mark = ((prefix[LENGTH:] - prefix[:m]) * ip[:m] * U64(0x9FB21C651E98DF25)) >> U64(59)
    ends = np.flatnonzero(mark < U64(32 // SPAN_RATE))
    doc = np.searchsorted(offsets, ends, "right") - 1
    whole = ends + LENGTH <= offsets[doc + 1]
    return ends[whole], doc[whole]


def _samples(buckets: int):
    cover = np.array(COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_pieces(batches):
            out: list = []
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            prefix = prefix_hash(data, BYTE_VALUES)
            blocks = -(-np.diff(offsets) // MODULUS)
            doc = np.repeat(np.arange(len(blocks)), blocks)
            at = ((np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks))[:, None] * MODULUS + cover).ravel()
            doc = np.repeat(doc, len(cover))
            where = offsets[doc] + at
            whole = where + CORE <= offsets[doc + 1]
            where, at, doc = where[whole], at[whole], doc[whole]
            _bundles(CORES, spans_hash(prefix, where, where + CORE), None, at, doc, ids, buckets, out)
            ends, doc = _span_ends(prefix, offsets)
            pair = np.flatnonzero(doc[1:] == doc[:-1])
            a, b, doc = ends[pair], ends[pair + 1] + LENGTH, doc[pair]
            keys, second = spans_hash(prefix, a, b), _second(data, a, b, SPANS)
            _rekey_long(data, a, b, keys, second)
            _bundles(SPANS, keys, second, a - offsets[doc], doc, ids, buckets, out)
            if out:
                yield _batch(out)

    return run


def _sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort the keys of this task's buckets, one bucket and kind at a time; equal neighbours are marked."""
    held: list[dict] = []
    for batch in batches:
        found = batch.filter(pc.is_null(batch.column(7)))
        if found.num_rows:
            yield found
        for row in batch.filter(pc.is_valid(batch.column(7))).to_pylist():
            if held and (row["bucket"], row["kind"]) != (held[0]["bucket"], held[0]["kind"]):
                yield from _sorted(held)
                held = []
            held.append(row)
    if held:
        yield from _sorted(held)


def _sorted(held: list[dict]) -> Iterator[pa.RecordBatch]:
    width, more = _KEY_BYTES[held[0]["kind"]]
    size = np.array([len(r["keys"]) // (width + more) for r in held])
    flat = np.concatenate([_unplanes(r["keys"][: n * width], width) for r, n in zip(held, size.tolist(), strict=True)])
    second = np.concatenate([_unplanes(r["keys"][n * width :], more) for r, n in zip(held, size.tolist(), strict=True)]) if more else None
    again = np.concatenate([np.unpackbits(np.frombuffer(r["again"], np.uint8), count=int(n)) for r, n in zip(held, size, strict=True)]).astype(bool)
    order, head = _order(flat, second)
    tie = ~head
    tie[:-1] |= ~head[1:]
    tied, keeper = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    tied[order] = tie
    if held[0]["kind"] == SPANS:  # one of each tied string, in whose place all its suffixes are compared with others
        any_again = np.add.reduceat(again[order], np.flatnonzero(head))[np.cumsum(head) - 1] > 0
        keeper[order] = head & (tie | any_again)
    tied &= ~again  # those were marked where they were found
    for row, a, b in zip(held, np.cumsum(size) - size, np.cumsum(size), strict=True):
        hit, keep = np.flatnonzero(tied[a:b]), np.flatnonzero(keeper[a:b])
        if not len(hit) and not len(keep):
            continue
        out: list = []
        counts = _unplanes(row["counts"], 4).astype(np.int64)
        ids = np.cumsum(_unplanes(row["docs"], 8)).view(np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        steps = np.cumsum(_unplanes(row["step"], 4).astype(np.int64))
        heads = np.cumsum(counts) - counts
        pos = steps - np.repeat(np.where(heads > 0, steps[np.maximum(heads - 1, 0)], 0), counts)
        _marks(row["kind"], pos[hit], doc[hit], ids, 1, out)
        _marks(KEEPERS, pos[keep], doc[keep], ids, 1, out)
        yield _batch(out)


def _tied(rows: DataFrame, buckets: int) -> DataFrame:
    """(text_id, marks): positions of all keys that occur twice or more."""
    sent = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")
    return sent.mapInArrow(_sort_bucket, _DDL).groupBy("text_id").agg(F.collect_list(F.struct("kind", F.col("keys").alias("pos"))).alias("marks"))


class _Marks:
    """The marks of all texts of a piece, as positions in the piece."""

    def __init__(self, column: pa.Array, offsets: np.ndarray):
        flat = column.flatten()
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        size = pc.binary_length(flat.field(1)).to_numpy(zero_copy_only=False) // 4
        doc = np.repeat(np.repeat(np.arange(len(counts)), counts), size)
        step = np.frombuffer(b"".join(flat.field(1).to_pylist()), "<u4").astype(np.int64)
        total = np.concatenate([[0], np.cumsum(step)])
        pos = total[1:] - np.repeat(total[np.cumsum(size) - size], size)
        self.doc, self.at = doc, pos + offsets[doc]
        self.kind = np.repeat(flat.field(0).to_numpy(zero_copy_only=False), size)

    def of(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        return self.at[self.kind == kind], self.doc[self.kind == kind]


def _inside(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """True inside any [start, end)."""
    change = np.bincount(starts, minlength=n + 1).astype(np.int32) - np.bincount(ends, minlength=n + 1).astype(np.int32)
    return np.cumsum(change[:n]) > 0


def _settled(ends: np.ndarray, spans: np.ndarray, n: int) -> np.ndarray:
    """Window starts inside long strings that begin at ``spans``."""
    if not len(spans):
        return np.zeros(n, bool)
    return _inside(spans, ends[np.searchsorted(ends, spans) + 1] + 1, n)


def _leftover(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_pieces(batches):
            ids, n, out = rows.column(0).to_numpy(zero_copy_only=False), len(data), []
            marks = _Marks(rows.column(rows.schema.get_field_index("marks")), offsets)
            prefix = prefix_hash(data, BYTE_VALUES)
            ends, _ = _span_ends(prefix, offsets)
            cores, doc = marks.of(CORES)
            candidate = _inside(np.maximum(cores - (MODULUS - 1), offsets[doc]), cores + 1, n)
            last = np.diff(offsets) >= LENGTH
            candidate &= _inside(offsets[:-1][last], offsets[1:][last] - (LENGTH - 1), n)
            where = np.flatnonzero(candidate & (~_settled(ends, marks.of(SPANS)[0], n) | _settled(ends, marks.of(KEEPERS)[0], n)))
            doc = np.searchsorted(offsets, where, "right") - 1
            _bundles(WINDOWS, spans_hash(prefix, where, where + LENGTH), _second(data, where, where + LENGTH, WINDOWS), where - offsets[doc], doc, ids, buckets, out)
            if out:
                yield _batch(out)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """columns doc_id, text, marks of samples, marks of windows -> what is left of each text."""
    for rows, data, offsets in text_pieces(batches):
        n = len(data)
        tied = np.zeros(n, bool)
        spans = _Marks(rows.column(2), offsets).of(SPANS)[0]
        if len(spans):
            ends, _ = _span_ends(prefix_hash(data, BYTE_VALUES), offsets)
            tied = _settled(ends, spans, n)
        tied[_Marks(rows.column(3), offsets).of(WINDOWS)[0]] = True
        starts = np.flatnonzero(tied)
        gone = _inside(starts, starts + LENGTH, n)
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = gone[heads]
        runs = np.concatenate([[0], np.cumsum(begins)])
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(runs[offsets])), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
        )


def _identified(docs: DataFrame) -> DataFrame:
    """(text_id, doc_id, text): text_id is the doc_id where that is unique, else a hash of doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = materialize(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("again"), F.lit(True).alias("is_again")))
    if again.isEmpty():
        return docs.select(F.col("doc_id").alias("text_id"), "doc_id", "text")
    # Broadcast or not is Spark's choice by the size of the written table.
    known = docs.join(again, F.col("doc_id").eqNullSafe(F.col("again")), "left")
    text_id = F.when(F.col("is_again"), F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).otherwise(F.col("doc_id"))
    return known.select(text_id.alias("text_id"), "doc_id", "text")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (bytes left), kept_sha256."""
    buckets = max(MIN_BUCKETS, partitions(docs.sparkSession))
    docs = _identified(docs)
    texts = docs.select("text_id", "text")
    marks = materialize(_tied(texts.mapInArrow(_samples(buckets), _DDL), buckets))
    # The marks grow with the corpus: merge joins at every size.
    windows = materialize(_tied(texts.hint("merge").join(marks, "text_id").select("text_id", "text", "marks").mapInArrow(_leftover(buckets), _DDL), buckets))
    found = marks.hint("merge").join(windows.withColumnRenamed("marks", "windows"), "text_id", "left")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return docs.hint("merge").join(found, "text_id", "left").select("doc_id", "text", "marks", "windows").mapInArrow(_cut, out)
