"""Vectorised text kernels over Arrow string columns (numpy, used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Multiplier of the polynomial hash (odd, so it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
#: White space of the word contract: U+0020 and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"

_rng = np.random.default_rng(20240501)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; the tables are kept by the worker."""
    if base not in _powers or len(_powers[base][0]) < n:
        m = max(n, 1 << 20)
        step = np.full(m, base, U64)
        step[0] = 1
        up = np.cumprod(step)
        step[1:] = pow(base, -1, 2**64)
        _powers[base] = up, np.cumprod(step)
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (a bijection)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row is a piece by itself."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def text_pieces(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their ``text``, offsets), a few MB at a time, so that memory does not follow Arrow's batch size."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
        for lo, hi in pieces(offsets, limit):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """P with hash(data[a:b]) = (P[b] - P[a]) * BASE**-a."""
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * pw[: len(data)], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, ip = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * ip[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words ``[^ \\t-\\r]+``; words never cross rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~blank[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, blank: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row number of every word."""
    starts, ends, rows = word_spans(data, offsets, blank)
    return spans_hash(prefix_hash(data, LOWER_VALUES if lower else BYTE_VALUES), starts, ends), rows


_STEP = [U64(x) for x in (0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words; a row with fewer words, but one at least, has one shingle of them all."""
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    m = len(hashes) - size + 1
    if m > 0:
        whole = np.zeros(m, U64)
        for k in range(size):
            whole += hashes[k : k + m] * _STEP[k]
        ok = rows[:m] == rows[size - 1 :]
        out, at = mix(whole[ok]), rows[:m][ok]
    else:
        out, at = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), U64)
        for k in range(size - 1):
            has = count[short] > k
            extra[has] += hashes[first[short[has]] + k] * _STEP[k]
        extra = mix(extra + count[short].astype(U64) * U64(0x2545F4914F6CDD1D))
        out, at = np.concatenate([out, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at
