"""Operator 3, token files: one wavelet matrix per shard.

Documents are range-partitioned by doc_id and encoded in that order; a task closes a shard after about
``SHARD_TOKENS`` ids. A shard is one compressed value that holds the document table and, for each bit of the ids,
a bit-plane with a rank directory; it answers access, count and occurrence queries without the text.
Spark writes the files (one binary value each) and reads them back, so any store that Spark reaches will do.

Defined cases: null or empty text is the end id alone; equal doc_ids stay in neighbouring places; a null
doc_id comes first; an empty table gives no files; other columns are not written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import text_pieces
from .scratch import new_path, partitions
from .tokens import Encoder

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SHARD_TOKENS = 1 << 20
#: Bits between two entries of the rank directory.
BLOCK = 512
_MAGIC = b"WVMX1\0\0\0"
_NULL = -(2**63)


class WaveletMatrix:
    """A sequence of ids as bit-planes, the highest bit first; each plane is ordered by the bits above it."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.bits = n, len(planes)
        self.planes = planes  # packed, little-endian bit order
        self.ranks = []
        for p in planes:
            ones = np.bitwise_count(np.pad(p, (0, -len(p) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
            self.ranks.append(np.concatenate([[0], np.cumsum(ones)]))
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        seq, planes = ids, []
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        for b in range(bits - 1, -1, -1):
            one = (seq & ids.dtype.type(1 << b)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            seq = np.concatenate([seq[~one], seq[one]])
        return cls(len(ids), planes)

    def _rank1(self, level: int, i: int) -> int:
        block = i // BLOCK
        lo = block * BLOCK // 8
        part = self.planes[level][lo : (i + 7) // 8]
        ones = int(np.bitwise_count(part).sum())
        if i % 8 and len(part):
            ones -= int(part[-1] >> (i % 8)).bit_count()
        return int(self.ranks[level][block]) + ones

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token at positions lo to hi - 1."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            if token >> (self.bits - 1 - level) & 1:
                i = self._select(level, 1, i - self.zeros[level])
            else:
                i = self._select(level, 0, i)
        return i

    def _select(self, level: int, bit: int, k: int) -> int:
        r = self.ranks[level]
        ends = r[1:] if bit else np.minimum(np.arange(1, len(r)) * BLOCK, self.n) - r[1:]
        block = int(np.searchsorted(ends, k, "right"))
        before = int(r[block]) if bit else block * BLOCK - int(r[block])
        lo = block * BLOCK // 8
        inside = np.unpackbits(self.planes[level][lo : lo + BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(inside == bit)[k - before])

    def locate(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids: the planes from the lowest up, each undoing the stable partition by its bit."""
        dtype = np.uint16 if self.bits <= 16 else np.uint32
        seq = np.zeros(self.n, dtype)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, dtype)
            z = self.zeros[level]
            out[~one] = seq[:z]
            out[one] = seq[z:] | dtype(1 << (self.bits - 1 - level))
            seq = out
        return seq

    def to_bytes(self, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
        head = struct.pack("<8sQQQ", _MAGIC, self.n, self.bits, len(doc_ids))
        body = b"".join([doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), *(p.tobytes() for p in self.planes)])
        return head + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, blob: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
        """(matrix, doc_ids, their lengths)."""
        magic, n, bits, docs = struct.unpack_from("<8sQQQ", blob)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix file")
        body = zstandard.ZstdDecompressor().decompress(blob[32:])
        ids = np.frombuffer(body, "<i8", docs)
        lengths = np.frombuffer(body, "<i8", docs, 8 * docs)
        size = -(-n // 8)
        return cls(n, [np.frombuffer(body, np.uint8, size, 16 * docs + k * size) for k in range(bits)]), ids, lengths


def _shards(vocabulary: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        names = ["part", "seq", "n_tokens", "file"]
        parts: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        seq = held = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            blob = WaveletMatrix.build(ids).to_bytes(np.concatenate(docs), np.concatenate(lengths))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], names=names)

        for rows, data, offsets in text_pieces(batches):
            part = rows.column(2)[0].as_py()
            ids, counts = encoder.encode(data, offsets)
            out = np.full(len(ids) + len(counts), end_id, ids.dtype)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
            parts.append(out)
            docs.append(rows.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False))
            lengths.append(counts + 1)
            held += len(out)
            if held >= shard_tokens:
                yield close()
                parts, docs, lengths, held, seq = [], [], [], 0, seq + 1
        if parts:
            yield close()

    return run


def write_shards(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the files: rows of (part, seq, n_tokens, file); (part, seq) is the order of doc_id."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    # The files are compressed already.
    ordered.mapInArrow(_shards(vocabulary, end_id, shard_tokens), "part int, seq int, n_tokens long, file binary").write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob, begin in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            matrix, doc_ids, lengths = WaveletMatrix.from_bytes(blob.as_py())
            raw = memoryview(matrix.decode().astype("<u4")).cast("B")
            ends = np.cumsum(lengths)
            at = (ends - lengths).tolist()
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == _NULL), pa.array(ends - lengths + begin), pa.array(lengths), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    files = spark.read.schema("part int, seq int, n_tokens long, file binary").parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row a partition of the writer.
    begun, total = [], 0
    for r in sorted(sizes.collect()):
        begun.append((r["part"], total))
        total += r["n"]
    base = spark.createDataFrame(begun, "part int, base long")
    before = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    begin = before.join(F.broadcast(base), "part").select("part", "seq", (F.col("base") + F.col("before")).alias("begin"))
    # One short row a shard of a million ids: the table of starts is broadcast only if Spark finds it small.
    placed = files.drop("n_tokens").join(begin, ["part", "seq"])
    return placed.select("file", "begin").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the files (to the shared scratch folder if no path is given) and read the documents back from them."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_shards(docs, path, **options)
    return read_documents(docs.sparkSession, path)
