"""Operator 6, best-fit packing by bin completion.

Documents are encoded in place (no shuffle of text); what moves on is one short row a document: token
count and the checksum of each piece. A document longer than a sequence gives full pieces, which fill
sequences of their own, and one shorter first piece. Packing needs only the histogram of first-piece
lengths, at most ``capacity`` rows, so the search runs on the driver whatever the corpus size: around the
largest length left, undominated fillings are enumerated, those that can't waste less than the best one so far are cut off
(the first one found is the best-fit incumbent), and the best one is used as often as the counts allow. The last
TAIL_ITEMS items are packed by branch and bound over whole sequences: every undominated filling of a sequence is
a branch, and a branch ends where the waste so far exceeds what one sequence fewer than the incumbent's allows. FILL_NODES and
TAIL_NODES end a search early; then its incumbent stands. ``bounds`` tells how far the plan is from the lower bound. The
plan, bounded like the histogram, is broadcast; each document finds its place by its rank among documents of its length, and ranks come from
(length, salt) groups, so a length that a third of all documents have is spread over many tasks.

Defined cases: null or empty text is one token (the end id); equal rows are packed one by one; an empty
table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import text_pieces
from .scratch import materialize
from .tokens import Encoder

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Tasks that the documents of one length are ranked in. The offsets of (length, salt) groups are broadcast: capacity * SALTS
#: rows at most, 131,072 of 16 bytes, whatever the corpus and the cluster.
SALTS = 64
#: Steps of the search for one filling, of that for the last items, and how many those are.
FILL_NODES, TAIL_NODES, TAIL_ITEMS = 3000, 20000, 48


def _dilated(mask: int, by: int) -> int:
    """Bits of ``mask`` and the ``by`` places above each."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        mask |= mask << step
        done += step
    return mask


def dominated(items: tuple[int, ...], room: int, left: int) -> bool:
    """Whether one size of the bit set ``left`` fits in place of some of ``items`` and is as large as they are together.

    Those items can go wherever the larger one would have gone, so another filling is at least as good.
    """
    one, several, single = 0, 0, 0
    for s in items:
        several |= one << s
        one |= one << s | 1 << s
        single |= 1 << s
    swaps = _dilated(several, room)
    if room:
        swaps |= _dilated(single << 1, room - 1)
    return bool(swaps & left)


def fillings(space: int, counts: dict[int, int], nodes: int = FILL_NODES, better_than: bool = True) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, sizes in descending order) of the undominated fillings of ``space``, larger sizes first.

    With ``better_than``, only fillings that waste less than all before them.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= space), reverse=True)
    rest = [0] * (len(sizes) + 1)  # what the sizes from here on hold together
    for i in range(len(sizes) - 1, -1, -1):
        rest[i] = rest[i + 1] + sizes[i] * counts[sizes[i]]
    available = sum(1 << s for s in sizes)
    best, left = space + 1, nodes

    def search(i: int, room: int, used: tuple[tuple[int, int], ...]) -> Iterator[tuple[int, tuple[int, ...]]]:
        nonlocal best, left
        fits = False
        for j in range(i, len(sizes)):
            s = sizes[j]
            if left <= 0 or (better_than and (not best or room - rest[j] >= best)):
                return
            if s > room:
                continue
            for k in range(min(room // s, counts[s]), 0, -1):
                fits = True
                left -= 1
                yield from search(j + 1, room - k * s, (*used, (s, k)))
                if left <= 0 or (better_than and not best):
                    return
        if fits or (better_than and room >= best):
            return
        gone = sum(1 << s for s, k in used if k == counts[s])
        out = available & ~gone
        if out & ((1 << room + 1) - 1):  # something still fits
            return
        items = tuple(s for s, k in used for _ in range(k))
        if not dominated(items, room, out):
            best = min(best, room)
            yield room, items

    yield from search(0, space, ())


def completion(space: int, counts: dict[int, int], nodes: int = FILL_NODES) -> tuple[int, ...]:
    """The undominated filling of ``space`` with least waste, as far as the search goes."""
    best: tuple[int, ...] = ()
    for _, best in fillings(space, counts, nodes):
        pass
    return best


def best_fit(items: list[int], capacity: int) -> list[list[int]]:
    bins: list[list[int]] = []
    for x in sorted(items, reverse=True):
        fit = [b for b in bins if sum(b) + x <= capacity]
        if fit:
            max(fit, key=sum).append(x)
        else:
            bins.append([x])
    return bins


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: the best, over k, of counting sizes above capacity - k alone and small ones by volume."""
    n = np.zeros(capacity + 2, np.int64)
    for s, k in histogram.items():
        n[s] = k
    count, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * np.arange(len(n)))])
    half, found = capacity // 2, 0
    for k in range(half + 1):
        large, medium = count[-1] - count[capacity - k + 1], count[capacity - k + 1] - count[half + 1]
        spare = medium * capacity - (volume[capacity - k + 1] - volume[half + 1])
        found = max(found, int(large + medium + max(0, -(-(volume[half + 1] - volume[k] - spare) // capacity))))
    return found


def pack_tail(items: list[int], capacity: int, nodes: int = TAIL_NODES) -> list[list[int]]:
    """Branch and bound over whole sequences; starts from best fit decreasing and stops at the lower bound."""
    best = best_fit(items, capacity)
    counts: dict[int, int] = {}
    for x in items:
        counts[x] = counts.get(x, 0) + 1
    bound, volume, left = lower_bound(counts, capacity), sum(items), nodes

    def search(counts: dict[int, int], bins: list[list[int]], wasted: int) -> None:
        nonlocal best, left
        if not counts:
            best = bins if len(bins) < len(best) else best
            return
        head = max(counts)
        others = {s: n - (s == head) for s, n in counts.items()}
        found = sorted(fillings(capacity - head, others, min(left, 400), better_than=False))
        for waste, fill in found or [(capacity - head, ())]:
            left -= 1
            if left <= 0 or len(best) == bound or wasted + waste > (len(best) - 1) * capacity - volume:
                return
            after = dict(others)
            for s in fill:
                after[s] -= 1
            search({s: n for s, n in after.items() if n}, [*bins, [head, *fill]], wasted + waste)

    if len(best) > bound:
        search(counts, [], 0)
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(sizes in one sequence, number of such sequences), for all items of the histogram."""
    counts = {s: n for s, n in histogram.items() if n}
    total, out = sum(counts.values()), []
    while total > TAIL_ITEMS:
        head = max(counts)
        counts[head] -= 1
        fill = completion(capacity - head, counts)
        counts[head] += 1
        sizes = (head, *fill)
        times = min(counts[s] // sizes.count(s) for s in set(sizes))
        out.append((sizes, times))
        for s in set(sizes):
            counts[s] -= times * sizes.count(s)
            if not counts[s]:
                del counts[s]
        total -= times * len(sizes)
    if total:
        out += [(tuple(sorted(b, reverse=True)), 1) for b in pack_tail([s for s, n in counts.items() for _ in range(n)], capacity)]
    return out


def bounds(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences of the plan, the least that any packing needs)."""
    return sum(n for _, n in plan(histogram, capacity)), lower_bound(histogram, capacity)


def _encode(vocabulary: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for rows, data, offsets in text_pieces(batches):
            ids, counts = encoder.encode(data, offsets)
            ids = ids.astype("<u4")
            at, crcs = 0, []
            end = np.array([end_id], "<u4").tobytes()
            for n in counts.tolist():
                raw = ids[at : at + n].tobytes() + end
                at += n
                first = (n % capacity + 1) * 4
                crcs.append([zlib.crc32(raw[:first]), *(zlib.crc32(raw[i : i + 4 * capacity]) for i in range(first, len(raw), 4 * capacity))])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts + 1), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "n_tokens", "crcs"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = materialize(docs.select("doc_id", "text").mapInArrow(_encode(vocabulary, capacity, end_id), f"doc_id {kind}, n_tokens long, crcs array<long>"))
    items = encoded.withColumn("len", ((F.col("n_tokens") - 1) % capacity + 1).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    counts = items.groupBy("len", "salt").agg(F.count(F.lit(1)).alias("n"))
    # capacity rows at most
    histogram = {r["len"]: r["n"] for r in counts.groupBy("len").agg(F.sum("n").alias("n")).collect()}
    rows, used, base = [], dict.fromkeys(histogram, 0), 0
    for sizes, times in plan(histogram, capacity):
        offset = 0
        for s in dict.fromkeys(sizes):
            k = sizes.count(s)
            rows.append((s, used[s], used[s] + k * times, k, base, offset))
            used[s] += k * times
            offset += k * s
        base += times
    places = spark.createDataFrame(rows, "len int, lo long, hi long, each int, base long, at long")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("len", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = items.withColumn("r", F.row_number().over(Window.partitionBy("len", "salt").orderBy("doc_id", "crcs")) - 1)
    # Both tables are bounded by the capacity (times SALTS), not by the corpus.
    ranked = ranked.join(F.broadcast(before), ["len", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    placed = ranked.join(F.broadcast(places), "len").filter("rank >= lo and rank < hi")
    within = F.col("rank") - F.col("lo")
    placed = placed.select(
        "doc_id",
        "n_tokens",
        "len",
        (F.col("rank") * capacity + F.col("len")).alias("u"),
        (F.col("base") + F.floor(within / F.col("each"))).cast("long").alias("seq"),
        (F.col("at") + (within % F.col("each")) * F.col("len")).cast("long").alias("at"),
        F.posexplode("crcs").alias("piece", "ids_crc32"),
    )
    head = F.col("piece") == 0
    return placed.select(
        "doc_id",
        "piece",
        F.when(head, F.lit(0)).otherwise(F.col("len") + (F.col("piece") - 1) * capacity).cast("long").alias("start"),
        F.when(head, F.col("len")).otherwise(F.lit(capacity)).cast("long").alias("length"),
        "ids_crc32",
        # A full piece has a sequence of its own, numbered below zero by (rank, length, piece).
        F.when(head, F.col("seq")).otherwise(-(F.col("u") * (1 << 20) + F.col("piece"))).cast("long").alias("sequence_id"),
        F.when(head, F.col("at")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )
