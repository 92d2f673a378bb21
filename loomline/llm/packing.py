"""Packing by minimum bin slack.

One pass tokenises every text and cuts it at multiples of the capacity: whole windows are sequences of their own, and
what remains of each document (1 to capacity - 1 tokens) is placed by the plan. The plan sees only the histogram of
remaining lengths (capacity - 1 counts at most, whatever the corpus): for each window a bitset subset-sum search finds
the multiset that, with the largest length left, comes closest to the capacity, backtracks how many of each length it
takes, and uses that pattern as often as the counts allow. After a pattern the counts can't take it once more, so
patterns never repeat; their number is bounded by the lengths and the logarithms of their counts, not by the corpus. Pieces then find their slot by their rank within their length, from counts per input part.

Defined cases: a null or empty text is its end token alone; texts of any length are cut whole; repeated rows are packed
each for itself; lengths that tie are ranked by input part and position; an empty table gives no rows; a part of the
input that is read again after a loss gives the same pieces in the same order, and the pieces are written to the shared
folder before they are ranked; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import slices
from loomline.llm.tokens import BYTE_BPE, encoder
from loomline.storage import materialise

CAPACITY = 1024
#: One pattern: the lengths taken with their counts, largest first, and how often it is used.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def padding(total: int, capacity: int = CAPACITY) -> int:
    """Tokens of padding for a sequence of ``total``: none at a power of two."""
    return 0 if total & (total - 1) == 0 else capacity - total


def fill(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[tuple[int, int], ...]:
    """The largest length, and with it the multiset of the others that leaves the least slack.

    ``reach`` has bit s set where s tokens can be filled; lengths enter with their count split into powers of two, and
    the bitset before each of them is kept, to read off backwards what a sum was made of. Longer lengths enter first,
    so that short ones stay for later windows.
    """
    seed = max(counts)
    room, reach, steps = capacity - seed, 1, []
    whole = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, share = min(counts[length] - (length == seed), room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(share, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & whole
            left, share = left - take, share * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    taken = {seed: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + take
            at -= length * take
    return tuple(sorted(taken.items(), reverse=True))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use up a histogram of lengths."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        pattern = fill(left, capacity)
        times = min(left[length] // n for length, n in pattern)
        out.append((pattern, times))
        for length, n in pattern:
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return out


def _pieces(capacity: int, vocabulary: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        windows, ranks, end = 0, np.zeros(capacity, np.int64), np.zeros(1, "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", "ids"]
        for whole in batches:
            for batch in slices(whole, 1):
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        length = len(piece) // 4
                        if length == capacity:
                            rank, windows = windows, windows + 1
                        else:
                            rank = int(ranks[length])
                            ranks[length] += 1
                        rows.append((doc_id, start, length, zlib.crc32(piece), total, part, rank, piece if with_ids else None))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = BYTE_BPE, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian, if asked for).

    Sequences from the plan are numbered from 0; a whole window of part p has the number (p + 1) * 2^32 + its place there.
    """
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _pieces(capacity, vocabulary, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long, ids binary"
    )
    cut = materialise(cut, "pieces")
    told = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    full = cut.filter(F.col("length") == capacity).select(*told, ((F.col("part") + 1) * F.lit(1 << 32) + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter(F.col("length") < capacity)
    per_part = rest.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity - 1 rows at most
    slots, base = _slots(plan(counts, capacity)), _bases(per_part)
    sent = docs.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                begins, first, each, lead = sent.value[int(size)]
                k = np.searchsorted(begins, rank[own], side="right") - 1
                nth = rank[own] - begins[k]
                sequence[own], offset[own] = first[k] + nth // each[k], lead[k] + nth % each[k] * size
            kept = [batch.column(batch.schema.get_field_index(c)) for c in told]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*told, "sequence_id", "offset"])

    ranked = rest.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    return full.union(ranked.select(*told, "rank").mapInArrow(place, full.schema))


def _bases(per_part: DataFrame) -> DataFrame:
    """(length, part, base): how many pieces of the length earlier parts have."""
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, pieces a sequence, and offset of the first piece, pattern by pattern."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for pattern, times in patterns:
        lead = 0
        for length, n in pattern:
            rows.setdefault(length, []).append((used.get(length, 0), first, n, lead))
            used[length] = used.get(length, 0) + n * times
            lead += length * n
        first += times
    return {length: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for length, r in rows.items()}
