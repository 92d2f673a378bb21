"""Versions as chunks: contents cut where their own bytes say so, each different chunk stored once.

A cut follows a byte at which the hash of the last WINDOW bytes has BITS zero bits at its top, but no chunk is shorter than
LEAST bytes (save the last) or longer than MOST. So an edit moves the cuts near it only, and versions of a text share the
rest. A manifest row tells each chunk of each version by its SHA-256; reading joins manifest and chunks, and verifies.

Defined cases: an empty content has one empty chunk, a null one none, so that it isn't read back; keys must be unique, for
rows that share one are put together as one content; a chunk that is lost or damaged makes its contents null with state ``damaged``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.storage import materialise

WINDOW, BITS, LEAST, MOST = 32, 10, 256, 8192
_BASE = np.uint64(0x9E3779B97F4A7C15)


def cuts(data: bytes) -> list[int]:
    """Where chunks end, the last at the end of the data."""
    n = len(data)
    if n <= LEAST:
        return [n]
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    rolling = np.zeros(n, np.uint64)
    for k in range(WINDOW):  # the hash at i weighs byte i - k by the k-th power of the base
        rolling[k:] += values[: n - k] * np.uint64(pow(int(_BASE), k + 1, 1 << 64))
    rolling ^= rolling >> np.uint64(29)
    rolling *= _BASE
    marks = np.flatnonzero(rolling >> np.uint64(64 - BITS) == 0) + 1
    out, at = [], 0
    while at < n:
        k = np.searchsorted(marks, at + LEAST)
        end = min(int(marks[k]) if k < len(marks) else n, at + MOST, n)
        out.append(end)
        at = end
    return out


def split(rows: DataFrame, by: Sequence[str], content: str) -> DataFrame:
    """(by, no, digest, length, chunk): the chunks of every row's binary content, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, chunks = [], []
            for row, value in enumerate(batch.column(1)):
                data = value.as_py()
                if data is None:
                    continue
                begin = 0
                for no, end in enumerate(cuts(data)):
                    at.append(row)
                    chunks.append((no, hashlib.sha256(data[begin:end]).hexdigest(), end - begin, data[begin:end]))
                    begin = end
            columns = list(zip(*chunks, strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["key", "no", "digest", "length", "chunk"])

    keyed = rows.select(F.struct(*by).alias("key"), F.col(content).cast("binary").alias("content"))
    kind = keyed.schema["key"].dataType.simpleString()
    return keyed.mapInArrow(run, f"key {kind}, no int, digest string, length long, chunk binary").select("key.*", "no", "digest", "length", "chunk")


def store(pieces: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(digest, length, chunk): what has to be written, each different chunk once; ``known`` (digest) are there already."""
    names = pieces.select("digest").distinct() if known is None else pieces.select("digest").distinct().join(known.select("digest"), "digest", "left_anti")
    new = pieces.join(names, "digest", "left_semi")
    return new.groupBy("digest").agg(F.min("length").alias("length"), F.first("chunk").alias("chunk"))


def manifest(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, no, digest, length), which with the chunks is the whole."""
    return pieces.select(*by, "no", "digest", "length")


def read(listed: DataFrame, chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, content, state): contents put together again; ``damaged``, without content, where a chunk is lost or isn't what its name says."""
    sound = chunks.filter(F.sha2("chunk", 256) == F.col("digest")).select("digest", F.hex("chunk").alias("hex")).dropDuplicates(["digest"])
    parts = F.sort_array(F.collect_list(F.struct("no", "hex")))
    rows = listed.join(sound, "digest", "left").groupBy(*by).agg(parts.alias("parts"), F.bool_and(F.col("hex").isNotNull()).alias("whole"))
    content = F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), ""))
    return rows.select(*by, F.when(F.col("whole"), content).alias("content"), F.when(F.col("whole"), "whole").otherwise("damaged").alias("state"))


def saving(listed: DataFrame, versions: Sequence[str]) -> DataFrame:
    """(versions, n_chunks, n_bytes, n_new_bytes): bytes of each version, and those of chunks that no version before it has."""
    first = listed.groupBy("digest").agg(F.min(F.struct(*versions)).alias("since"), F.min("length").alias("length"))
    new = materialise(first.groupBy(F.col("since").alias("v")).agg(F.sum("length").alias("n_new_bytes")), "new")
    sums = listed.groupBy(F.struct(*versions).alias("v")).agg(F.count("*").alias("n_chunks"), F.sum("length").alias("n_bytes"))
    return sums.join(new, "v", "left").select("v.*", "n_chunks", "n_bytes", F.coalesce("n_new_bytes", F.lit(0)).alias("n_new_bytes"))
