"""Phrase collocations, mined level by level (Apriori).

Level 1 counts words, level k phrases of k words. A pass over the texts gets the frequent phrases of k - 1 words and
counts a phrase of k only where both phrases of k - 1 words that overlap in it are frequent. Each level is a table
with the counts of every beginning and end of its phrases, so cuts are scored from the tables, never from the texts.

Up to ``LIMIT`` frequent phrases are sent to the tasks as sorted hashes; beyond, as a bitmap of ``BITS`` bits whatever
their number. A bitmap's false hits only cost work: what is counted must be frequent by its own count. Partial counts
of a task are added up by Spark, so that no word, language or source is ever in one place.

Words are known by 64-bit hashes that include their language (level 1 is counted by the words themselves), phrases by
those of their two overlapping parts.

Defined cases: a null text has no words; a null lang is ``und``, one row with lang ``und`` too; empty pieces have no
words; words apart by several blanks count as neighbours; a repeated row counts again; one phrase in two languages is
two phrases; overlapping occurrences (``a a`` in ``a a a``) all count; cuts that tie are cut at the smallest place; texts
of any length are read whole and must fit a task; an empty table, or one without frequent phrases, gives no rows; columns
other than lang and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.shared import ASCII_LOWER, paired, slices, text_bytes, word_hashes, word_spans
from loomline.storage import discard, materialise

LEAST, LONGEST, TOP = 30, 4, 2000
#: Frequent phrases that are sent as sorted hashes (8 bytes each), and bits of the map beyond that (16 MB).
LIMIT, BITS = 2_000_000, 27
#: Rows of a level that may be broadcast to the next one's counts.
BROADCAST_ROWS = 100_000
#: Phrases that a task counts before it hands its counts on.
FLUSH = 2_000_000
STEP_BYTES, STEP_ROWS = 8 << 20, 8192

_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
_SEPARATORS = _BREAKS.copy()
_SEPARATORS[[0x20, 0x09]] = True

LEVEL = "h long, lang string, phrase string, last string, f long, p long, s long, heads array<long>, tails array<long>"
FOUND = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (lang, text): lower-cased bytes, words' starts and ends, their rows and their hashes."""
    data, rows = text_bytes(batch.column(1))
    data = ASCII_LOWER[data]
    starts, ends, first = word_spans(data, rows, _SEPARATORS)
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    langs = np.array([xxhash.xxh3_64_intdigest(x) for x in batch.column(0).to_pylist()], np.uint64)
    return data, starts, ends, row, paired(word_hashes(data, starts, ends), langs[row])


def _joined(data: np.ndarray, starts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a word and the next one stand in the same piece."""
    piece = np.cumsum(_BREAKS[data])[starts] if len(data) else starts
    return (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    stops = np.concatenate([[0], np.cumsum(ends - starts)])
    flat = data[np.repeat(starts - stops[:-1], ends - starts) + np.arange(stops[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, lang, phrase and n of the words of each step, and a row without word for the sum of each language."""
    for whole in batches:
        for batch in slices(whole, 1, STEP_BYTES, STEP_ROWS):
            data, starts, ends, row, hashes = _words(batch)
            found, at, n = np.unique(hashes, return_index=True, return_counts=True)
            langs = batch.column(0).cast(pa.string())
            per_row = np.bincount(row, minlength=batch.num_rows)
            columns = [
                pa.concat_arrays([pa.array(found.view(np.int64)), pa.nulls(batch.num_rows, pa.int64())]),
                pa.concat_arrays([langs.take(pa.array(row[at])), langs]),
                pa.concat_arrays([_texts(data, starts[at], ends[at]), pa.nulls(batch.num_rows, pa.string())]),
                pa.concat_arrays([pa.array(n.astype(np.int64)), pa.array(per_row.astype(np.int64))]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "lang", "phrase", "n"])


def _member(known: tuple[str, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    kind, table = known
    if kind == "bits":
        return (table[hashes >> np.uint64(64 - BITS + 6)] >> (hashes >> np.uint64(64 - BITS) & np.uint64(63)) & np.uint64(1)).astype(bool)
    if not len(table):
        return np.zeros(len(hashes), bool)
    return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes


def _frequent(level: DataFrame, limit: int) -> tuple[str, np.ndarray]:
    """A level's hashes: sorted, or as a bitmap where there are more than ``limit``."""
    if level.count() <= limit:
        return "hashes", np.sort(level.select("h").toArrow().column("h").to_numpy().view(np.uint64))
    place = level.select(F.shiftrightunsigned("h", 64 - BITS + 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 AS int))").alias("b"))
    words = place.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return "bits", table


def _partial(p: list[np.ndarray], s: list[np.ndarray]) -> pa.RecordBatch:
    p, s = np.concatenate(p), np.concatenate(s)
    order = np.lexsort((s, p))
    p, s = p[order], s[order]
    first = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])))
    n = np.diff(np.append(first, len(p)))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (p[first].view(np.int64), s[first].view(np.int64), n)], names=["p", "s", "n"])


def _count_phrases(docs: DataFrame, size: int, level: DataFrame, limit: int) -> DataFrame:
    """(p, s, n): partial counts of the phrases of ``size`` words whose two parts are in ``level``."""
    known = docs.sparkSession.sparkContext.broadcast(_frequent(level, limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for whole in batches:
            for batch in slices(whole, 1, STEP_BYTES, STEP_ROWS):
                data, starts, _, row, hashes = _words(batch)
                joined = _joined(data, starts, row)
                inside = np.ones(len(hashes), bool)  # the words from here on make up a phrase
                for _ in range(size - 2):
                    hashes, inside = paired(hashes[:-1], hashes[1:]), inside[:-1] & joined[: len(inside) - 1] & inside[1:]
                inside &= _member(known.value, hashes)
                at = np.flatnonzero(inside[:-1] & inside[1:] & joined[: max(len(inside) - 1, 0)])
                held[0].append(hashes[at]), held[1].append(hashes[at + 1])
                if sum(map(len, held[0])) >= FLUSH:
                    yield _partial(*held)
                    held = ([], [])
        if sum(map(len, held[0])):
            yield _partial(*held)

    return docs.mapInArrow(run, "p long, s long, n long")


def _with_hash(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, s = (batch.column(k).to_numpy().view(np.uint64) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(paired(p, s).view(np.int64)), *batch.columns], names=["h", *batch.schema.names])

    return rows.mapInArrow(run, "h long, p long, s long, f long")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, limit: int = LIMIT) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), and the table of every level that has frequent phrases: its phrases with ``f`` and the counts of their
    beginnings (``heads``, shortest first) and ends (``tails``, likewise)."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = docs.mapInArrow(_count_words, "h long, lang string, phrase string, n long").groupBy("h", "lang", "phrase").agg(F.sum("n").alias("f"))
    words = materialise(words.filter((F.col("f") >= least) | F.col("phrase").isNull()), "words")
    none = F.array().cast("array<long>")
    found = [words.filter("phrase IS NOT NULL").select("h", "lang", "phrase", F.col("phrase").alias("last"), "f", F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("s"), none.alias("heads"), none.alias("tails"))]
    for size in range(2, longest + 1):
        if not found[-1].head(1):
            found.pop()
            break
        counts = _count_phrases(docs, size, found[-1], limit).groupBy("p", "s").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        counts = materialise(_with_hash(counts), "phrases")
        below = _sized(found[-1])
        begin = below.select(F.col("h").alias("p"), "lang", F.col("phrase").alias("_p"), F.concat("heads", F.array("f")).alias("heads"))
        end = below.select(F.col("h").alias("s"), "last", F.concat("tails", F.array("f")).alias("tails"))
        told = counts.join(begin, "p").join(end, "s")
        found.append(materialise(told.select("h", "lang", F.concat("_p", F.lit(" "), "last").alias("phrase"), "last", "f", "p", "s", "heads", "tails"), "level"))
        discard(counts)
    return words.filter("phrase IS NULL").select("lang", F.col("f").alias("n")), found


def scored(level: DataFrame, size: int, longer: DataFrame | None) -> DataFrame:
    """lang, phrase, a, l, r and score of a level's phrases by their lowest-scoring cut, without those that ``longer`` (the next level) absorbs."""
    a = F.col("f").cast("decimal(38,0)")
    cuts = []
    for k in range(1, size):
        l, r = F.element_at("heads", k), F.element_at("tails", size - k)
        score = F.expr(f"CAST(2000000 AS DECIMAL(7,0)) * CAST(f AS DECIMAL(20,0)) div (element_at(heads, {k}) + element_at(tails, {size - k}))")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    rows = level.select("h", "lang", "phrase", "f", F.array_min(F.array(*cuts)).alias("cut"))
    if longer is not None:
        most = materialise(longer.select(F.explode(F.array("p", "s")).alias("h"), "f").groupBy("h").agg(F.max("f").alias("_most")), "absorbing")
        rows = rows.join(_sized(most), "h", "left").filter(F.col("_most").isNull() | (100 * F.col("_most").cast("decimal(38,0)") < 80 * a))
    return rows.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, limit: int = LIMIT) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``longest`` words by score."""
    totals, found = levels(docs, least, longest, limit)
    if len(found) < 2:
        return docs.sparkSession.createDataFrame([], FOUND)
    rows = [scored(level, size, found[size] if size < len(found) else None) for size, level in enumerate(found[1:], 2)]
    every = rows[0]
    for more in rows[1:]:
        every = every.union(more)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = every.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
