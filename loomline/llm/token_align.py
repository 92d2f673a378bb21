"""Cross-tokenizer alignment: token interval tables of two tokenizers, joined by DuckDB inside each Arrow batch.

A batch's texts are cut at single spaces between letters, digits or marks, where neither tokenizer's token can reach across; each
different segment is encoded once by both. The tokens of all segments become two interval tables over one byte axis.
DuckDB finds by ASOF joins which tokens end where a token of the other side ends, numbers the groups between such common
ends by window sums, and pairs overlapping tokens by a range join within the groups; links are the overlaps that end
together. Segments add up to documents again, and Spark merges the partial pair counts of all documents.

Only then are links scored: documents keep their own pairs with counts (written once), which are looked up in the
corpus-wide counts. These are sent to the tasks where there are at most ``PAIRS`` of them; beyond, the same lookup is a
salted shuffle join.

Defined cases: a null or empty text, and one whose joined bytes on either side differ from space and text (what one
tokenizer normalises away), have no tokens: zeros and ''. Strings of special tokens are plain text. A text without such a
space is one segment, so a very long one must fit a task. Repeated rows are aligned and counted each for itself; pairs
that tie for a token's highest count are all best; an empty table gives no rows; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import slices, text_bytes
from loomline.llm.tokens import BYTE_BPE, RUN
from loomline.storage import materialise

PIECE_BPE = "piece_bpe_32k"
#: Different pairs that may be sent to every task (17 bytes each).
PAIRS = 2_000_000
#: Salts of the shuffle join beyond that.
SALTS = 32
#: Text that goes through DuckDB at a time.
STEP_BYTES, STEP_ROWS = 3 << 20, 8192
#: Segments that are encoded at a time.
ENCODED = 20_000
#: Bytes beside which a single space is a cut, with the two-byte characters from U+00C0 to U+027F.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LONG_RUN = re.compile(rf"\s{{{RUN}}}")

TABLES = """
CREATE OR REPLACE TEMP TABLE {x}_groups AS
SELECT pos, seg, id, lo, fin, (sum(cut) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) - cut)::INTEGER AS grp
FROM (SELECT {x}.*, ({y}.fin = {x}.fin)::INTEGER AS cut FROM {x} ASOF JOIN {y} ON {x}.fin <= {y}.fin)"""
OVERLAPS = """
SELECT a.seg, a.id AS a_id, b.id AS b_id, count(*) AS met, count(*) FILTER (a.fin = b.fin) AS links
FROM a_groups a JOIN b_groups b ON a.grp = b.grp AND a.lo < b.fin AND b.lo < a.fin GROUP BY ALL"""
PAIRS_OF_DOCS = """
SELECT doc, a_id, b_id, sum(n * links)::INTEGER AS links
FROM (SELECT doc, seg, count(*) AS n FROM uses GROUP BY ALL) JOIN pairs USING (seg) WHERE links > 0 GROUP BY ALL"""


class Side:
    """One tokenizer: ``encode`` of a list of texts to ids, each id's bytes, and whether segments are independent."""

    def __init__(self, encode: Callable[[list[str]], list], parts: list[bytes], separable: bool = True):
        self.encode, self.parts, self.separable = encode, parts, separable
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(parts), np.uint8)
        self.names = {end: np.array([f"{k}{end}" for k in range(len(parts))], object) for end in ",|;"}


    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens back to back."""
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        return self.data[np.repeat(self.starts[ids] - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)]


@lru_cache(maxsize=2)
def byte_level(vocabulary: str = BYTE_BPE, location: str | None = None) -> Side:
    """The byte-level BPE, which reads a text with a space before it."""
    import base64

    import public_tokenizers
    import tiktoken

    path = (lambda name: f"{location}/{name}") if location else public_tokenizers.path
    with open(path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def one(text: str) -> list[int]:
        if len(text) < RUN or not _LONG_RUN.search(text):
            return fast.encode_ordinary(" " + text)
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(path(f"{vocabulary}.json")))
            slow[0].encode_special_tokens = True
        return slow[0].encode(" " + text, add_special_tokens=False).ids

    parts = [b""] * (max(ranks.values()) + 1)
    for part, rank in ranks.items():
        parts[rank] = part
    return Side(lambda texts: [one(t) for t in texts], parts)


@lru_cache(maxsize=2)
def pieces(vocabulary: str = PIECE_BPE, location: str | None = None) -> Side:
    """The piece BPE with byte fallback, which puts a space before the text itself."""
    import public_tokenizers
    import sentencepiece

    path = (lambda name: f"{location}/{name}") if location else public_tokenizers.path
    model = sentencepiece.SentencePieceProcessor(model_file=path(f"{vocabulary}.model"))
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    parts = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
    return Side(lambda texts: model.encode(texts, num_threads=1), parts, not any(re.search("[^▁]▁", p) for p in names))


def _segments(texts: pa.Array, separable: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different segments, each with a space before it, the segments of all texts in order, and each text's first (the total appended)."""
    data, rows = text_bytes(texts)
    filled = np.diff(rows) > 0
    data = np.insert(data, rows[:-1][filled], 0x20)
    rows = rows + np.concatenate([[0], np.cumsum(filled)])
    begins = np.zeros(len(data), bool)
    begins[rows[:-1][filled]] = True
    if separable and len(data) > 3:
        lead = (data >= 0xC3) & (data <= 0xC9)  # of two-byte characters, all of them letters
        after, before = _PLAIN[data] | lead, _PLAIN[data].copy()
        before[1:] |= lead[:-1]
        begins[1:-1] |= (data[1:-1] == 0x20) & before[:-2] & after[2:]
    starts = np.flatnonzero(begins)
    ends = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    told = pa.LargeStringArray.from_buffers(len(starts), ends, pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    return told.dictionary, told.indices.to_numpy(), np.searchsorted(starts, rows)


def _encoded(named: pa.Array, a: Side, b: Side) -> tuple[dict, dict, np.ndarray]:
    """Token intervals of all segments on both sides, and which segments have tokens that make up their bytes."""
    texts = pc.utf8_slice_codeunits(named, 1)
    (ids_a, count_a), (ids_b, count_b) = _ids(texts, a), _ids(texts, b)
    data, ends = text_bytes(named)
    fin = np.concatenate([[0], np.cumsum(b.sizes[ids_b])])
    good = np.diff(fin[np.concatenate([[0], np.cumsum(count_b)])]) == np.diff(ends)
    told = b.bytes_of(ids_b)
    if good.all():  # then a byte that differs tells its segment
        good[np.searchsorted(ends, np.flatnonzero(told != data), side="right") - 1] = False
    else:
        stops = fin[np.concatenate([[0], np.cumsum(count_b)])]
        good &= np.array([np.array_equal(told[stops[k] : stops[k + 1]], data[ends[k] : ends[k + 1]]) for k in range(len(good))])
    return _intervals(ids_a, count_a, good, a), _intervals(ids_b, count_b, good, b), good


def _ids(texts: pa.Array, side: Side) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts back to back, and their number for each."""
    flat, counts = array("i"), array("q")
    for at in range(0, len(texts), ENCODED):
        for ids in side.encode(texts.slice(at, ENCODED).to_pylist()):
            flat.extend(ids)
            counts.append(len(ids))
    return np.array(flat, np.int32), np.array(counts, np.int64)


def _intervals(ids: np.ndarray, counts: np.ndarray, good: np.ndarray, side: Side) -> dict[str, np.ndarray]:
    """pos, seg, id, lo and fin of the good segments' tokens, on one byte axis."""
    seg = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    kept = good[seg]
    ids, seg = ids[kept], seg[kept]
    fin = np.cumsum(side.sizes[ids])
    return {"pos": np.arange(len(ids), dtype=np.int32), "seg": seg, "id": ids, "lo": fin - side.sizes[ids], "fin": fin}


def _told(a: dict, b: dict, grp_a: np.ndarray, grp_b: np.ndarray, n_segments: int, sides: tuple[Side, Side]) -> list[str]:
    """Each segment's groups as ``a1,a2|b1;a3|b2,b3;``."""
    n_groups = int(grp_a[-1]) + 1 if len(grp_a) else 0
    before_a, before_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n_groups))]) for g in (grp_a, grp_b))
    words = np.empty(len(grp_a) + len(grp_b), object)
    for table, grp, place, side, end in ((a, grp_a, before_b[grp_a], sides[0], "|"), (b, grp_b, before_a[grp_b + 1], sides[1], ";")):
        last = np.append(grp[1:] != grp[:-1], True)[: len(grp)]
        words[np.arange(len(grp)) + place] = np.where(last, side.names[end][table["id"]], side.names[","][table["id"]])
    stops = np.cumsum(np.bincount(a["seg"], minlength=n_segments) + np.bincount(b["seg"], minlength=n_segments))
    listed, starts = words.tolist(), np.concatenate([[0], stops[:-1]])
    return ["".join(listed[s:e]) for s, e in zip(starts, stops, strict=True)]


def _rows(con, texts: pa.Array, sides: tuple[Side, Side], separable: bool = True) -> dict[str, np.ndarray | list]:
    """One step: every text's counts, groups and pairs (``pairs``: doc, a_id, b_id and links, ordered by doc)."""
    named, seg, first = _segments(texts, separable and all(s.separable for s in sides))
    a, b, good = _encoded(named, *sides)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    n_docs, odd = len(texts), np.unique(doc[~good[seg]])
    kept = ~np.isin(doc, odd)
    doc, seg = doc[kept], seg[kept]
    con.register("a", pa.table(a)), con.register("b", pa.table(b)), con.register("uses", pa.table({"doc": doc, "seg": seg}))
    for x, y in ("ab", "ba"):
        con.execute(TABLES.format(x=x, y=y))
    con.execute(f"CREATE OR REPLACE TEMP TABLE pairs AS {OVERLAPS}")
    pairs = con.execute(PAIRS_OF_DOCS).fetchnumpy()
    met = con.execute("SELECT seg, sum(met)::BIGINT AS n FROM pairs GROUP BY seg").fetchnumpy()
    grp_a, grp_b = (con.execute(f"SELECT grp FROM {x}_groups ORDER BY pos").fetchnumpy()["grp"] for x in "ab")
    for name in ("a_groups", "b_groups", "pairs"):
        con.execute(f"DROP TABLE {name}")
    told = _told(a, b, grp_a, grp_b, len(named), sides)

    def per_doc(of_segment: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=of_segment[seg], minlength=n_docs).astype(np.int64)

    last = np.append(grp_a[1:] != grp_a[:-1], True)[: len(grp_a)]
    counted = {"n_a": a["seg"], "n_b": b["seg"], "n_groups": a["seg"][last]}
    out = {k: per_doc(np.bincount(v, minlength=len(named))) for k, v in counted.items()}
    out["n_overlaps"] = per_doc(np.bincount(met["seg"], weights=met["n"].astype(float), minlength=len(named)))
    parts, ends = [told[k] for k in seg.tolist()], np.searchsorted(doc, np.arange(n_docs + 1))
    out["groups"] = ["".join(parts[s:e])[:-1] for s, e in zip(ends[:-1], ends[1:], strict=True)]
    if separable and len(odd):  # bytes of one segment might make up for another's: the whole text decides
        again = _rows(con, texts.take(pa.array(odd)), sides, False)
        for k in ("n_a", "n_b", "n_groups", "n_overlaps"):
            out[k][odd] = again[k]
        for k, groups in zip(odd, again["groups"], strict=True):
            out["groups"][k] = groups
        pairs = {k: np.concatenate([v, odd[again["pairs"][k]] if k == "doc" else again["pairs"][k]]) for k, v in pairs.items()}
    by_doc = np.argsort(pairs["doc"], kind="stable")
    return out | {"pairs": {k: np.asarray(v)[by_doc] for k, v in pairs.items()}}


PAIR = pa.struct([("a_id", pa.int32()), ("b_id", pa.int32()), ("links", pa.int32())])
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, groups_sha256 string, groups string, pairs array<struct<a_id:int,b_id:int,links:int>>"


def align(docs: DataFrame, with_groups: bool = False, location: str | None = None) -> DataFrame:
    """Per document: counts of tokens, groups and overlaps, its groups (as text where asked for, and digested) and its linked ``pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        sides = byte_level(location=location), pieces(location=location)
        row = TaskContext.get().partitionId() << 40
        con = duckdb.connect(config={"threads": 1, "preserve_insertion_order": False})
        for whole in batches:
            for batch in slices(whole, 1, STEP_BYTES, STEP_ROWS):
                out = _rows(con, batch.column(1), sides)
                n, pairs = batch.num_rows, out["pairs"]
                ends = np.searchsorted(pairs["doc"], np.arange(n + 1)).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(pairs[f.name].astype(np.int32)) for f in PAIR], fields=list(PAIR))
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in out["groups"]]
                columns = [pa.array(np.arange(row, row + n)), batch.column(0).cast(pa.int64()), *(pa.array(out[k]) for k in ("n_a", "n_b", "n_groups", "n_overlaps"))]
                columns += [pa.array(digests, pa.string()), pa.array(out["groups"] if with_groups else [None] * n, pa.string()), pa.ListArray.from_arrays(pa.array(ends), flat)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256", "groups", "pairs"])
                row += n
                pa.default_memory_pool().release_unused()
        con.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ALIGNED)
    return rows if with_groups else rows.drop("groups")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a_id, b_id, count, best): how many links of the corpus each pair has, and whether no pair of its ``b_id`` has more."""
    counts = aligned.select(F.inline("pairs")).groupBy("a_id", "b_id").agg(F.sum("links").alias("count"))
    counts = materialise(counts, "pairs")
    most = counts.groupBy("b_id").agg(F.max("count").alias("most"))
    return counts.join(most, "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, limit: int = PAIRS) -> DataFrame:
    """``aligned`` without pairs, but with n_links, n_best and count_sum. Both are read more than once: written tables, best."""
    columns = [c for c in aligned.columns if c not in ("row", "pairs")]
    if counts.count() > limit:
        return _score_by_join(aligned, counts, columns)
    table = counts.select(_code("a_id", "b_id").alias("code"), "count", "best").toArrow().sort_by("code")
    known = aligned.sparkSession.sparkContext.broadcast(tuple(table.column(k).to_numpy() for k in ("code", "count", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, count, best = known.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("pairs"))
            flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            a, b, links = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            at = np.searchsorted(codes, a << 32 | b)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (links, links * best[at], links * count[at])]
            told = [pa.array((s[ends[1:]] - s[ends[:-1]]).astype(np.int64)) for s in sums]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in columns] + told, names=[*columns, "n_links", "n_best", "count_sum"])

    kinds = ", ".join(f"{c} {t}" for c, t in aligned.dtypes if c in columns)
    return aligned.select(*columns, "pairs").mapInArrow(run, f"{kinds}, n_links long, n_best long, count_sum long")


def _code(a: str, b: str):
    return F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(b).cast("long"))


def _score_by_join(aligned: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = aligned.select("row", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"), F.inline("pairs"))
    sums = held.join(salted, ["a_id", "b_id", "salt"]).groupBy("row")
    sums = sums.agg(F.sum("links").alias("n_links"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.select("row", *columns).join(sums, "row", "left").select(*columns, *[F.coalesce(c, none).alias(c) for c in ("n_links", "n_best", "count_sum")])
