"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier per bit (log-odds of hashed byte trigrams of the lower-cased text)
predicts that bit, and loss-weighted decoding picks the nearest codeword. Bits that were unreliable for a language on
the validation half of the sample weigh less in its distance. Close decisions are flagged as ambiguous.

The classifiers are fitted to a bounded sample: of every language that a learnable document has about
``docs_per_language`` documents, chosen by a hash of the row. Tasks count trigrams, the counts are summed by a shuffle,
and the driver gets languages x BUCKETS numbers at most: it bounds the documents of a language, never the languages.
Prediction is one pass over the whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; an empty or very short text with a letter
is classified like any other; documents without a language are never learnt from; without any labelled document all
are ``und``; with one language all are that one; repeated rows are classified alike; equal distances go to the language
that sorts first and are ambiguous; extra columns are passed on only where ``carry`` names them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import slices, text_bytes
from loomline.storage import materialise

BUCKETS = 1 << 16
SCALE = 4096
UNKNOWN = "und"


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The trigram bucket at each byte of the lower-cased texts (BUCKETS where none begins), and the rows' starts."""
    fold = np.arange(256, dtype=np.uint32)
    fold[:128] = 32
    fold[97:123] = np.arange(97, 123)
    data, rows = text_bytes(pc.utf8_lower(column))
    letters = np.concatenate([fold[data], np.full(2, 32, np.uint32)])
    out = ((letters[:-2] << np.uint32(16) | letters[1:-1] << np.uint32(8) | letters[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    ends = np.concatenate([rows[1:] - 1, rows[1:] - 2])
    out[ends[(ends >= np.concatenate([rows[:-1]] * 2)) & (ends >= 0)]] = BUCKETS
    return out, rows


def held_out(doc_id: Column) -> Column:
    """Documents that are never learnt from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """+1/-1 codewords, one row for each class: all splits for up to six classes, else the best of 200 random codes."""
    if n <= 6:
        patterns = [[1 if i == 0 else (1 if k >> (i - 1) & 1 else -1) for i in range(n)] for k in range(2 ** max(n - 1, 0) - 1)]
        return np.array(patterns, np.int64).T.reshape(n, -1)
    bits, rng, best = 8 + 6 * int(np.ceil(np.log2(n))), np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        code = rng.choice([-1, 1], (n, bits))
        apart = int((bits - (code @ code.T)[~np.eye(n, dtype=bool)].max()) // 2)  # bits in which the nearest two differ
        if apart > best[0] and (np.abs(code.sum(axis=0)) < n).all():
            best = (apart, code)
    return best[1].astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS + 1 x bits, fixed point; the last row is zero
    trust: np.ndarray  # languages x bits, rows sum to 1
    sharpness: float = 6.0
    margin: float = 0.08

    def bits(self, buckets: np.ndarray) -> np.ndarray:
        """The classifiers' outputs in [-1, 1] for a text's trigrams; sums are integers, so chunks don't matter."""
        total, n = np.zeros(self.code.shape[1], np.int64), 0
        for at in range(0, len(buckets), 1 << 16):
            part = buckets[at : at + (1 << 16)]
            total += self.weights[part].sum(axis=0)
            n += int((part < BUCKETS).sum())
        return np.tanh(2.0 * total / (SCALE * max(n, 1)))

    def distances(self, bits: np.ndarray) -> np.ndarray:
        """Loss-weighted distance to each codeword, with the exponential loss."""
        return (self.trust * np.exp(-self.code * bits)).sum(axis=1)

    def decide(self, buckets: np.ndarray) -> tuple[str, float, bool]:
        d = self.distances(self.bits(buckets))
        order = np.argsort(d, kind="stable")
        p = np.exp(-self.sharpness * (d - d[order[0]]))
        close = len(d) > 1 and d[order[1]] - d[order[0]] < self.margin
        return self.languages[order[0]], float(1 / p.sum()), bool(close)


def _sample(docs: DataFrame, docs_per_language: int) -> tuple[tuple[str, ...], DataFrame | None]:
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = materialise(known.groupBy("lang").agg(F.least(F.lit(1.0), docs_per_language / F.count("*")).alias("share")), "languages")
    languages = tuple(sorted(r["lang"] for r in counts.select("lang").collect()))
    if not languages:
        return (), None
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    chosen = known.join(F.broadcast(counts), "lang").filter(draw < F.col("share"))
    return languages, chosen.select("lang", "text", (F.pmod(F.xxhash64("doc_id", "text", F.lit("halves")), F.lit(4)) > 0).alias("fit"))


def train(docs: DataFrame, docs_per_language: int = 1500, smoothing: float = 0.5) -> Model:
    """A model learnt only from text and non-null lang of documents that aren't held out."""
    languages, sample = _sample(docs, docs_per_language)
    index = {name: k for k, name in enumerate(languages)}
    if len(languages) < 2:
        return Model(languages, np.ones((len(languages), 1), np.int64), np.zeros((BUCKETS + 1, 1), np.int64), np.ones((len(languages), 1)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, 1):
                buckets, rows = _buckets(batch.column(1))
                for k, name in enumerate(batch.column(0).to_pylist()):
                    table = tables.setdefault(index[name], np.zeros(BUCKETS + 1, np.int64))
                    table += np.bincount(buckets[rows[k] : rows[k + 1]], minlength=BUCKETS + 1)
        for lang, table in tables.items():
            bucket = np.flatnonzero(table[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), lang, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(table[bucket])], names=["l", "b", "n"])

    counted = sample.filter("fit").select("lang", "text").mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = (counted[c].to_numpy() for c in ("l", "b", "n"))
    total = np.bincount(lang, n, len(languages)) + smoothing * BUCKETS
    share = n / total[lang]  # of each language's trigrams, beyond smoothing / total, which every trigram has
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS + 1, code.shape[1]), np.int64)
    for bit in range(code.shape[1]):
        sides = []
        for side in (1, -1):
            own = code[:, bit] == side
            sides.append(((smoothing / total[own]).sum() + np.bincount(bucket[own[lang]], share[own[lang]], BUCKETS)) / own.sum())
        weights[:BUCKETS, bit] = np.rint(SCALE * np.log(sides[0] / sides[1]))
    model = Model(languages, code, weights, np.full(code.shape, 1 / code.shape[1]))

    def validate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, seen = np.zeros(code.shape, np.int64), np.zeros(len(languages), np.int64)
        for whole in batches:
            for batch in slices(whole, 1):
                buckets, rows = _buckets(batch.column(1))
                for k, name in enumerate(batch.column(0).to_pylist()):
                    right[index[name]] += model.bits(buckets[rows[k] : rows[k + 1]]) * code[index[name]] > 0
                    seen[index[name]] += 1
        lang, bit = np.indices(code.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (lang, bit, right[lang, bit], seen[lang])], names=["l", "b", "n_right", "n"])

    checked = sample.filter("NOT fit").select("lang", "text").mapInArrow(validate, "l long, b long, n_right long, n long").groupBy("l", "b").agg(F.sum("n_right").alias("r"), F.sum("n").alias("n")).collect()
    trust = np.full(code.shape, 0.5)
    for r in checked:
        trust[r["l"], r["b"]] = (r["r"] + 1) / (r["n"] + 2)
    return Model(languages, code, weights, trust / trust.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, model: Model, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry``, then lang_pred, score and ambiguous for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1):
                text = batch.column(batch.num_columns - 1)
                lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_pylist()
                buckets, rows = _buckets(text)
                found = [m.decide(buckets[rows[k] : rows[k + 1]]) if ok and m.languages else (UNKNOWN, 0.0, False) for k, ok in enumerate(lettered)]
                columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*carry, "lang_pred", "score", "ambiguous"])

    frame = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in frame.dtypes[:-1])
    return frame.mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean")
