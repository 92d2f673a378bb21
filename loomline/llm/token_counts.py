"""Token totals by source, language and tokenizer version, maintained from signed deltas.

A batch of changes (inserts, deletes, revised counts) is reduced to signed sums per key and committed under its name.
A committed batch is never applied again, so batches can be replayed. A batch is written aside and moved into place, and
counts once its _SUCCESS file is there; what a lost writer left is not read. ``compact`` folds committed batches into a
snapshot, so that totals need not read every batch since the beginning; ``vacuum`` deletes what a snapshot holds.

Defined cases: null source, language or tokenizer are keys of their own; null counts are zero; repeated rows in a batch
count each; an empty batch is committed and changes nothing; keys whose documents and tokens are all withdrawn are left
out of the totals; extra columns of a batch are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.shared import slices, text_bytes, word_spans
from loomline.llm.tokens import BYTE_BPE, encoder

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
TOKENIZERS = ("words@1", f"{BYTE_BPE}@1")


def count_tokens(docs: DataFrame, tokenizers: Sequence[str] = TOKENIZERS, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens and ``carry``: one row per document and tokenizer version, over whole texts.

    ``words@1`` counts runs of non-space characters; any other name is a vocabulary before the ``@``.
    """
    names = ["doc_id", "source", "lang", "tokenizer", "n_tokens", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3):
                text = batch.column(3)
                for name in tokenizers:
                    if name == "words@1":
                        n = np.diff(word_spans(*text_bytes(text))[2])
                    else:
                        encode = encoder(name.split("@")[0])
                        n = np.array([len(encode(t or "")) // 4 for t in text.to_pylist()], np.int64)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([name] * batch.num_rows, pa.string()), pa.array(n, pa.int64()), *batch.columns[4:]], names=names)

    frame = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"), *carry)
    extra = "".join(f", `{c}` {t}" for c, t in frame.dtypes[4:])
    return frame.mapInArrow(run, f"doc_id long, source string, lang string, tokenizer string, n_tokens long{extra}")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("d_docs"), F.coalesce("n_tokens", F.lit(0)).alias("d_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("d_docs"), (-F.coalesce("n_tokens", F.lit(0))).alias("d_tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """From old_tokens to n_tokens of the same document."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("d_docs"), (F.coalesce("n_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))).alias("d_tokens"))


class Rollup:
    """The rollup kept under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _whole(self, path: str) -> bool:
        fs, at = self._fs(f"{path}/_SUCCESS")
        return fs.exists(at)

    def batches(self) -> list[str]:
        """Names of the committed batches whose files are still there, sorted."""
        return [b for b in self._names("batches") if self._whole(f"{self.path}/batches/{b}")]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch once; False if it was committed before.

        The batch is written under a name of its own and moved into place when it is whole, so that of several writers
        of one batch the first to move it counts and a lost one leaves nothing that is read.
        """
        at = f"{self.path}/batches/{batch}"
        if self._whole(at) or batch in self._snapshot()[1]:
            return False
        summed = changes.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        new = f"{self.path}/pending/{batch}-{uuid.uuid4().hex}"
        summed.write.parquet(new)
        fs, target = self._fs(at)
        done = self._whole(at)
        if not done:
            fs.delete(target, True)  # what a lost writer without this care left
            fs.mkdirs(target.getParent())
            done = not fs.rename(self._fs(new)[1], target)
        self._delete(new)
        return not done

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def _snapshot(self) -> tuple[str | None, set[str]]:
        for name in reversed(self._names("snapshots")):
            at = f"{self.path}/snapshots/{name}"
            if self._whole(f"{at}/totals") and self._whole(f"{at}/batches"):
                return at, {r["batch"] for r in self.spark.read.parquet(f"{at}/batches").collect()}
        return None, set()

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        at, held = self._snapshot()
        parts = [f"{self.path}/batches/{b}" for b in self.batches() if b not in held] + ([f"{at}/totals"] if at else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        out = rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return out.filter("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """A new snapshot of all committed batches; it counts once its list of batches is whole, which is written last."""
        at, held = self._snapshot()
        names = sorted(held.union(self.batches()))
        if set(names) == held:
            return
        new = f"{self.path}/snapshots/{1 + int(max(self._names('snapshots'), default='0')):09d}"
        self.totals().withColumnsRenamed({"n_docs": "d_docs", "n_tokens": "d_tokens"}).write.mode("overwrite").parquet(f"{new}/totals")
        self.spark.createDataFrame([(n,) for n in names], "batch string").write.mode("overwrite").parquet(f"{new}/batches")

    def vacuum(self) -> None:
        """Deletes batches that the newest snapshot holds, and older snapshots; their names stay known."""
        at, held = self._snapshot()
        for batch in held.intersection(self._names("batches")):
            self._delete(f"{self.path}/batches/{batch}")
        for name in self._names("snapshots"):
            if at and f"{self.path}/snapshots/{name}" < at:
                self._delete(f"{self.path}/snapshots/{name}")
