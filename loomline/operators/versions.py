"""Versions: differences, mirroring, caches and revision counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, change): added, deleted or modified keys between two versions."""
    a = old.select(*by, F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*by, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return a.join(b, list(by), "full_outer").select(*by, change.alias("change")).filter("change IS NOT NULL")


def to_mirror(source: DataFrame, target: DataFrame, by: Sequence[str], content: Column) -> DataFrame:
    """Rows of the source whose key and content hash the target lacks: only what changed is written."""
    a = source.withColumn("content_hash", F.sha2(content, 256))
    return a.join(target.select(*by, F.sha2(content, 256).alias("content_hash")), [*by, "content_hash"], "left_anti")


def fifo(df: DataFrame, key: str, order: Sequence[str], size: int = 24) -> DataFrame:
    """The keys a first-in-first-out cache holds in the end: a key that is asked for again doesn't move."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("entered"))
    return first.orderBy(F.desc("entered")).limit(size)


def with_revision(log: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every accepted mutation of an owner raises its revision by one, no-ops included."""
    return log.withColumn("revision", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def commit_conflict(current: DataFrame, requests: DataFrame, by: Sequence[str]) -> DataFrame:
    """Optimistic check: requests (by, expected) with ``accepted`` where the expected revision is the current one or not given."""
    joined = requests.join(current.select(*by, F.col("revision").alias("_now")), list(by), "left")
    return joined.select(*requests.columns, (F.col("expected").isNull() | (F.col("expected") == F.coalesce("_now", F.lit(0)))).alias("accepted"))


def retention(df: DataFrame, expires: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """Rows kept and rows expired (strictly after their expiry)."""
    gone = F.coalesce(now > expires, F.lit(False))
    return df.filter(~gone), df.filter(gone)


def pull(source: DataFrame, target: DataFrame, registry: DataFrame, version: DataFrame, by: Sequence[str], name: str, content: Column) -> tuple[DataFrame, DataFrame]:
    """What a pull writes (rows that the target lacks), and the registry (name, last_version) after it.

    ``version`` (name, version) is what the source has now; a drive that was never pulled has last version 0 before.
    """
    new = to_mirror(source, target, by, content)
    seen = registry.select(name, F.col("last_version").alias("_before"))
    after = version.join(seen, name, "full_outer").select(name, F.coalesce("version", "_before", F.lit(0)).alias("last_version"))
    return new, after
