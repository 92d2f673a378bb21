"""Append-only logs as Structured Streaming: copies that give every block exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.storage import shared_path

#: Backends by name: (spark, path, schema) to a streaming DataFrame.
BACKENDS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {
    "parquet": lambda spark, path, schema: spark.readStream.schema(schema).parquet(path),
    "json": lambda spark, path, schema: spark.readStream.schema(schema).json(path),
    "text": lambda spark, path, schema: spark.readStream.text(path),
}


def open_log(spark: SparkSession, backend: str, path: str, schema: str, glob: str | None = None) -> DataFrame:
    """A log's blocks as a stream; ``glob`` picks files of the folder by name."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend}")
    if glob:
        return spark.readStream.format(backend).schema(schema).option("pathGlobFilter", glob).load(path)
    return BACKENDS[backend](spark, path, schema)


def replicate(log: DataFrame, path: str, checkpoint: str) -> None:
    """Copies all blocks that are there now to ``path``; run again it copies only what came since."""
    log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def subscribe(log: DataFrame, on_append: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Calls ``on_append(blocks, batch)`` with every batch of new blocks, each block once."""
    log.writeStream.foreachBatch(on_append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def lengths(blocks: DataFrame, by: list[str], data: str) -> DataFrame:
    """Length in blocks and in bytes of each log."""
    return blocks.groupBy(*by).agg(F.count("*").alias("length"), F.coalesce(F.sum(F.octet_length(data)), F.lit(0)).alias("byte_length"))


def replicated(spark: SparkSession, log: DataFrame) -> DataFrame:
    """The log's blocks through a copy in the shared folder."""
    out = shared_path(spark, "log")
    replicate(log, f"{out}/blocks", f"{out}/checkpoint")
    return spark.read.schema(log.schema).parquet(f"{out}/blocks")
