"""Nested JSON documents as rows: structure snapshots, and comment exports with recursive content."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SNAPSHOT = (
    "schemaVersion int, ownerId string, revision long, "
    "cells array<struct<id:string,kind:string,ownerId:string,documentId:string,dimensionId:string,viewId:string,name:string,of:string>>, "
    "dimensions array<struct<id:string,namespace:string,name:string,qualifiedName:string,dimensionCellId:string,ownerId:string>>, "
    "connections array<struct<cellId:string,dimensionId:string,negwardId:string,poswardId:string>>"
)


def read_snapshots(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cells, dimensions and connections of snapshot files, each with owner and revision; no rows where there is no file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    rows = spark.read.schema(SNAPSHOT).json(path, multiLine=True) if there else spark.createDataFrame([], SNAPSHOT)
    return {part: rows.select("ownerId", "revision", F.inline(part)) if part == "connections" else rows.select(F.col("ownerId").alias("owner"), "revision", F.inline(part)) for part in ("cells", "dimensions", "connections")}


def snapshot_json(cells: DataFrame, dimensions: DataFrame, connections: DataFrame, revisions: DataFrame) -> DataFrame:
    """(ownerId, json): one document per owner, arrays in id order."""
    parts = [
        rows.groupBy("ownerId").agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "ownerId" or name != "connections"]))).alias(name))
        for name, rows in (("cells", cells), ("dimensions", dimensions), ("connections", connections))
    ]
    out = revisions.select("ownerId", "revision")
    for p in parts:
        out = out.join(p, "ownerId", "left")
    empty = [F.coalesce(n, F.array()).alias(n) for n in ("cells", "dimensions", "connections")]
    return out.select("ownerId", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), "ownerId", "revision", *empty)).alias("json"))


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Rows (ownerId, json) to ``path``, a folder for each owner; the job's commit makes them appear as a whole."""
    snapshots.select(F.col("ownerId").alias("owner"), F.col("json").alias("value")).write.mode("overwrite").partitionBy("owner").text(path)


USERS = "users array<struct<id:string,displayName:string,handle:string,dataFile:string>>"


def users(files: DataFrame) -> DataFrame:
    """(id, displayName, handle, dataFile) of user files (file, text); of several rows with one id the last of the last file counts."""
    rows = files.select("file", F.from_json("text", USERS).alias("u")).select("file", F.posexplode("u.users").alias("place", "user"))
    return rows.groupBy(F.col("user.id").alias("id")).agg(F.max_by("user", F.struct("file", "place")).alias("user")).select("id", "user.displayName", "user.handle", "user.dataFile")


def mirrored(connections: DataFrame) -> DataFrame:
    """(owner, dim, src, dst) once, from connection records that store every link at both ends."""
    a = connections.filter("poswardId IS NOT NULL").select(F.col("ownerId").alias("owner"), F.col("dimensionId").alias("dim"), F.col("cellId").alias("src"), F.col("poswardId").alias("dst"))
    b = connections.filter("negwardId IS NOT NULL").select("ownerId", "dimensionId", "negwardId", "cellId")
    return a.union(b).distinct()


def half_links(connections: DataFrame) -> DataFrame:
    """Links that only one end records."""
    a = connections.filter("poswardId IS NOT NULL").select("ownerId", "dimensionId", F.col("cellId").alias("src"), F.col("poswardId").alias("dst"), F.lit(1).alias("n"))
    b = connections.filter("negwardId IS NOT NULL").select("ownerId", "dimensionId", "negwardId", "cellId", F.lit(2))
    return a.union(b).groupBy("ownerId", "dimensionId", "src", "dst").agg(F.sum("n").alias("ends")).filter("ends < 3")


COMMENTS = (
    "comments array<struct<id:string,author:string,targetAccount:string,targetPath:string,replyParent:string,threadRoot:string,content:variant,createTime:string,visibility:string>>, "
    "authors map<string,struct<metadata:struct<name:string>>>"
)


def comments(files: DataFrame) -> DataFrame:
    """One row per comment of exports (file, text): ids, parent, author's name (else 12 characters of the id), created, blocks.

    ``created`` is the text of the instant, empty if missing, so that comments sort by it as text and then by place.
    A file that is no JSON, is damaged or nested more than about 500 replies deep gives no comments; ``unreadable`` names it.
    """
    parsed = files.select("file", F.from_json("text", COMMENTS, {"mode": "PERMISSIVE"}).alias("e"))
    rows = parsed.select("file", F.col("e.authors").alias("authors"), F.posexplode("e.comments").alias("place", "c"))
    author = F.coalesce(F.col("authors")[F.col("c.author")]["metadata"]["name"], F.substring("c.author", 1, 12))
    return rows.select(
        "file", "place", F.col("c.id").alias("id"), F.nullif(F.col("c.replyParent"), F.lit("")).alias("parent"), author.alias("author"), F.coalesce("c.createTime", F.lit("")).alias("created"), F.concat_ws("/", "c.targetAccount", "c.targetPath").alias("target"), F.to_json("c.content").alias("content")
    )


def _rows_of(content: str | None) -> str | None:
    """The blocks of recursive content as JSON rows [depth, type, id, text], parents before children."""
    if not content:
        return None
    rows, waiting = [], [(0, iter(json.loads(content) or ()))]
    while waiting:
        depth, level = waiting[-1]
        node = next(level, None)
        if node is None:
            waiting.pop()
            continue
        held = node.get("block") or {}
        rows.append([depth, *map(held.get, ("type", "id", "text"))])
        if below := node.get("children"):
            waiting.append((depth + 1, iter(below)))
    return json.dumps(rows)


@F.pandas_udf(StringType())
def _flat(content: pd.Series) -> pd.Series:
    return pd.Series([_rows_of(c) for c in content], dtype=object)


def unreadable(files: DataFrame) -> DataFrame:
    """(file, problem) of the exports (file, text) that ``comments`` gives no rows for."""
    parsed = files.select("file", "text", F.from_json("text", COMMENTS, {"mode": "PERMISSIVE"}).alias("e"))
    text = F.trim(F.coalesce("text", F.lit("")))
    problem = F.when(text == "", "empty").when(F.col("e.comments").isNull() & text.rlike(r"^[{]"), "no comments, damaged, or nested too deep").when(F.col("e.comments").isNull(), "no JSON object")
    return parsed.select("file", problem.alias("problem")).filter("problem IS NOT NULL")


def blocks(rows: DataFrame, content: Column) -> DataFrame:
    """(…, seq, depth, type, block_id, text) of recursive content, in preorder; blank texts are left out."""
    flat = F.from_json(_flat(content), "array<array<string>>")
    out = rows.select("*", F.posexplode(flat).alias("seq", "_b"))
    out = out.select(*rows.columns, "seq", F.get("_b", 0).cast("int").alias("depth"), F.get("_b", 1).alias("type"), F.get("_b", 2).alias("block_id"), F.get("_b", 3).alias("text"))
    return out.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
