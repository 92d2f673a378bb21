"""Containment, threads and grid views: rounds of joins, each written once to the shared folder; none is cut off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.scans import Split, scan
from loomline.storage import discard, materialise


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """All (container, thing) of edges (container, thing), cycles included; a container on a cycle contains itself.

    A round joins what is new with all that was found, on either side, so lengths double and n levels take log2(n)
    rounds. Only pairs that weren't found yet go on, each is written once, and it ends when there are none.
    """
    parts = [materialise(edges.select("container", "thing").distinct(), "pairs")]
    while True:
        fresh, found = parts[-1], _all(parts)
        ahead = fresh.join(found.toDF("thing", "next"), "thing").select("container", F.col("next").alias("thing"))
        behind = found.join(fresh.toDF("thing", "next"), "thing").select("container", F.col("next").alias("thing"))
        step = ahead.union(behind).distinct().join(found, ["container", "thing"], "left_anti")
        parts.append(materialise(step, "pairs"))
        if not parts[-1].head(1):
            discard(parts.pop())
            return _all(parts)


def preorder(nodes: DataFrame, split: Split = None) -> DataFrame:
    """(id, root, root_sort, depth, pos, size) of nodes (id, parent, sort): ``pos`` is the place in its thread from 0,
    parents before children and siblings by (sort, id); ``size`` counts the node and all below it.

    Nodes whose parent is null or not there are roots; those on a reply cycle, or below one, are reached from no root and
    come with nulls instead of vanishing. Of rows with one id that of the least (sort, parent) counts.

    No node holds its path. Going up, every node looks to the ancestor 2, 4, 8, … above it and hands it what it has
    counted, so sizes of n levels take log2(n) rounds; a node's place among its siblings follows from their sizes (one
    running sum, cut by ``split`` where a node may have very many children), and the same jumps add these offsets up from
    the root. A round that brings no node to its root leaves cycles only. All joins are by shuffles, so that nothing
    passes through the driver, however well the tables compress; roots, which look no further, are dealt by their ids.
    """
    rows = nodes.groupBy("id").agg(F.min(F.struct("sort", "parent")).alias("n")).select("id", "n.sort", "n.parent")
    known = rows.select(F.col("id").alias("up"), F.lit(True).alias("_there"))
    rows = rows.withColumn("up", F.coalesce("parent", "id")).join(known.hint("merge"), "up", "left").select("id", "sort", F.when(F.col("_there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("size"))
    jumps = [materialise(rows, "threads")]
    rooted = jumps[0].filter("up IS NULL").count()
    while jumps[-1].filter("up IS NOT NULL").head(1):
        now = jumps[-1]
        below = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("below"))
        above = now.select(F.col("id").alias("_to"), F.col("up").alias("up2"))
        step = now.join(below.hint("merge"), "id", "left").withColumn("_to", F.coalesce("up", "id")).join(above.hint("merge"), "_to", "left")
        jumps.append(materialise(step.select("id", F.col("up2").alias("up"), (F.col("size") + F.coalesce("below", F.lit(0))).alias("size")), "threads"))
        before, rooted = rooted, jumps[-1].filter("up IS NULL").count()
        if rooted == before:
            break
    sized = jumps[0].drop("size").join(jumps[-1].select("id", "size").hint("merge"), "id")
    offsets = scan(sized, ["up"], ["sort", "id"], sums={"_ahead": F.col("size")}, split=split)
    offset = F.when(F.col("up").isNull(), 0).otherwise(F.col("_ahead") - F.col("size") + 1)
    told = materialise(offsets.select("id", "size", offset.alias("pos"), F.when(F.col("up").isNull(), F.struct("id", "sort")).alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth")), "places")
    for jump in jumps[:-1]:
        at = told.select(F.col("id").alias("_to"), *[F.col(c).alias(f"_{c}") for c in ("pos", "root", "depth")])
        step = told.join(jump.filter("up IS NOT NULL").select("id", "up").hint("merge"), "id", "left").withColumn("_to", F.coalesce("up", "id")).join(at.hint("merge"), "_to", "left")
        step = step.select("*", *[F.when(F.col("up").isNotNull(), F.col(f"_{c}")).alias(f"{c}2") for c in ("pos", "root", "depth")])
        before, told = told, materialise(step.select("id", "size", (F.col("pos") + F.coalesce("pos2", F.lit(0))).alias("pos"), F.coalesce("root", "root2").alias("root"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")), "places")
        discard(before)
    discard(*jumps)
    lost = F.col("root").isNull()
    return told.select("id", F.col("root.id").alias("root"), F.col("root.sort").alias("root_sort"), *[F.when(~lost, F.col(c)).alias(c) for c in ("depth", "pos", "size")])


def grid_view(start: DataFrame, edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Breadth-first placement (cell, x, y, z) from ``start`` (cell) along edges (axis 0-2, src, dst).

    The first placement wins. First-in-first-out order is the order of step codes (axis by axis, posward before
    negward) along the path, so frontiers are compared by their path arrays instead of a global queue. A neighbour
    without a cell row takes its place but is neither shown nor expanded. A round for every step away from the start;
    it ends when no cell is new.
    """
    both = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), (2 * F.col("axis")).alias("code")).union(edges.select("dst", "src", 2 * F.col("axis") + 1))
    both = materialise(both, "steps")
    level = materialise(start.select(F.col("cell").alias("cell"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), F.array().cast("array<int>").alias("path")), "level")
    parts = [level]
    while True:
        placed = _all(parts)
        shown = level.join(cells.select("cell"), "cell", "left_semi")
        moved = shown.join(both, F.col("cell") == F.col("at"))
        sign = F.when(F.col("code") % 2 == 0, 1).otherwise(-1)
        axis = F.floor(F.col("code") / 2)
        step = [(F.col(c) + F.when(axis == k, sign).otherwise(0)).cast("int").alias(c) for k, c in enumerate("xyz")]
        moved = moved.select(F.col("to").alias("cell"), *step, F.concat("path", F.array(F.col("code").cast("int"))).alias("path")).join(placed, "cell", "left_anti")
        first = moved.groupBy("cell").agg(F.min_by(F.struct("x", "y", "z", "path"), "path").alias("p"))
        level = materialise(first.select("cell", "p.*"), "level")
        if not level.head(1):
            return placed.join(cells.select("cell"), "cell", "left_semi").select("cell", "x", "y", "z")
        parts.append(level)


def outline(nodes: DataFrame, depth: int) -> DataFrame:
    """(id, root, depth, pos, hidden) of a forest's nodes down to ``depth``, and how many lie below each of the last level."""
    shown = preorder(nodes).filter(F.col("depth") <= depth)
    return shown.select("id", "root", "depth", "pos", F.when(F.col("depth") == depth, F.col("size") - 1).otherwise(0).alias("hidden"))
