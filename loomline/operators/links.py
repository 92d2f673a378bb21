"""Linked chains: journal replay in closed form, consistency, and ranks by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.asof import asof
from loomline.storage import materialise


def replay(ops: DataFrame, seq: str = "seq") -> DataFrame:
    """The links (src, dst, seq) alive after all ops (kind ``c`` a b, ``d+`` a, ``d-`` a), without a loop.

    A link lives exactly if its connect op is the last op on its source's forward side and on its target's backward
    side: two aggregations and two equi-joins on the op.
    """
    forward = ops.filter("kind IN ('c', 'd+')").groupBy(F.col("a").alias("src")).agg(F.max_by(F.struct("kind", "b", seq), seq).alias("op"))
    backward = ops.filter("kind IN ('c', 'd-')").select(F.when(F.col("kind") == "c", F.col("b")).otherwise(F.col("a")).alias("dst"), "kind", seq)
    backward = backward.groupBy("dst").agg(F.max_by(F.struct("kind", seq), seq).alias("op"))
    left = forward.filter("op.kind = 'c'").select("src", F.col("op.b").alias("dst"), F.col(f"op.{seq}").alias(seq))
    right = backward.filter("op.kind = 'c'").select("dst", F.col(f"op.{seq}").alias(seq))
    return left.join(right, ["dst", seq]).select("src", "dst", seq)


def ends(edges: DataFrame) -> DataFrame:
    """(node, role): heads that nothing points to and tails that point nowhere."""
    heads = edges.select(F.col("src").alias("node")).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    tails = edges.select(F.col("dst").alias("node")).join(edges.select(F.col("src").alias("node")), "node", "left_anti")
    return heads.distinct().withColumn("role", F.lit("head")).union(tails.distinct().withColumn("role", F.lit("tail")))


def broken(edges: DataFrame) -> DataFrame:
    """(node, side, n): nodes with more than one link on a side, which no consistent set has."""
    sides = [edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n")).filter("n > 1").select("node", F.lit(s).alias("side"), "n") for c, s in (("src", "posward"), ("dst", "negward"))]
    return sides[0].union(sides[1])


def ranks(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, head, pos, is_circular) for chains and rings; ``nodes`` adds nodes without links.

    Each round doubles how far back a node has looked, so chains of n nodes take log2(n) rounds; every round writes the
    nodes that haven't seen their head yet. A ring's head is its greatest node by text. A round that finishes no node leaves rings only,
    which are done once the look reaches over all of them.
    """
    named = edges.select("src").union(edges.select("dst")).toDF("node")
    named = (named if nodes is None else named.union(nodes.select("node"))).distinct()
    state = named.join(edges.select(F.col("dst").alias("node"), F.col("src").alias("back")), "node", "left")
    state = state.select("node", "back", F.coalesce("back", "node").alias("far"), F.lit(1).cast("long").alias("span"), F.col("node").alias("best"), F.lit(0).cast("long").alias("best_at"))
    state, reach, before = materialise(state, "ranks"), 1, -1
    parts, open_ = [state.filter("back IS NULL")], state.filter("back IS NOT NULL")
    while (left := open_.count()) and (left != before or reach < left):
        seen = open_
        for part in parts:
            seen = seen.union(part)
        past = seen.select(F.col("node").alias("back"), F.col("back").alias("back2"), F.col("far").alias("far2"), F.col("span").alias("span2"), F.col("best").alias("best2"), F.col("best_at").alias("at2"))
        greater = F.coalesce(F.col("best2").cast("string") > F.col("best").cast("string"), F.lit(False))
        further = open_.join(past, "back").select(
            "node",
            F.col("back2").alias("back"),
            F.col("far2").alias("far"),
            (F.col("span") + F.col("span2")).alias("span"),
            F.when(greater, F.col("best2")).otherwise(F.col("best")).alias("best"),
            F.when(greater, F.col("span") + F.col("at2")).otherwise(F.col("best_at")).alias("best_at"),
        )
        state = materialise(further, "ranks")
        parts.append(state.filter("back IS NULL"))
        open_, before, reach = state.filter("back IS NOT NULL"), left, reach * 2
    state = open_
    for part in parts:
        state = state.union(part)
    ring = F.col("back").isNotNull()
    return state.select("node", F.when(ring, F.col("best")).otherwise(F.col("far")).alias("head"), F.when(ring, F.col("best_at")).otherwise(F.col("span") - 1).alias("pos"), ring.alias("is_circular"))


def lengths(ranked: DataFrame) -> DataFrame:
    """(head, len, is_circular) of every rank."""
    return ranked.groupBy("head", "is_circular").agg(F.count("*").alias("len"))


def elide(ranked: DataFrame, most: int) -> DataFrame:
    """Of ranks longer than ``most``: the first most - 3 and the last 3 nodes, with a row that counts the hidden ones."""
    n = F.count("*").over(Window.partitionBy("head"))
    rows = ranked.withColumn("n", n)
    kept = rows.filter((F.col("n") <= most) | (F.col("pos") < most - 3) | (F.col("pos") >= F.col("n") - 3)).select("head", "pos", "node", F.lit(0).cast("long").alias("hidden"))
    gaps = rows.filter((F.col("n") > most) & (F.col("pos") == most - 3)).select("head", "pos", F.lit(None).cast(dict(ranked.dtypes)["node"]).alias("node"), (F.col("n") - most).cast("long").alias("hidden"))
    return kept.filter("NOT (node IS NULL)").union(gaps)


def narrate(ops: DataFrame) -> DataFrame:
    """Each op (kind, a, b, seq: a whole number) with what it did: ``outcome``, and the neighbours it detached.

    The state before an op needs no replay: the last earlier op on a cell's side says which link it had, and that link
    still held if it is also the last earlier op on the other end. That is two as-of joins for either side.
    """
    ops = ops.select("kind", "a", "b", "seq").withColumn("before", F.col("seq") - 1)
    forward = ops.filter("kind IN ('c', 'd+')").select(F.col("a").alias("cell"), F.col("seq").alias("before"), F.col("seq").alias("op"), F.when(F.col("kind") == "c", F.col("b")).alias("other"))
    backward = ops.filter("kind IN ('c', 'd-')").select(F.when(F.col("kind") == "c", F.col("b")).otherwise(F.col("a")).alias("cell"), F.col("seq").alias("before"), F.col("seq").alias("op"), F.when(F.col("kind") == "c", F.col("a")).alias("other"))

    def neighbour(asked: DataFrame, mine: DataFrame, theirs: DataFrame, name: str) -> DataFrame:
        """(op, name): the cell linked to ``cell`` on this side just before ``op``."""
        had = asof(asked, mine, ["cell"], "before", {"op": "link", "other": "other"}, "op").filter("other IS NOT NULL")
        held = asof(had.select(F.col("other").alias("cell"), "before", "op", "link"), theirs, ["cell"], "before", {"op": "last"}, "op")
        return held.filter("last = link").select("op", F.col("cell").alias(name))

    asks_forward = ops.filter("kind IN ('c', 'd+')").select(F.col("a").alias("cell"), "before", F.col("seq").alias("op"))
    asks_backward = ops.filter("kind IN ('c', 'd-')").select(F.when(F.col("kind") == "c", F.col("b")).otherwise(F.col("a")).alias("cell"), "before", F.col("seq").alias("op"))
    after, prior = neighbour(asks_forward, forward, backward, "had_next"), neighbour(asks_backward, backward, forward, "had_prev")
    out = ops.withColumnRenamed("seq", "op").join(after, "op", "left").join(prior, "op", "left")
    same = (F.col("kind") == "c") & F.col("had_next").eqNullSafe(F.col("b"))
    gone = F.col("had_next").isNotNull() | F.col("had_prev").isNotNull()
    outcome = F.when(F.col("kind") == "s", "text").when(F.col("kind") == "c", F.when(same, "noop").otherwise("link")).otherwise(F.when(gone, "unlink").otherwise("noop"))
    return out.select(F.col("op").alias("seq"), "kind", "a", "b", outcome.alias("outcome"), F.when(~same, F.col("had_next")).alias("detached_next"), F.when(~same, F.col("had_prev")).alias("detached_prev"))
