"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` places on a ring of 2^32 positions; a row's home is the shard of the first place at or after
its key's position. A shard keeps rows of its own places, place by place clockwise, up to its capacity; what is over
continues clockwise from its place to the next shard with room, again place by place. With ``slack`` 0 capacities add up
to the number of rows (law ``rows``: counts at most one apart); with more slack fewer rows leave their home.

All rows of an arc (what lies before one place) have the same way clockwise, so the walk needs the arcs' row counts
alone: shards x vnodes numbers, whatever the corpus. It cuts each arc's ranks into intervals, one for each shard that
takes some of them, with a base of slots. The rest is Catalyst's: rows find their arc by a join on the ring's cells,
are ranked within it in buckets of bounded size, and read shard and slot off the interval. So no arc, shard or key, however
many rows it holds, is in one task.

Defined cases: a null text has size 1 and the checksum of an empty one; a null doc_id is a key like any other; rows of
one key have one home and are told apart by size and checksum; repeated rows are interchangeable and get slots that
follow each other; a key with more rows than fit goes on clockwise with what is over; an empty table gives no rows;
with fewer rows than shards some stay empty; columns other than the key and text are not read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.storage import materialise

SHARDS, VNODES = 16, 128
#: Rows of an arc that are ranked together, and repeated rows that one task expands.
BUCKET, CHUNK = 200_000, 100_000
#: Buckets whose offsets may be broadcast to the rows; beyond, they are joined by a shuffle.
BROADCAST_BUCKETS = 100_000
_SPACE = 1 << 32


def _position(*columns):
    return F.shiftrightunsigned(F.xxhash64(*columns), 32)


def ring(spark: SparkSession, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """(arc, shard, pos): the places of all shards in ring order; a shard's places don't depend on how many others there are."""
    places = spark.range(shards * vnodes).select(F.floor(F.col("id") / vnodes).cast("int").alias("shard"), (F.col("id") % vnodes).cast("int").alias("place"))
    places = places.select("shard", _position(F.lit("place"), "shard", "place").alias("pos"))
    return places.select((F.row_number().over(Window.orderBy("pos", "shard")) - 1).alias("arc"), "shard", "pos")


def _cells(places: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The arcs as (cell, lo, hi, arc), lo exclusive, one row for each cell of the ring that an arc touches, and a cell's width in bits."""
    bits = max(32 - (4 * n - 1).bit_length(), 0)
    w = Window.orderBy("arc")
    arcs = places.select("arc", F.coalesce(F.lag("pos").over(w), F.lit(-1)).alias("lo"), F.col("pos").alias("hi"))
    around = places.agg(F.max("pos").alias("lo")).select(F.lit(0).alias("arc"), "lo", F.lit(_SPACE - 1).alias("hi"))
    cells = F.sequence(F.shiftright(F.col("lo") + 1, bits), F.shiftright("hi", bits))
    return arcs.union(around).filter("lo < hi").select(F.explode(cells).alias("cell"), "lo", "hi", "arc"), bits


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may hold: without slack they add up to ``rows``."""
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(owners: Sequence[int], counts: Sequence[int], room: Sequence[int]) -> list[list[tuple[int, int]]]:
    """For each arc in ring order the shards that take its rows, in rank order, with their numbers."""
    room, left = list(room), list(counts)
    taken: list[list[tuple[int, int]]] = [[] for _ in owners]

    def give(arc: int, shard: int) -> None:
        if n := min(room[shard], left[arc]):
            room[shard] -= n
            left[arc] -= n
            taken[arc].append((shard, n))

    for arc, shard in enumerate(owners):  # every shard keeps its own first
        give(arc, shard)
    for arc in range(len(owners)):
        at = arc
        while left[arc]:
            at = (at + 1) % len(owners)
            give(arc, owners[at])
            if at == arc:
                raise ValueError("the shards have less room than there are rows")
    return taken


def _plan(owners: list[int], counts: list[int], shards: int, slack: float, bucket: int) -> list[dict]:
    """Each arc's number of buckets and intervals of ranks, with the slot where each begins."""
    base, out = [0] * shards, []
    for arc, taken in enumerate(walk(owners, counts, capacities(sum(counts), shards, slack))):
        intervals, at = [], 0
        for shard, n in taken:
            intervals.append({"begin": at, "end": at + n, "shard": shard, "slot": base[shard]})
            base[shard] += n
            at += n
        out.append({"arc": arc, "home": owners[arc], "buckets": max(1, -(-counts[arc] // bucket)), "intervals": intervals})
    return out


_PLAN = "array<struct<arc:int,home:int,buckets:int,intervals:array<struct<begin:bigint,end:bigint,shard:int,slot:bigint>>>>"


def place(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0, key: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """Every row's doc_id (or other ``key``), size, text_crc32, law, shard, slot and grown_shard, and its ``home``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(key, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy(key, "size", "text_crc32").agg(F.count("*").alias("copies"))

    places = ring(spark, shards, vnodes)
    owners = [r["shard"] for r in places.orderBy("arc").collect()]
    cells, bits = _cells(places, shards * vnodes)
    rows = rows.withColumn("pos", _position(F.lit("key"), key))
    found = rows.join(F.broadcast(cells), (F.shiftright("pos", bits) == F.col("cell")) & (F.col("pos") > F.col("lo")) & (F.col("pos") <= F.col("hi")))
    found = materialise(found.select(key, "size", "text_crc32", "copies", "arc"), "arcs")

    known = {r["arc"]: r["n"] for r in found.groupBy("arc").agg(F.sum("copies").alias("n")).collect()}
    plan = _plan(owners, [known.get(k, 0) for k in range(len(owners))], shards, slack, bucket)
    arcs = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), _PLAN))))
    split = F.pmod(F.xxhash64(key, "size", "text_crc32"), F.col("buckets"))
    bucketed = found.join(arcs, "arc").select(key, "size", "text_crc32", "copies", "arc", "home", "intervals", split.alias("part"))

    sums = found.join(arcs.drop("intervals", "home"), "arc").groupBy("arc", split.alias("part")).agg(F.sum("copies").alias("n"))
    before = sums.select("arc", "part", (F.sum("n").over(Window.partitionBy("arc").orderBy("part")) - F.col("n")).alias("before"))
    if sum(p["buckets"] for p in plan) <= BROADCAST_BUCKETS:
        before = F.broadcast(before)
    inside = Window.partitionBy("arc", "part").orderBy(F.col(key), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bucketed.withColumn("inside", F.sum("copies").over(inside) - F.col("copies")).join(before, ["arc", "part"]).withColumn("rank", F.col("before") + F.col("inside"))

    stop = F.col("rank") + F.col("copies")
    cut = F.filter("intervals", lambda i: (i["begin"] < stop) & (i["end"] > F.col("rank")))
    spread = ranked.select(key, "size", "text_crc32", "home", "rank", stop.alias("stop"), F.explode(cut).alias("i"))
    spread = spread.select(key, "size", "text_crc32", "home", "i", F.greatest("rank", "i.begin").alias("first"), F.least("stop", "i.end").alias("stop"))
    many = spread.filter(F.col("stop") - F.col("first") > CHUNK).withColumn("first", F.explode(F.sequence("first", F.col("stop") - 1, F.lit(CHUNK).cast("long"))))
    many = many.withColumn("stop", F.least("stop", F.col("first") + CHUNK)).repartition(key, "first")
    every = spread.filter(F.col("stop") - F.col("first") <= CHUNK).union(many).withColumn("rank", F.explode(F.sequence("first", F.col("stop") - 1)))
    law = "rows" if not slack else "bounded"
    return every.select(key, "size", "text_crc32", F.lit(law).alias("law"), F.col("i.shard").alias("shard"), (F.col("i.slot") + F.col("rank") - F.col("i.begin")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home")
