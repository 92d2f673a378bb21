"""Vector clocks, multi-value registers and log digests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.storage import materialise


def tick(clock: Column, peer: str) -> Column:
    return F.map_concat(F.map_filter(clock, lambda k, _: k != peer), F.create_map(F.lit(peer), F.coalesce(clock[peer], F.lit(0)) + 1))


def merge(a: Column, b: Column) -> Column:
    """The greater count of every peer."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def happens_before(a: Column, b: Column) -> Column:
    """No count of ``a`` is over that of ``b``, and one is under it."""
    counts = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, F.lit(0)) - F.coalesce(x, F.lit(0))))
    return F.forall(counts, lambda d: d >= 0) & F.exists(counts, lambda d: d > 0)


def concurrent(a: Column, b: Column) -> Column:
    """Neither before the other; equal clocks count as concurrent."""
    return ~happens_before(a, b) & ~happens_before(b, a)


#: Different clocks of a key that one task takes the front of at a time.
FRONT = 20_000


def survivors(values: DataFrame, by: Sequence[str], clock: Sequence[str]) -> DataFrame:
    """Rows of each key whose clock (integer columns) no other row of the key dominates.

    With two counters, one sort of each key's distinct clocks tells: a row survives if its second counter is over all
    those of greater first ones. With more, a key's clocks are dealt into parts of about FRONT, each part leaves its own
    front, and fronts are merged two and two until one is left; no key meets itself. What is merged in one task is what
    survives of two parts.

    Defined cases: null keys are one key; a null counter counts as less than any number; rows of equal clocks survive
    together; an empty table gives no rows.
    """
    keys, counts = [f"k{k}" for k in range(len(by))], [f"c{k}" for k in range(len(clock))]
    least = F.lit(-(1 << 63))
    named = values.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], *[F.coalesce(F.col(c).cast("long"), least).alias(k) for c, k in zip(clock, counts, strict=True)])
    front = named.groupBy(*keys, *counts[:-1]).agg(F.max(counts[-1]).alias(counts[-1]))
    if len(clock) == 1:
        alive = front
    elif len(clock) == 2:
        over = F.max("c1").over(Window.partitionBy(*keys).orderBy(F.desc("c0")).rowsBetween(Window.unboundedPreceding, -1))
        alive = front.withColumn("over", over).filter(F.col("over").isNull() | (F.col("c1") > F.col("over"))).drop("over")
    else:
        alive = _merged_fronts(materialise(front, "clocks"), keys, counts)
    same = F.lit(True)
    alive = alive.select(*[F.col(c).alias(f"_{c}") for c in (*keys, *counts)])
    for c, k in (*zip(by, keys, strict=True), *zip(clock, counts, strict=True)):
        mine = values[c] if k in keys else F.coalesce(values[c].cast("long"), least)
        same &= mine.eqNullSafe(F.col(f"_{k}"))
    return values.join(alive, same, "left_semi")


def _merged_fronts(front: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """The clocks (distinct rows of keys and counts) that no other clock of their key dominates."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        # a clock is only dominated by one that comes before it in this order
        part = part.sort_values(counts, ascending=False, kind="stable")
        points, kept = part[counts].to_numpy(), np.zeros((0, len(counts)), np.int64)
        alive = np.zeros(len(part), bool)
        for at, point in enumerate(points):
            if not (kept >= point).all(axis=1).any():
                alive[at] = True
                kept = np.append(kept, point[None], axis=0)
        return part[alive]

    sizes = materialise(front.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / FRONT)).cast("int")
    same = F.lit(True)
    for k in keys:
        same &= front[k].eqNullSafe(sizes[k])
    rows = front.join(sizes, same).select(*[front[c] for c in (*keys, *counts)], F.pmod(F.xxhash64(*[front[c] for c in counts]), parts).cast("int").alias("part"))
    schema = rows.schema
    left = max(1, -(-most // FRONT))
    while True:
        rows = materialise(rows.groupBy(*keys, "part").applyInPandas(run, schema), "fronts")
        if left == 1:
            return rows.select(*keys, *counts)
        left = -(-left // 2)
        rows = rows.withColumn("part", F.floor(F.col("part") / 2).cast("int"))


def log_digest(log: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """(by, n, digest): SHA-256 of the sorted ids, joined by commas."""
    return log.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.cast("string")), ","), 256).alias("digest"))


def missing(mine: DataFrame, theirs: DataFrame, item: str) -> DataFrame:
    """(item, where): ids that one of two logs lacks."""
    a, b = mine.select(item).distinct(), theirs.select(item).distinct()
    return a.join(b, item, "left_anti").withColumn("missing_in", F.lit("theirs")).union(b.join(a, item, "left_anti").withColumn("missing_in", F.lit("mine")))


#: Bits that a level of a digest tree adds to the ranges of the one above.
FAN = 4


def digest_tree(log: DataFrame, item: str, levels: int = 4) -> DataFrame:
    """(level, range, n, digest): counts and digests of a log's ids by ranges of their hash, 16 times as many on each level.

    A digest is the sum and the exclusive or of the ids' hashes, so it is additive: no id is gathered. Repeated ids count once.
    """
    ids = log.select(F.col(item).cast("string").alias("id")).filter("id IS NOT NULL").distinct()
    ids = ids.select(F.xxhash64("id").alias("h"), F.xxhash64(F.lit("second"), "id").alias("g"))
    leaf = FAN * levels
    leaves = materialise(ids.groupBy(F.shiftrightunsigned("h", 64 - leaf).alias("leaf")).agg(F.count("*").alias("n"), F.sum(F.col("g").cast("decimal(38,0)")).alias("s"), F.bit_xor("g").alias("x")), "leaves")
    each = F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("leaf"), (levels - k) * FAN).alias("range")))
    rows = leaves.select(F.explode(each).alias("at"), "n", "s", "x").groupBy("at.level", "at.range")
    return rows.agg(F.sum("n").alias("n"), F.sha2(F.concat_ws(":", F.sum("s"), F.bit_xor("x")), 256).alias("digest"))


def differing_ranges(mine: DataFrame, theirs: DataFrame, levels: int = 4) -> DataFrame:
    """(range): the ranges of the last level in which two digest trees differ. Only what lies below a differing range is compared."""
    open_ = None
    for level in range(1, levels + 1):
        sides = []
        for tree in (mine, theirs):
            rows = tree.filter(F.col("level") == level).select("range", "n", "digest")
            if open_ is not None:
                rows = rows.withColumn("above", F.shiftright("range", FAN)).join(open_.toDF("above"), "above", "left_semi").drop("above")
            sides.append(rows)
        a, b = sides[0].toDF("range", "n", "digest"), sides[1].toDF("range", "n2", "digest2")
        both = a.join(b, "range", "full_outer")
        open_ = materialise(both.filter(~F.col("digest").eqNullSafe(F.col("digest2"))).select("range"), "differing")
        if not open_.head(1):
            break
    return open_


def missing_by_ranges(mine: DataFrame, theirs: DataFrame, item: str, levels: int = 4) -> tuple[DataFrame, DataFrame]:
    """(item, missing_in) like ``missing``, and the ids (item, side) that had to be exchanged for it: those of differing ranges only."""
    ranges = differing_ranges(digest_tree(mine, item, levels), digest_tree(theirs, item, levels), levels)
    place = F.shiftrightunsigned(F.xxhash64(F.col(item).cast("string")), 64 - FAN * levels).alias("range")
    sent = [df.select(item, place).join(ranges, "range", "left_semi").select(item).distinct() for df in (mine, theirs)]
    told = materialise(sent[0].withColumn("side", F.lit("mine")).union(sent[1].withColumn("side", F.lit("theirs"))), "exchanged")
    found = missing(told.filter("side = 'mine'"), told.filter("side = 'theirs'"), item)
    return found, told


def resolve_concurrent(ops: DataFrame, by: Sequence[str], kind: str, peer: str, text: str = "set-text") -> DataFrame:
    """(by, winner, n): of concurrent ops that all set a text, the lowest peer's wins; any other kind makes a conflict, without winner."""
    only = F.bool_and(F.col(kind) == text)
    return ops.groupBy(*by).agg(F.when(only, F.min(peer)).alias("winner"), F.count("*").alias("n"))
