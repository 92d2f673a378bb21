"""As-of joins by one union, one shuffle on the key and one sort: never an inequality join."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, take: dict[str, str], tie: str, forward: bool = False, clamp: bool = False, split: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with columns of the last right row at or before it (``forward``: the first at or after it).

    ``take`` maps right columns to their names in the result; ``tie`` (a column of both) orders rows of equal ``on``.
    Right rows count as equal-or-earlier at the same ``on``, whatever their tie. With ``clamp``, a left row before the
    first right row gets that first one (forward: after the last, the last). Left rows without any match get nulls.

    A key's rows are sorted by one task, which spills but takes as long as the key is large. For keys that hold much of
    the data, ``split`` cuts them: it maps ``on`` to a part that never decreases with it (a day, say). Every part is
    sorted for itself, and what the nearest part before it ends with is carried in by a table of one row a part.
    """
    extra = [c for c in left.columns if c not in (*by, on)]
    held = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    kind = right.select(held.alias("s")).schema["s"].dataType
    marked_left = left.select(*by, on, F.lit(1).alias("_side"), F.col(tie).alias("_tie"), F.struct(*[F.col(c) for c in extra]).alias("_left"), F.lit(None).cast(kind).alias("_right"))
    marked_right = right.select(*by, on, F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(marked_left.schema["_left"].dataType).alias("_left"), held.alias("_right"))
    both = marked_left.unionByName(marked_right)
    within = [*by]
    if split is not None:
        both, within = both.withColumn("_part", split(F.col(on))), [*by, "_part"]
    turned = F.desc if forward else F.asc
    order = [turned(on), F.asc("_side"), turned("_tie")]
    w = Window.partitionBy(*within).orderBy(*order)
    found = F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if clamp and split is None:
        found = F.coalesce(found, F.first("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = both.withColumn("_found", found)
    if split is not None:
        place = F.struct(on, "_tie")
        parts = both.select(*within, "_right", F.when(F.col("_right").isNotNull(), place).alias("_place")).groupBy(*within)
        edge = F.min_by("_right", "_place") if forward else F.max_by("_right", "_place")
        carried = F.last("_edge", ignorenulls=True).over(Window.partitionBy(*by).orderBy(turned("_part")).rowsBetween(Window.unboundedPreceding, -1))
        carry = parts.agg(edge.alias("_edge")).select(*within, carried.alias("_carried"))
        same = [out[c].eqNullSafe(carry[c]) for c in within]
        out = out.join(carry, same, "left").select(*[out[c] for c in out.columns if c != "_found"], F.coalesce(out["_found"], carry["_carried"]).alias("_found"))
    if clamp and split is not None:
        ends = marked_right.groupBy(*by).agg((F.max_by("_right", place) if forward else F.min_by("_right", place)).alias("_end"))
        same = [out[c].eqNullSafe(ends[c]) for c in by]
        out = out.join(ends, same, "left").select(*[out[c] for c in out.columns if c != "_found"], F.coalesce(out["_found"], ends["_end"]).alias("_found"))
    out = out.filter("_side = 1")
    return out.select(*by, on, *[F.col("_left")[c].alias(c) for c in extra], *[F.col("_found")[n].alias(n) for n in take.values()])
