"""Running sums, last values and previous rows along an order, also where one key holds much of the data.

A key's rows are ordered by one task, which spills but takes as long as the key is large. ``split`` cuts keys into parts:
it maps the first order column to a part that never decreases with it (a day, say), or is ``RANGES``, and then the rows
are dealt by ranges of key and order and written once with their range. Each part is scanned for itself, and what the
parts before it end with is carried in by a table of one row a part.

Defined cases: null keys are one key; nulls order first; null values add nothing to sums and are skipped by ``last``;
rows that tie in ``order`` come in any order, so it should name a unique column; columns of the caller keep their values
whatever their names, but for one that an output is named like, which is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.storage import materialise

RANGES = "ranges"
#: How a scan is cut into parts, if at all.
Split = Callable[[Column], Column] | str | None


def scan(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None, split: Split = None) -> DataFrame:
    """``df`` with ``sums`` and ``lasts`` (the last non-null value) over the key's rows up to each, and ``before``: a value of the row before it."""
    if split is None:  # keys and places stay what they are, so that scans in one order after another share one shuffle and sort
        w = Window.partitionBy(*by).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        told = {n: F.sum(c).over(upto) for n, c in (sums or {}).items()} | {n: F.last(c, ignorenulls=True).over(upto) for n, c in (lasts or {}).items()} | {n: F.lag(c).over(w) for n, c in (before or {}).items()}
        return df.select(*[c for c in df.columns if c not in told], *[c.alias(n) for n, c in told.items()])
    kinds = {"s": sums or {}, "l": lasts or {}, "b": before or {}}
    names = {f"{kind}{k}": name for kind, found in kinds.items() for k, name in enumerate(found)}
    values = [c.alias(f"{kind}{k}") for kind, found in kinds.items() for k, c in enumerate(found.values())]
    keys, places = [f"k{k}" for k in range(len(by))], [f"o{k}" for k in range(len(order))]
    rows = df.select(F.struct(*df.columns).alias("row"), *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], *[F.col(c).alias(k) for c, k in zip(order, places, strict=True)], *values)
    within = [*keys, "part"]
    if split == RANGES:
        rows = materialise(rows.repartitionByRange(*keys, *places).withColumn("part", F.spark_partition_id()), "ranges")
    else:
        rows = rows.withColumn("part", split(F.col("o0")))
    w = Window.partitionBy(*within).orderBy(*places)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = {n: F.sum(n).over(upto) if n[0] == "s" else F.last(n, ignorenulls=True).over(upto) if n[0] == "l" else F.lag(n).over(w) for n in names}
    out = rows.select("row", *within, *[c.alias(n) for n, c in local.items()], F.row_number().over(w).alias("turn"))
    place = F.struct(*places)
    ends = {n: F.sum(n) if n[0] == "s" else F.max_by(F.struct(n), F.when(F.col(n).isNotNull() | F.lit(n[0] == "b"), place)) for n in names}
    parts = rows.groupBy(*within).agg(*[c.alias(n) for n, c in ends.items()])
    along = Window.partitionBy(*keys).orderBy("part")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = {n: F.sum(n).over(past) if n[0] == "s" else F.last(F.when(F.col(n)[n].isNotNull(), F.col(n)), ignorenulls=True).over(past)[n] if n[0] == "l" else F.lag(n).over(along)[n] for n in names}
    carry = parts.select(*[F.col(c).alias(f"c_{c}") for c in within], *[c.alias(f"c_{n}") for n, c in carried.items()])
    same = F.lit(True)
    for c in within:
        same &= out[c].eqNullSafe(F.col(f"c_{c}"))
    out = out.join(carry, same, "left")
    joined = {"s": lambda n: F.when(F.col(n).isNotNull() | F.col(f"c_{n}").isNotNull(), F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"c_{n}"), F.lit(0))), "l": lambda n: F.coalesce(n, f"c_{n}"), "b": lambda n: F.when(F.col("turn") == 1, F.col(f"c_{n}")).otherwise(F.col(n))}
    out = out.withColumns({n: joined[n[0]](n) for n in names})
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in names.values()]
    return out.select(*kept, *[F.col(n).alias(name) for n, name in names.items()])
