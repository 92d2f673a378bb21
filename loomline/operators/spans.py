"""Virtual documents made of spans: positions in the whole to bytes of the sources.

A virtual document is a list of spans (doc, no, source, start, length), bytes counted from 0. Its spans follow each other,
so a span's place is the running sum of the lengths before it; what a range of the whole covers is found by two as-of
joins, for its first and last byte, and an equi-join over the span numbers between.

Defined cases: a span whose length is null, zero or negative takes no place and is left out; spans of one number are
ordered by source, start and length; a range that is null, empty or begins outside gets one row with a problem; one that ends
beyond the whole is cut there and its rows are marked; the same range asked for twice is answered twice; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.asof import asof
from loomline.operators.scans import Split, scan


def placed(spans: DataFrame, split: Split = None) -> DataFrame:
    """Spans (doc, no, source, start, length) with ``at`` and ``until``, their place in the whole, and ``place``, their number from 1."""
    rows = spans.select("doc", "no", "source", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length")).filter("length > 0")
    rows = scan(rows, ["doc"], ["no", "source", "start", "length"], sums={"until": F.col("length"), "place": F.lit(1)}, split=split)
    return rows.withColumn("at", F.col("until") - F.col("length"))


def resolve(ranges: DataFrame, whole: DataFrame) -> DataFrame:
    """(id, doc, piece, source, start, length, problem) of ranges (id, doc, start, length) on ``placed`` spans, piece by piece from 1.

    ``problem`` is null, ``no such place`` (the only row of its range) or ``cut at the end``.
    """
    asked = ranges.select("id", "doc", F.col("start").cast("long").alias("s"), (F.col("start") + F.col("length")).cast("long").alias("e"))
    fits = asked.filter("s >= 0 AND e > s")
    spots = whole.select("doc", "at", F.col("place").alias("tie"), "until")
    first = asof(fits.select("id", "doc", "s", "e", F.col("s").alias("at"), F.lit(0).cast("long").alias("tie")), spots, ["doc"], "at", {"tie": "first", "until": "stop"}, "tie")
    first = first.select("id", "doc", "s", "e", "first", "stop").filter("s < stop")
    last = asof(first.select("id", "doc", "s", "e", "first", (F.col("e") - 1).alias("at"), F.lit(0).cast("long").alias("tie")), spots, ["doc"], "at", {"tie": "last", "until": "stop"}, "tie")
    pieces = last.select("id", "doc", "s", "e", "first", "stop", F.explode(F.sequence("first", "last")).alias("place"))
    held = whole.select("doc", "place", "source", "start", "at", "until")
    same = pieces["doc"].eqNullSafe(held["doc"]) & (pieces["place"] == held["place"])
    begin, end = F.greatest("s", "at"), F.least("e", "until")
    found = pieces.join(held, same).select("id", pieces["doc"], (pieces["place"] - F.col("first") + 1).alias("piece"), "source", (F.col("start") + begin - F.col("at")).alias("start"), (end - begin).alias("length"), F.when(F.col("e") > F.col("stop"), "cut at the end").alias("problem"))
    known = first.select("id", "doc", F.col("s").alias("_s"), F.col("e").alias("_e"), F.lit(True).alias("_found")).distinct()
    lost = asked.join(known, asked["id"].eqNullSafe(known["id"]) & asked["doc"].eqNullSafe(known["doc"]) & asked["s"].eqNullSafe(known["_s"]) & asked["e"].eqNullSafe(known["_e"]), "left_anti")
    none = F.lit(None).cast("long")
    return found.union(lost.select("id", "doc", none, F.lit(None).cast(dict(whole.dtypes)["source"]), none, none, F.lit("no such place")))
