"""Runs, turns, folds and sessions: gaps-and-islands over an ordered key.

All of them are scans (``scans.scan``); ``split`` cuts keys that hold much of the data into parts, with the same result.

Defined cases: null keys are one key; nulls order first; rows that tie in ``order`` come in any order, so it should end
with a unique column; repeated rows count each for itself; a column named like an output is replaced, all others keep
their values; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.scans import Split, scan


def micros(ts: Column) -> Column:
    """Microseconds of an instant, with or without time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def _counted(df: DataFrame, by: Sequence[str], order: Sequence[str], before: Column, begins, name: str, split: Split) -> DataFrame:
    """``df`` with ``name``: how many rows up to each ``begins`` holds for, a condition on the row (named ``row``) and ``before`` of the row before it."""
    rows = df.select(F.struct(*df.columns).alias("row"), *[F.col(c).alias(f"key{k}") for k, c in enumerate([*by, *order])], before.alias("value"))
    keys, places = [f"key{k}" for k in range(len(by))], [f"key{k}" for k in range(len(by), len(by) + len(order))]
    rows = scan(rows, keys, places, before={"before": F.col("value")}, split=split)
    rows = scan(rows, keys, places, sums={"n": F.when(begins, 1).otherwise(0)}, split=split)
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns if c != name], F.col("n").cast("long").alias(name))


def number_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "run_no", split: Split = None) -> DataFrame:
    """Numbers maximal runs of equal ``value`` from 1; nulls make runs of their own, one each."""
    same = F.col("before").isNotNull() & F.col("before").eqNullSafe(F.col("value"))
    return _counted(df, by, order, F.col(value), ~same, name, split)


def number_after(df: DataFrame, by: Sequence[str], order: Sequence[str], marker: Column, name: str, keep_markers: bool, split: Split = None) -> DataFrame:
    """Numbers the stretches that begin at a marker; rows before the first have 0."""
    out = scan(df, by, order, sums={name: F.when(marker, 1).otherwise(0)}, split=split).withColumn(name, F.col(name).cast("long"))
    return out if keep_markers else out.filter(~F.coalesce(marker, F.lit(False)))


def fold_lines(df: DataFrame, by: Sequence[str], order: str, header: Column, text: str, joiner: str = "\n", split: Split = None) -> DataFrame:
    """Header lines with their continuation lines joined; lines before the first header are dropped. A fold is one value."""
    rows = number_after(df, by, [order], header, "fold", keep_markers=True, split=split).filter("fold > 0")
    parts = F.sort_array(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return rows.groupBy(*by, "fold").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(parts, lambda p: p["t"]), joiner).alias("body"))


def number_sessions(df: DataFrame, by: Sequence[str], ts: str, tie: str, gap_seconds: int, name: str = "session_no", split: Split = None) -> DataFrame:
    """A new session begins after a gap of more than ``gap_seconds``."""
    gap = F.col("value") - F.col("before")
    return _counted(df, by, [ts, tie], micros(F.col(ts)), F.col("before").isNull() | (gap > gap_seconds * 1_000_000), name, split)


def number_heads(df: DataFrame, by: Sequence[str], order: str | Sequence[str], level: str, levels: int, starred: Column | None = None, appendix: Column | None = None, split: Split = None) -> DataFrame:
    """``number`` of nested heads (1, 1.1, 1.2, 2, …): each level counts within its ancestors and begins anew under the next.

    ``starred`` heads have no number and count for none. From the first row that ``appendix`` marks on, outermost heads
    count anew, as letters (after Z as A27 and so on). A level that is null or not below ``levels`` counts for none.
    All levels are counted over the whole key in one order; what had been counted at the last outer head is taken off.
    """
    counted = F.lit(True) if starred is None else ~F.coalesce(starred, F.lit(False))
    late = F.lit(False) if appendix is None else F.coalesce(appendix, F.lit(False))
    order = [order] if isinstance(order, str) else order
    keys, places = [f"key{k}" for k in range(len(by))], [f"place{k}" for k in range(len(order))]
    rows = df.select(F.struct(*df.columns).alias("row"), *[F.col(c).alias(k) for c, k in zip([*by, *order], [*keys, *places], strict=True)], F.col(level).alias("level"), counted.alias("counted"), late.cast("int").alias("marked"))
    within = keys
    if appendix is not None:
        rows = scan(rows, keys, places, sums={"late": F.col("marked")}, split=split).withColumn("late", F.col("late") > 0)
        within = [*keys, "late"]
    rows = scan(rows, within, places, sums={f"n{k}": F.when((F.col("level") == k) & F.col("counted"), 1).otherwise(0) for k in range(levels)}, split=split)
    if levels > 1:
        rows = scan(rows, within, places, lasts={f"past{k}": F.when((F.col("level") < k) & (F.col("level") >= 0) & F.col("counted"), F.col(f"n{k}")) for k in range(1, levels)}, split=split)
        rows = rows.withColumns({f"n{k}": F.col(f"n{k}") - F.coalesce(f"past{k}", F.lit(0)) for k in range(1, levels)})
    names = [F.col(f"n{k}").cast("string") for k in range(levels)]
    if appendix is not None:
        letter = F.when(F.col("n0") <= 26, F.char(64 + F.col("n0"))).otherwise(F.concat(F.lit("A"), names[0]))
        names[0] = F.when(F.col("late"), letter).otherwise(names[0])
    number = F.concat_ws(".", *[F.when(F.col("level") >= k, names[k]) for k in range(levels)])
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns if c != "number"], F.when(F.col("counted"), number).alias("number"))


def pair_in_order(df: DataFrame, by: Sequence[str], order: Sequence[str], opens: Column, key: str, open_name: str, close_name: str) -> DataFrame:
    """Pairs the k-th opening row of a key with its k-th closing one (first in, first out); unclosed ones stay with null."""
    rows = df.withColumn("_open", opens).withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_open").orderBy(*order)))
    a = rows.filter("_open").select(*by, "_k", F.col(key).alias(open_name))
    b = rows.filter("NOT _open").select(*by, "_k", F.col(key).alias(close_name))
    return a.join(b, [*by, "_k"], "left").drop("_k")
