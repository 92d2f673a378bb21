"""Note streams: ticks, tempo, pairing, chords, merging and stateless transforms (designs only, where the operators come from).

Defined cases: null keys are one key; a null delta adds nothing; of rows that tie in ``order`` any may come first, so it should
end with a unique column; repeated notes sound, and pair, each for itself; a note that ends where it begins, or before,
sounds nowhere; a closing row without an open one is dropped, an open one without closing stays with null; a track
without end has none after merging; transforms leave values they don't name as they are, nulls included; empty tables give no
rows. Columns whose names begin with an underscore are the operators' own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.asof import asof
from loomline.operators.scans import Split, scan


def ticks(events: DataFrame, by: Sequence[str], order: Sequence[str], delta: str, name: str = "tick", split: Split = None) -> DataFrame:
    """Running sums of delta ticks by track; ``split`` cuts tracks that hold much of the data."""
    return scan(events, by, order, sums={name: F.col(delta)}, split=split)


def tempo_map(changes: DataFrame, by: Sequence[str], tick: str, rate: str) -> DataFrame:
    """Changes with ``base``: the time gone by at their tick, the rates so far times how long they held."""
    w = Window.partitionBy(*by).orderBy(tick)
    held = changes.withColumn("_held", F.lead(tick).over(w) - F.col(tick))
    return held.withColumn("base", F.coalesce(F.sum(F.col(rate) * F.col("_held")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_held")


def at_times(notes: DataFrame, mapped: DataFrame, by: Sequence[str], tick: str, rate: str, tie: str, name: str = "at") -> DataFrame:
    """Notes with their time on a tempo map, from the last change at or before their tick; null before the first."""
    marks = mapped.select(*by, F.col(tick), F.col(tie), F.col(rate).alias("_rate"), "base", F.col(tick).alias("_from"))
    found = asof(notes, marks, list(by), tick, {"_rate": "_rate", "base": "_base", "_from": "_from"}, tie)
    return found.withColumn(name, F.col("_base") + (F.col(tick) - F.col("_from")) * F.col("_rate")).drop("_rate", "_base", "_from")


def pair_stacked(df: DataFrame, by: Sequence[str], order: Sequence[str], opens: Column, key: str, open_name: str, close_name: str) -> DataFrame:
    """Pairs closing rows with the last open one of their key, as a stack; unclosed ones stay with null, stray closings are dropped.

    The depth after each row, less the lowest depth so far (never over 0), counts what is open. An opening row and the
    closing one that takes it off meet at the same level, next to each other among the rows of that level.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_open", opens).withColumn("_sum", F.sum(F.when(F.col("_open"), 1).otherwise(-1)).over(running))
    rows = rows.withColumn("_open_now", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(running)))
    rows = rows.withColumn("_before", F.coalesce(F.lag("_open_now").over(w), F.lit(0)))
    rows = rows.filter("_open OR _before > 0").withColumn("_level", F.when(F.col("_open"), F.col("_open_now")).otherwise(F.col("_before")))
    level = Window.partitionBy(*by, "_level").orderBy(*order)
    rows = rows.withColumns({"_next": F.lead(key).over(level), "_next_open": F.lead("_open").over(level)})
    closed = F.when(~F.col("_next_open"), F.col("_next"))
    return rows.filter("_open").select(*by, F.col(key).alias(open_name), closed.alias(close_name))


def chords(notes: DataFrame, by: Sequence[str], start: str, end: str, pitch: str) -> DataFrame:
    """(by, at, pitches): the pitches that sound from every boundary on, sorted, without repeats; a note sounds on [start, end).

    Running counts of how often each pitch is on (a note may repeat) give the intervals in which it sounds at all; these
    are told to the boundaries by exploding only the boundaries inside, so the result's own size bounds the work.
    """
    keys = list(by)
    marks = notes.filter(F.col(start) < F.col(end)).select(*keys, F.col(pitch).alias("pitch"), F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("m"))
    changes = marks.groupBy(*keys, "pitch", F.col("m.at").alias("at")).agg(F.sum("m.d").alias("d"))
    w = Window.partitionBy(*keys, "pitch").orderBy("at")
    on = changes.withColumn("_on", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0).withColumn("_until", F.lead("at").over(w))
    places = marks.select(*keys, F.col("m.at").alias("at")).distinct()
    places = places.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("at")))
    spans = on.filter("_on").join(places, [*keys, "at"]).join(places.select(*keys, F.col("at").alias("_until"), F.col("_n").alias("_m")), [*keys, "_until"])
    held = spans.select(*keys, "pitch", F.explode(F.sequence("_n", F.col("_m") - 1)).alias("_n"))
    sounding = held.groupBy(*keys, "_n").agg(F.sort_array(F.collect_set("pitch")).alias("pitches"))
    return places.join(sounding, [*keys, "_n"], "left").select(*keys, "at", F.coalesce("pitches", F.array().cast(sounding.schema["pitches"].dataType)).alias("pitches"))


def merge_tracks(events: DataFrame, by: Sequence[str], tick: str, track: str, seq: str, kind: str, end: str = "end") -> DataFrame:
    """All tracks of a file as one: in the order of ticks, tracks and places, with new deltas and one end, last."""
    last = Window.partitionBy(*by).orderBy(F.desc(tick), F.desc(track), F.desc(seq))
    ends = events.filter(F.col(kind) == end).withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn").withColumn("_last", F.lit(1))
    rows = events.filter(F.col(kind) != end).withColumn("_last", F.lit(0)).unionByName(ends)
    top = F.max(tick).over(Window.partitionBy(*by))
    rows = rows.withColumn(tick, F.when(F.col("_last") == 1, top).otherwise(F.col(tick)))
    w = Window.partitionBy(*by).orderBy("_last", tick, track, seq)
    return rows.withColumns({"place": F.row_number().over(w), "delta": F.col(tick) - F.coalesce(F.lag(tick).over(w), F.lit(0))}).drop("_last")


def ranges(notes: DataFrame, by: Sequence[str], pitch: str) -> DataFrame:
    """(by, lowest, highest, n_notes) for every channel that has a note."""
    return notes.groupBy(*by).agg(F.min(pitch).alias("lowest"), F.max(pitch).alias("highest"), F.count("*").alias("n_notes"))


def meta_summary(events: DataFrame, by: Sequence[str], kind: str, text: str, order: Sequence[str]) -> DataFrame:
    """By file: the texts of track names, markers and lyrics in order, and the first tempo, time signature and key."""

    def told(name: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col(kind) == name, F.struct(*order, F.col(text).alias("_text")))))
        return F.transform(rows, lambda r: r["_text"])

    def first(name: str) -> Column:
        return F.min_by(F.when(F.col(kind) == name, F.col(text)), F.when(F.col(kind) == name, F.struct(*order)))

    lists = {"track_names": "track-name", "markers": "marker", "lyrics": "lyric"}
    firsts = {"initial_tempo": "tempo", "initial_time": "time-signature", "initial_key": "key-signature"}
    return events.groupBy(*by).agg(*[told(k).alias(n) for n, k in lists.items()], *[first(k).alias(n) for n, k in firsts.items()])


# Stateless transforms of rows (kind: note or control or pressure, channel, number, value); they work on streams as well


def transpose(rows: DataFrame, by: int, channel: int | None = None) -> DataFrame:
    """Notes of a channel (or all) by so many semitones, within 0 to 127."""
    mine = (F.col("kind") == "note") & (F.lit(channel is None) | (F.col("channel") == F.lit(channel)))
    return rows.withColumn("number", F.when(mine, F.greatest(F.lit(0), F.least(F.lit(127), F.col("number") + by))).otherwise(F.col("number")))


def scale_velocity(rows: DataFrame, factor: float) -> DataFrame:
    """Velocities times a factor, cut to whole numbers from 1 to 127."""
    scaled = F.greatest(F.lit(1), F.least(F.lit(127), F.floor(F.col("value") * factor))).cast("int")
    return rows.withColumn("value", F.when(F.col("kind") == "note", scaled).otherwise(F.col("value").cast("int")))


def keep_notes(rows: DataFrame, lowest: int = 0, highest: int = 127, velocity: int = 0) -> DataFrame:
    """Without notes outside the range or under the velocity; whatever isn't a note stays."""
    return rows.filter((F.col("kind") != "note") | (F.col("number").between(lowest, highest) & (F.col("value") >= velocity)))


def map_controls(rows: DataFrame, mapping: dict[int, int], scale: float = 1.0) -> DataFrame:
    """Controls renumbered, and those scaled, within 0 to 127."""
    mine, number = (F.col("kind") == "control") & F.col("number").isin(*mapping), F.col("number")
    for old, new in mapping.items():
        number = F.when(F.col("number") == old, F.lit(new)).otherwise(number)
    value = F.greatest(F.lit(0), F.least(F.lit(127), F.floor(F.col("value") * scale))).cast("int")
    return rows.select(*[c for c in rows.columns if c not in ("number", "value")], F.when(mine, number).otherwise(F.col("number")).alias("number"), F.when(mine, value).otherwise(F.col("value").cast("int")).alias("value"))


def pressure_to_control(rows: DataFrame, control: int, scale: float = 1.0) -> DataFrame:
    mine = F.col("kind") == "pressure"
    value = F.greatest(F.lit(0), F.least(F.lit(127), F.floor(F.col("value") * scale))).cast("int")
    return rows.select(*[c for c in rows.columns if c not in ("kind", "number", "value")], F.when(mine, "control").otherwise(F.col("kind")).alias("kind"), F.when(mine, F.lit(control)).otherwise(F.col("number")).alias("number"), F.when(mine, value).otherwise(F.col("value").cast("int")).alias("value"))


def channels(rows: DataFrame, keep: Sequence[int] | None = None, remap: dict[int, int] | None = None) -> DataFrame:
    """Only some channels, then renumbered."""
    out = rows if keep is None else rows.filter(F.col("channel").isin(*keep))
    channel = F.col("channel")
    for old, new in (remap or {}).items():
        channel = F.when(F.col("channel") == old, F.lit(new)).otherwise(channel)
    return out.withColumn("channel", channel)
