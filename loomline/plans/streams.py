"""Queries on note streams and the reading analytics beside sessions, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import notes, usage
from loomline.plans.registry import events, query, table


@query("""WITH RECURSIVE n AS (SELECT event_id, user_id, floor(value)::BIGINT % 12 AS pitch, event_type = 'click' AS is_on, row_number() OVER (PARTITION BY user_id, floor(value)::BIGINT % 12 ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('click', 'view')),
s(user_id, pitch, k, stack, on_id, off_id) AS (SELECT user_id, pitch, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT user_id, pitch FROM n)
  UNION ALL SELECT s.user_id, s.pitch, n.k, CASE WHEN is_on THEN list_append(stack, event_id) WHEN len(stack) > 0 THEN stack[1:len(stack) - 1] ELSE stack END, CASE WHEN NOT is_on AND len(stack) > 0 THEN list_last(stack) END, CASE WHEN NOT is_on AND len(stack) > 0 THEN event_id END
  FROM s JOIN n ON n.user_id = s.user_id AND n.pitch = s.pitch AND n.k = s.k + 1)
SELECT n.event_id AS on_id, s.off_id, n.user_id, n.pitch FROM n LEFT JOIN s ON s.on_id = n.event_id WHERE is_on""")
def note_pairs_stack(spark, sf_dir):
    rows = events(spark, sf_dir, "click", "view").select("event_id", "user_id", "ts", (F.floor("value").cast("long") % 12).alias("pitch"), (F.col("event_type") == "click").alias("is_on"))
    return notes.pair_stacked(rows, ["user_id", "pitch"], ["ts", "event_id"], F.col("is_on"), "event_id", "on_id", "off_id").select("on_id", "off_id", "user_id", "pitch")


@query("""WITH n AS (SELECT user_id, event_id AS a, event_id + floor(value)::BIGINT % 500 AS b, event_id % 12 AS pitch FROM events), m AS (SELECT * FROM n WHERE a < b),
p AS (SELECT user_id, a AS at FROM m UNION SELECT user_id, b FROM m)
SELECT p.user_id, p.at, coalesce(string_agg(DISTINCT pitch::VARCHAR, ',' ORDER BY pitch::VARCHAR), '') AS pitches FROM p LEFT JOIN m ON m.user_id = p.user_id AND m.a <= p.at AND p.at < m.b GROUP BY 1, 2""")
def chord_snapshots(spark, sf_dir):
    """Every event sounds for as long as its value says."""
    rows = events(spark, sf_dir).select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + F.floor("value").cast("long") % 500).alias("b"), (F.col("event_id") % 12).cast("string").alias("pitch"))
    return notes.chords(rows, ["user_id"], "a", "b", "pitch").select("user_id", "at", F.array_join("pitches", ",").alias("pitches"))


@query("""WITH e AS (SELECT user_id // 10 AS file, user_id AS track, event_id, event_id % 1000 AS tick, CASE WHEN event_type = 'error' THEN 'end' ELSE 'note' END AS kind FROM events),
l AS (SELECT * FROM e WHERE kind = 'end' QUALIFY row_number() OVER (PARTITION BY file ORDER BY tick DESC, track DESC, event_id DESC) = 1),
m AS (SELECT *, 0 AS z FROM e WHERE kind <> 'end' UNION ALL SELECT file, track, event_id, greatest(tick, (SELECT max(tick) FROM e WHERE e.file = l.file AND (kind <> 'end' OR e.event_id = l.event_id))), kind, 1 FROM l)
SELECT file, event_id, row_number() OVER w AS place, tick - coalesce(lag(tick) OVER w, 0) AS delta FROM m WINDOW w AS (PARTITION BY file ORDER BY z, tick, track, event_id)""")
def merged_tracks(spark, sf_dir):
    """Files of ten tracks, one a user; every error ends its track."""
    kind = F.when(F.col("event_type") == "error", "end").otherwise("note")
    rows = events(spark, sf_dir).select(F.floor(F.col("user_id") / 10).alias("file"), F.col("user_id").alias("track"), "event_id", (F.col("event_id") % 1000).alias("tick"), kind.alias("kind"))
    return notes.merge_tracks(rows, ["file"], "tick", "track", "event_id", "kind").select("file", "event_id", F.col("place").cast("long").alias("place"), "delta")


@query("""WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'note' WHEN 'view' THEN 'note' WHEN 'purchase' THEN 'control' ELSE 'pressure' END AS kind, user_id % 16 AS channel, event_id % 128 AS number, (floor(value)::BIGINT % 128)::INTEGER AS value FROM events),
t AS (SELECT event_id, channel, kind, CASE WHEN kind = 'note' AND channel = 3 THEN greatest(0, least(127, number + 7)) ELSE number END AS number, CASE WHEN kind = 'note' THEN greatest(1, least(127, floor(value * 1.5)::INTEGER)) ELSE value END AS value FROM r),
f AS (SELECT * FROM t WHERE kind <> 'note' OR number BETWEEN 20 AND 110 AND value >= 5),
c AS (SELECT event_id, channel, kind, CASE WHEN kind = 'control' AND number = 2 THEN 7 ELSE number END AS number, CASE WHEN kind = 'control' AND number = 2 THEN least(127, value * 2) ELSE value END AS value FROM f)
SELECT event_id, CASE WHEN channel = 9 THEN 10 ELSE channel END AS channel, CASE WHEN kind = 'pressure' THEN 'control' ELSE kind END AS kind, CASE WHEN kind = 'pressure' THEN 11 ELSE number END AS number, CASE WHEN kind = 'pressure' THEN value // 2 ELSE value END AS value FROM c WHERE channel <> 15""")
def note_transforms(spark, sf_dir):
    """Transposed, scaled, filtered, mapped, pressure as a control, and renumbered."""
    kind = F.when(F.col("event_type").isin("click", "view"), "note").when(F.col("event_type") == "purchase", "control").otherwise("pressure")
    rows = events(spark, sf_dir).select("event_id", kind.alias("kind"), (F.col("user_id") % 16).alias("channel"), (F.col("event_id") % 128).alias("number"), (F.floor("value").cast("long") % 128).cast("int").alias("value"))
    rows = notes.keep_notes(notes.scale_velocity(notes.transpose(rows, 7, channel=3), 1.5), 20, 110, 5)
    rows = notes.pressure_to_control(notes.map_controls(rows, {2: 7}, 2.0), 11, 0.5)
    return notes.channels(rows, keep=range(15), remap={9: 10}).select("event_id", "channel", "kind", "number", "value")


@query("""SELECT hour(ts)::INTEGER AS hour, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_persons FROM events WHERE user_id % 3 = 0 GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 4""")
def purpose_groups(spark, sf_dir):
    """Every third user permits research, others say no or nothing."""
    said = F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("research"), F.lit(True))).when(F.col("user_id") % 3 == 1, F.create_map(F.lit("research"), F.lit(False)))
    rows = events(spark, sf_dir).withColumns({"hour": F.hour("ts"), "purposes": said})
    return usage.for_purpose(rows, "research", ("research", "billing"), ["hour", "event_type"], "user_id", 4)


@query("""SELECT doc_id AS node, CASE WHEN doc_id % 5 < 3 THEN 'fetch' ELSE 'notify' END AS action FROM documents WHERE doc_id % 4 = 0""")
def stale_content(spark, sf_dir):
    """Every fourth document was changed since."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "text")
    access = F.element_at(F.array(*[F.lit(x) for x in (*usage.UPDATED, "session", "read-once")]), (F.col("node") % 5 + 1).cast("int"))
    vault = docs.select("node", F.sha2("text", 256).alias("hash"), access.alias("access"))
    now = docs.select("node", F.sha2(F.when(F.col("node") % 4 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return usage.stale(vault, now)


@query("""SELECT o_orderkey, 'analytics-deleted' AS event, 'retention-limit-expired' AS reason FROM orders WHERE o_orderdate + INTERVAL 365 DAY < TIMESTAMP '2000-01-01'""")
def retention_audit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return usage.expire(orders, "o_orderkey", F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS"), F.lit("2000-01-01").cast("timestamp"))[1]


@query("""WITH m AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'marker' WHEN 'view' THEN 'lyric' WHEN 'error' THEN 'tempo' ELSE 'other' END AS kind FROM events)
SELECT user_id, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) FILTER (kind = 'marker'), '') AS markers, count(*) FILTER (kind = 'lyric') AS n_lyrics, arg_min(event_id::VARCHAR, (ts, event_id)) FILTER (kind = 'tempo') AS initial_tempo FROM m GROUP BY user_id""")
def meta_summaries(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "marker").when(F.col("event_type") == "view", "lyric").when(F.col("event_type") == "error", "tempo").otherwise("other")
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", kind.alias("kind"), F.col("event_id").cast("string").alias("text"))
    told = notes.meta_summary(rows, ["user_id"], "kind", "text", ["ts", "event_id"])
    return told.select("user_id", F.array_join("markers", ",").alias("markers"), F.size("lyrics").cast("long").alias("n_lyrics"), "initial_tempo")
