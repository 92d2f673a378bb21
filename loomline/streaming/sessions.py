"""Usage events as a stream: each counted once, and the sessions they make, with their paths.

Events are (event_id, user, node, clock, at): ``clock`` is the device's logical counter, which orders a session's path;
``at``, the wall clock, measures its length and its gaps. A session is closed, and written once, when the watermark passes
its end by the gap; until then its events are kept in the state that the checkpoint holds, so a restart goes on where the
last run stopped.

Defined cases: an event that arrives again within the watermark's delay counts once; one that is later than the watermark is
dropped if its session can't take it any more, as Spark does with late rows; events without user, node or wall clock are left
out; events of one counter are ordered by event_id; a session that is still open isn't written yet; no new events write
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user, began, ended, n_events, path) of a stream (or table) of events: nodes in the order of the logical clock."""
    known = events.filter("user IS NOT NULL AND node IS NOT NULL AND at IS NOT NULL").select("event_id", "user", "node", "clock", "at").withWatermark("at", delay)
    once = known.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else known.dropDuplicates(["event_id"])
    path = F.array_sort(F.collect_list(F.struct("clock", "event_id", "node")))
    rows = once.groupBy("user", F.session_window("at", gap).alias("w")).agg(F.min("at").alias("began"), F.max("at").alias("ended"), F.count("*").alias("n_events"), path.alias("path"))
    return rows.select("user", "began", "ended", "n_events", F.transform("path", lambda p: p["node"]).alias("path"))


def follow(events: DataFrame, path: str, checkpoint: str, gap: str = "30 minutes", delay: str = "1 hour") -> None:
    """Adds the sessions that are closed by now to the Parquet table at ``path``; run again it adds those that were closed since."""
    query = sessions(events, gap, delay).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
