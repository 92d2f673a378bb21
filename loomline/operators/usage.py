"""Reading analytics: sessions, time per node, reports and their suppression.

Defined cases: null keys, nodes and levels are groups of their own; null persons are counted in events, not in persons; null
instants begin no gap and measure nothing; events that tie in time are ordered by the tie column; repeated rows count each, but
once among different persons, sessions and nodes; a group under k persons is left out whole; a record without purposes
or expiry is not permitted and stays for ever; empty tables give no rows, nor totals. Columns whose
names begin with an underscore are the operators' own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.islands import micros


def session_summary(sessions: DataFrame, by: Sequence[str], ts: str, tie: str, node: str) -> DataFrame:
    """Start and end rows, duration, number of events and distinct nodes of each session."""
    return sessions.groupBy(*by).agg(
        F.min_by(tie, F.struct(ts, tie)).alias("first_event"),
        F.max_by(tie, F.struct(ts, tie)).alias("last_event"),
        (F.max(micros(F.col(ts))) - F.min(micros(F.col(ts)))).alias("duration_us"),
        F.count("*").alias("n_events"),
        F.countDistinct(node).alias("n_nodes"),
    )


def time_per_node(sessions: DataFrame, by: Sequence[str], ts: str, tie: str, node: str) -> DataFrame:
    """Microseconds from each open to the next in its session, summed by node (repeated visits add up)."""
    following = F.lead(ts).over(Window.partitionBy(*by).orderBy(ts, tie))
    spent = sessions.withColumn("spent", micros(following) - micros(F.col(ts)))
    return spent.groupBy(node).agg(F.coalesce(F.sum("spent"), F.lit(0)).cast("long").alias("spent_us"), F.count("*").alias("n_visits"))


def bigrams(df: DataFrame, by: Sequence[str], order: Sequence[str], node: str) -> DataFrame:
    """How often one node follows another."""
    following = F.lead(node).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("next_node", following).filter("next_node IS NOT NULL").groupBy(F.col(node).alias("node"), "next_node").agg(F.count("*").alias("n"))


def k_anonymous(df: DataFrame, by: Sequence[str], person: str, k: int) -> DataFrame:
    """Groups with k persons or more."""
    return df.groupBy(*by).agg(F.count("*").alias("n_events"), F.countDistinct(person).alias("n_persons")).filter(F.col("n_persons") >= k)


def shared_level(ts: Column, level: str) -> Column:
    """The instant as far as a sharing level tells it."""
    units = {"session": "hour", "weekly": "week", "monthly": "month"}
    if level == "raw":
        return ts
    if level not in units:
        raise ValueError(f"unknown sharing level {level}")
    return F.date_trunc(units[level], ts)


def report(df: DataFrame, by: Sequence[str], person: str) -> DataFrame:
    """(by, n_events, n_persons, is_total): one row for each group, and the totals over all in a row whose ``by`` are null."""
    keys = [F.grouping(c) for c in by]
    whole = keys[0] if keys else F.lit(1)
    out = df.groupingSets([[F.col(c) for c in by], []], *[F.col(c) for c in by]).agg(F.count("*").alias("n_events"), F.countDistinct(person).alias("n_persons"), (whole == 1).alias("is_total"))
    return out.select(*by, "n_events", "n_persons", "is_total")


def at_level(df: DataFrame, ts: str, level: str, person: str) -> DataFrame:
    """(at, n_events, n_persons): what a sharing level (session, weekly, monthly or raw) tells."""
    return df.groupBy(shared_level(F.col(ts), level).alias("at")).agg(F.count("*").alias("n_events"), F.countDistinct(person).alias("n_persons"))


def depth_histogram(events: DataFrame, depth: Column, opened: Column) -> DataFrame:
    """(depth, n) of the events that open something."""
    return events.filter(opened).groupBy(depth.alias("depth")).agg(F.count("*").alias("n"))


def weekly(sessions: DataFrame, ts: str, by: Sequence[str], session: Sequence[str], node: str, consented: Column) -> DataFrame:
    """By week and ``by``: events and different sessions of all, but events and different nodes only of those with consent."""
    week = F.date_format(shared_level(F.col(ts), "weekly"), "yyyy-MM-dd").alias("week")
    return sessions.groupBy(week, *by).agg(
        F.count("*").alias("n_events"), F.count_distinct(F.struct(*session)).alias("n_sessions"), F.count_if(consented).alias("n_consented"), F.count_distinct(F.when(consented, F.col(node))).alias("n_nodes")
    )


def trust_scores(purchases: DataFrame, authors: DataFrame, citations: DataFrame) -> DataFrame:
    """(customer, node, score): 100 for having bought the node, 50 for having cited it, 5 for every purchase from its author.

    Rows (customer, node), one for each purchase, and for pairs that only a citation links; a node's own purchases count
    among its author's.
    """
    bought = purchases.join(authors, "node")
    same = bought.groupBy("customer", "author").agg(F.count("*").alias("n_same"))
    pairs = purchases.select("customer", "node", F.lit(100).alias("direct"), F.lit(0).alias("cited")).union(citations.select("customer", "node", F.lit(0), F.lit(50)))
    pairs = pairs.groupBy("customer", "node").agg(F.max("direct").alias("direct"), F.max("cited").alias("cited"))
    told = pairs.join(authors, "node").join(same, ["customer", "author"], "left")
    return told.select("customer", "node", (F.col("direct") + F.col("cited") + 5 * F.coalesce("n_same", F.lit(0))).cast("long").alias("score"))


def for_purpose(records: DataFrame, purpose: str, known: Sequence[str], by: Sequence[str], person: str, k: int) -> DataFrame:
    """Groups with k persons or more, of the records whose map ``purposes`` permits the purpose; an unknown purpose raises."""
    if purpose not in known:
        raise ValueError(f"unknown purpose {purpose}")
    return k_anonymous(records.filter(F.coalesce(F.col("purposes")[purpose], F.lit(False))), by, person, k)


# Kinds of access that include later versions.
UPDATED = ("permanent", "cite", "embed")


def stale(vault: DataFrame, published: DataFrame) -> DataFrame:
    """(node, action) of vault entries (node, hash, access) whose published hash (node, hash) differs: fetch it, or tell the customer."""
    now = published.select("node", F.col("hash").alias("_now"))
    action = F.when(F.col("access").isin(*UPDATED), "fetch").otherwise("notify")
    return vault.join(now, "node").filter(F.col("hash") != F.col("_now")).select("node", action.alias("action"))


def expire(records: DataFrame, key: str, expires: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """Records that stay, and an audit row (key, event, reason) for each that is gone (strictly after its expiry)."""
    gone = F.coalesce(now > expires, F.lit(False))
    audit = records.filter(gone).select(key, F.lit("analytics-deleted").alias("event"), F.lit("retention-limit-expired").alias("reason"))
    return records.filter(~gone), audit
