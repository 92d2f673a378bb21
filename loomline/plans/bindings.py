"""Queries on the driver tables, one or more for each operator, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as fn
from loomline.operators import clocks, facts, islands, journal_report, journal_text, links, notes, spans, trees, usage, versions
from loomline.operators.asof import asof
from loomline.operators.scans import RANGES
from loomline.plans.registry import ORACLES, QUERIES, events, query, table  # noqa: F401
from loomline.sources import documents as nested
from loomline.sources import journal, transcripts
from loomline.storage import materialise, shared_path
from loomline.streaming import log as logs
from loomline.streaming import sessions

# As-of joins


@query("""SELECT p.event_id, p.user_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def asof_backward(spark, sf_dir):
    left, right = events(spark, sf_dir, "purchase").select("user_id", "ts", "event_id"), events(spark, sf_dir, "click")
    return asof(left, right, ["user_id"], "ts", {"event_id": "click_id"}, "event_id").select("event_id", "user_id", "click_id")


@query("""WITH v AS (SELECT * FROM events WHERE event_type = 'view'), f AS (SELECT user_id, arg_min(event_id, ts) AS first_id FROM v GROUP BY user_id)
SELECT p.event_id, p.user_id, coalesce(c.event_id, f.first_id) AS view_id FROM (SELECT * FROM events WHERE event_type = 'error') p
ASOF LEFT JOIN v c ON p.user_id = c.user_id AND p.ts >= c.ts LEFT JOIN f ON f.user_id = p.user_id""")
def asof_backward_clamped(spark, sf_dir):
    left, right = events(spark, sf_dir, "error").select("user_id", "ts", "event_id"), events(spark, sf_dir, "view")
    return asof(left, right, ["user_id"], "ts", {"event_id": "view_id"}, "event_id", clamp=True).select("event_id", "user_id", "view_id")


@query("""SELECT p.event_id, p.user_id, c.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'click') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') c ON p.user_id = c.user_id AND p.ts <= c.ts""")
def asof_forward(spark, sf_dir):
    left, right = events(spark, sf_dir, "click").select("user_id", "ts", "event_id"), events(spark, sf_dir, "signup")
    return asof(left, right, ["user_id"], "ts", {"event_id": "signup_id"}, "event_id", forward=True).select("event_id", "user_id", "signup_id")


# Runs, turns, folds


@query("""WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_no FROM c)
SELECT user_id, run_no::BIGINT AS run_no, event_type, arg_min(event_id, (ts, event_id)) AS first_event, count(*) AS n_events FROM r GROUP BY user_id, run_no, event_type""")
def utterance_islands(spark, sf_dir):
    rows = islands.number_runs(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "run_no", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.count("*").alias("n_events"))


@query("""WITH r AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events)
SELECT user_id, turn::BIGINT AS turn, count(*) AS n_events, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event
FROM r WHERE event_type <> 'error' GROUP BY user_id, turn""")
def marker_turns(spark, sf_dir):
    rows = islands.number_after(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", "turn", keep_markers=False)
    order = F.struct("ts", "event_id")
    return rows.groupBy("user_id", "turn").agg(F.count("*").alias("n_events"), F.min_by("event_id", order).alias("first_event"), F.max_by("event_id", order).alias("last_event"))


@query("""WITH r AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS fold FROM conversations)
SELECT conv_id, fold::BIGINT AS fold, count(*) AS n_lines, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS body FROM r WHERE fold > 0 GROUP BY conv_id, fold""")
def continuation_fold(spark, sf_dir):
    return islands.fold_lines(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user", "text")


# Link journals and ranks

_OPS = """o AS (SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'c' WHEN 'error' THEN 'd+' ELSE 'd-' END AS kind, user_id AS a,
  CASE WHEN event_type = 'click' THEN floor(value)::BIGINT % 150 END AS b FROM events WHERE event_type IN ('click', 'error', 'signup')),
p AS (SELECT a AS src, arg_max(kind, (ts, event_id)) AS kind, arg_max(b, (ts, event_id)) AS dst, arg_max(event_id, (ts, event_id)) AS id FROM o WHERE kind IN ('c', 'd+') GROUP BY a),
m AS (SELECT n AS dst, arg_max(kind, (ts, event_id)) AS kind, arg_max(event_id, (ts, event_id)) AS id FROM (SELECT *, CASE kind WHEN 'c' THEN b ELSE a END AS n FROM o WHERE kind IN ('c', 'd-')) GROUP BY n),
e AS (SELECT src, p.dst, p.id AS event_id FROM p JOIN m ON p.dst = m.dst AND p.id = m.id WHERE p.kind = 'c' AND m.kind = 'c')"""


def _journal(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir, "click", "error", "signup")
    kind = F.when(F.col("event_type") == "click", "c").when(F.col("event_type") == "error", "d+").otherwise("d-")
    target = F.when(F.col("event_type") == "click", F.floor("value").cast("long") % 150)
    return rows.select(kind.alias("kind"), F.col("user_id").alias("a"), target.alias("b"), F.struct("ts", "event_id").alias("seq"))


@query(f"WITH {_OPS} SELECT src, dst, event_id FROM e")
def link_replay(spark, sf_dir):
    return links.replay(_journal(spark, sf_dir)).select("src", "dst", F.col("seq.event_id").alias("event_id"))


@query(f"""WITH {_OPS} SELECT DISTINCT src AS node, 'head' AS role FROM e WHERE src NOT IN (SELECT dst FROM e)
UNION ALL SELECT DISTINCT dst, 'tail' FROM e WHERE dst NOT IN (SELECT src FROM e)
UNION ALL SELECT src, 'posward' FROM e GROUP BY src HAVING count(*) > 1 UNION ALL SELECT dst, 'negward' FROM e GROUP BY dst HAVING count(*) > 1""")
def mirror_check(spark, sf_dir):
    edges = links.replay(_journal(spark, sf_dir))
    return links.ends(edges).union(links.broken(edges).select("node", F.col("side").alias("role")))


def _order_chain(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = orders.select(F.col("o_orderkey").alias("src"), following.alias("dst")).filter("dst IS NOT NULL")
    return edges, orders.select(F.col("o_orderkey").alias("node"))


_CHAIN = """c AS (SELECT o_orderkey AS node, first_value(o_orderkey) OVER w AS head, row_number() OVER w - 1 AS pos FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
l AS (SELECT head, count(*) AS len FROM c GROUP BY head)"""


@query(f"WITH {_CHAIN} SELECT node, head, pos::BIGINT AS pos, false AS is_circular FROM c")
def rank_walk(spark, sf_dir):
    return links.ranks(*_order_chain(spark, sf_dir))


@query(f"WITH {_CHAIN} SELECT len, count(*) AS n FROM l GROUP BY len ORDER BY len LIMIT 12")
def rank_hist(spark, sf_dir):
    return links.lengths(links.ranks(*_order_chain(spark, sf_dir))).groupBy("len").agg(F.count("*").alias("n")).orderBy("len").limit(12)


@query(f"WITH {_CHAIN} SELECT head, len FROM l ORDER BY len DESC, head LIMIT 30")
def rank_top(spark, sf_dir):
    return links.lengths(links.ranks(*_order_chain(spark, sf_dir))).select("head", "len").orderBy(F.desc("len"), "head").limit(30)


@query(f"""WITH {_CHAIN}, n AS (SELECT c.*, len FROM c JOIN l USING (head))
SELECT head, pos::BIGINT AS pos, node, 0::BIGINT AS hidden FROM n WHERE len <= 10 OR pos < 7 OR pos >= len - 3
UNION ALL SELECT head, pos::BIGINT, NULL, (len - 10)::BIGINT FROM n WHERE len > 10 AND pos = 7""")
def rank_elide(spark, sf_dir):
    return links.elide(links.ranks(*_order_chain(spark, sf_dir)), 10)


def _nation_ring(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    first = F.first("n_nationkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("n_regionkey", F.col("n_nationkey").alias("src"), F.coalesce(F.lead("n_nationkey").over(w), first).alias("dst"))


@query("""WITH h AS (SELECT n_regionkey, max(n_nationkey::VARCHAR) AS head, count(*) AS len FROM nation GROUP BY n_regionkey)
SELECT head::INTEGER AS head, len, true AS is_circular FROM h""")
def ring_head(spark, sf_dir):
    return links.lengths(links.ranks(_nation_ring(spark, sf_dir).select("src", "dst"))).select("head", "len", "is_circular")


# Containment, threads, views


@query("""WITH RECURSIVE e AS (SELECT p_partkey // 10 AS container, p_partkey AS thing FROM part WHERE p_partkey // 10 IN (SELECT p_partkey FROM part)),
r AS (SELECT * FROM e UNION SELECT r.container, e.thing FROM r JOIN e ON e.container = r.thing)
SELECT container, count(*) AS n_things FROM r GROUP BY container""")
def contents_closure(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey")
    edges = part.select(F.expr("p_partkey div 10").alias("container"), F.col("p_partkey").alias("thing"))
    edges = edges.join(part.withColumnRenamed("p_partkey", "container"), "container", "left_semi")
    return trees.closure(edges).groupBy("container").agg(F.count("*").alias("n_things"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS container, coalesce(lead(n_nationkey) OVER w, first_value(n_nationkey) OVER w) AS thing FROM nation
  WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)),
r AS (SELECT * FROM e UNION SELECT r.container, e.thing FROM r JOIN e ON e.container = r.thing) SELECT container, thing FROM r""")
def closure_cyclic(spark, sf_dir):
    return trees.closure(_nation_ring(spark, sf_dir).select(F.col("src").alias("container"), F.col("dst").alias("thing")))


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent, p_retailprice AS s FROM part),
r AS (SELECT id, id AS root, 0 AS depth, [{'s': s, 'id': id}] AS path FROM n WHERE parent IS NULL
  UNION ALL SELECT n.id, r.root, r.depth + 1, list_append(r.path, {'s': n.s, 'id': n.id}) FROM r JOIN n ON n.parent = r.id)
SELECT id, root, depth, row_number() OVER (PARTITION BY root ORDER BY path)::BIGINT AS place FROM r""")
def thread_preorder(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey >= 10 THEN p_partkey div 10 END").alias("parent"), F.col("p_retailprice").alias("sort"))
    return trees.preorder(part).select("id", "root", "depth", (F.col("pos") + 1).alias("place"))


@query("""WITH RECURSIVE g AS (SELECT n_nationkey AS k, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
x AS (SELECT k AS a, coalesce(lead(k) OVER w, first_value(k) OVER w) AS b, 0 AS axis FROM g WINDOW w AS (PARTITION BY r ORDER BY k)
  UNION ALL SELECT g.k, h.k, 1 FROM g JOIN g h ON h.i = g.i AND h.r = g.r + 1),
s AS (SELECT a, b, 2 * axis AS code FROM x UNION ALL SELECT b, a, 2 * axis + 1 FROM x),
p AS (SELECT 0 AS cell, 0 AS x, 0 AS y, []::INTEGER[] AS path, 0 AS d
  UNION ALL SELECT s.b, p.x + CASE code WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END, p.y + CASE code WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END, list_append(p.path, code), d + 1
  FROM p JOIN s ON s.a = p.cell WHERE d < 7)
SELECT cell, (arg_min(x, (d, path)))::INTEGER AS x, (arg_min(y, (d, path)))::INTEGER AS y, 0 AS z FROM p GROUP BY cell""")
def view_grid(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    ring = _nation_ring(spark, sf_dir).select(F.lit(0).alias("axis"), "src", "dst")
    placed = nation.withColumn("i", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    above = placed.select((F.col("n_regionkey") - 1).alias("n_regionkey"), "i", F.col("n_nationkey").alias("dst"))
    up = placed.join(above, ["n_regionkey", "i"]).select(F.lit(1).alias("axis"), F.col("n_nationkey").alias("src"), "dst")
    cells = nation.select(F.col("n_nationkey").alias("cell"))
    return trees.grid_view(cells.filter("cell = 0"), ring.union(up), cells)


# Facts


@query("""WITH e AS (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b, l_returnflag AS type FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT node, count(*) AS n_connected FROM (SELECT a AS node, b AS other, type FROM e UNION SELECT b, a, type FROM e) GROUP BY node""")
def connections_both(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    edges = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("b"), F.col("l_returnflag").alias("type"))
    return facts.both_ways(edges, keep=["type"]).groupBy("node").agg(F.count("*").alias("n_connected"))


@query("""SELECT l_partkey AS p_partkey, any_value(p_brand) AS p_brand, count(DISTINCT l_orderkey) AS n_orders FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey""")
def array_members(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    each = facts.members(held, "l_orderkey", "parts", "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("n_orders"))
    return each.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE -1 - o_orderkey // 2 END AS ref FROM orders)
SELECT o_orderkey, ref, CASE WHEN c_custkey IS NOT NULL THEN 'customer' WHEN s_suppkey IS NOT NULL THEN 'supplier' END AS kind, coalesce(c_name, s_name) AS label
FROM r LEFT JOIN customer ON c_custkey = ref LEFT JOIN supplier ON -1 - s_suppkey = ref""")
def ref_coalesce(spark, sf_dir):
    """All customers and suppliers; the latter have negative keys, of which more are wanted than there are."""
    ref = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.expr("-1 - o_orderkey div 2"))
    suppliers = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("key"), "s_name")
    refs = table(spark, sf_dir, "orders").select("o_orderkey", ref.alias("ref"))
    return facts.resolve(refs, "ref", [("customer", table(spark, sf_dir, "customer"), "c_custkey", "c_name"), ("supplier", suppliers, "key", "s_name")])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_present(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("""SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)""")
def anti_missing(spark, sf_dir):
    """Documents without a label (every customer has orders)."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH w AS (SELECT DISTINCT md5(text) AS digest FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark WHERE item_id % 2 = 0))
SELECT digest, digest NOT IN (SELECT md5(text) FROM benchmark WHERE text IS NOT NULL) AS created FROM w""")
def find_or_create(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    wanted = table(spark, sf_dir, "documents").select("text").union(bench.filter("item_id % 2 = 0").select("text"))
    return facts.find_or_create(wanted.select(F.md5("text").alias("digest")), bench.select(F.md5("text").alias("digest")), "digest")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def lww_text(spark, sf_dir):
    return facts.latest(events(spark, sf_dir), ["user_id", "event_type"], "value", ["ts", "event_id"])


@query("""SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values, string_agg(o_orderstatus, '>' ORDER BY o_orderdate, o_orderkey) AS trail FROM orders
GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1""")
def change_trail(spark, sf_dir):
    return facts.trail(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["o_orderdate", "o_orderkey"])


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type""")
def history_distinct(spark, sf_dir):
    return facts.without_repeats(events(spark, sf_dir), ["user_id"], "event_type", ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""WITH c AS (SELECT doc_id, 1 AS priority, 'good label' AS origin FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 2, 'label' FROM labels
UNION ALL SELECT doc_id, 3, 'document' FROM documents WHERE lang <> 'de')
SELECT doc_id, arg_min(origin, priority) AS origin FROM c GROUP BY doc_id""")
def fallback_priority(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    tries = labels.select("doc_id", F.lit(1).alias("priority"), F.lit("good label").alias("origin"), (F.col("quality") == 1).alias("ok"))
    tries = tries.union(labels.select("doc_id", F.lit(2), F.lit("label"), F.lit(True))).union(docs.select("doc_id", F.lit(3), F.lit("document"), F.col("lang") != "de"))
    return facts.first_found(tries, ["doc_id"], "priority", F.col("ok")).select("doc_id", "origin")


@query("SELECT o_custkey AS node, 'posward' AS side, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def restriction_r(spark, sf_dir):
    return links.broken(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")))


# Versions

_STATE = "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events {until} GROUP BY user_id, event_type"
_FIRST, _LAST = _STATE.format(until="WHERE ts < TIMESTAMP '2024-01-06 00:00:00'"), _STATE.format(until="")


def _state(spark, sf_dir, day: str | None = None) -> DataFrame:
    """Each user's last value of each type: now, or before a day."""
    rows = events(spark, sf_dir)
    if day:
        rows = rows.filter(F.col("ts") < F.lit(f"2024-01-{day} 00:00:00").cast("timestamp"))
    return facts.latest(rows, ["user_id", "event_type"], "value", ["ts", "event_id"])


@query(f"""WITH a AS ({_FIRST}), b AS ({_LAST})
SELECT user_id, event_type, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM a FULL JOIN b USING (user_id, event_type) WHERE a.value IS DISTINCT FROM b.value""")
def version_diff(spark, sf_dir):
    return versions.diff(_state(spark, sf_dir, "06"), _state(spark, sf_dir), ["user_id", "event_type"], "value")


@query(f"""WITH a AS ({_FIRST}), b AS ({_LAST})
SELECT user_id, event_type, sha256(floor(value)::BIGINT::VARCHAR) AS content_hash FROM b
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.event_type = b.event_type AND floor(a.value) = floor(b.value))""")
def mirror_changed(spark, sf_dir):
    content = F.floor("value").cast("long").cast("string")
    out = versions.to_mirror(_state(spark, sf_dir), _state(spark, sf_dir, "06"), ["user_id", "event_type"], content)
    return out.select("user_id", "event_type", "content_hash")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id ORDER BY min((ts, event_id)) DESC LIMIT 24")
def fifo_cache(spark, sf_dir):
    return versions.fifo(events(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", F.col("entered.event_id").alias("event_id"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::BIGINT AS revision FROM orders")
def revision_counter(spark, sf_dir):
    return versions.with_revision(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "revision")


@query("""WITH r AS (SELECT o_custkey, count(*) AS revision FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_custkey % 12 AS expected, c_custkey % 12 = coalesce(revision, 0) AS accepted FROM customer LEFT JOIN r ON o_custkey = c_custkey""")
def optimistic_commit(spark, sf_dir):
    now = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("revision"))
    wanted = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 12).alias("expected"))
    return versions.commit_conflict(now, wanted, ["c_custkey"])


@query("""SELECT o_orderkey, o_orderdate + INTERVAL 365 DAY < TIMESTAMP '2000-01-01' AS expired FROM orders""")
def retention_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    kept, gone = versions.retention(orders, F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS"), F.lit("2000-01-01").cast("timestamp"))
    return kept.select("o_orderkey", F.lit(False).alias("expired")).union(gone.select("o_orderkey", F.lit(True)))


# Scalar functions


@query("""WITH s AS (SELECT event_id, greatest(0, round_even(value * 100, 0))::BIGINT AS s FROM events)
SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS hms FROM s""")
def hms_half_even(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", fn.hms(F.col("value") * 100).alias("hms"))


@query("""WITH s AS (SELECT event_id, floor(greatest(0, value * 100))::BIGINT AS s FROM events)
SELECT event_id, CASE WHEN s < 3600 THEN printf('%02d:%02d', s // 60, s % 60) ELSE printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) END AS clock FROM s""")
def fmt_ts(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", fn.clock(F.col("value") * 100).alias("clock"))


@query("""SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
  list_last(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')) AS last FROM pages""")
def url_parts(spark, sf_dir):
    path = fn.url_path(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", fn.url_scheme(F.col("url")).alias("scheme"), path.alias("path"), fn.last_component(path).alias("last"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, '[1, {' AS broken FROM events")
def json_expand(spark, sf_dir):
    held = F.to_json(F.struct(F.concat(F.lit("  "), F.col("props")).alias("p"), F.lit("[1, {").alias("broken")))
    rows = events(spark, sf_dir).select("event_id", fn.expand_json(held).alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.p.k").cast("long").alias("k"), F.get_json_object("j", "$.broken").alias("broken"))


@query("SELECT doc_id, substr(hex(encode(text)), 201, 100) AS span FROM documents")
def byte_span(spark, sf_dir):
    """Of every document, as hex, for a span may begin or end within a character."""
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(fn.byte_span(F.col("text"), 100, 50)).alias("span"))


@query("""WITH w AS (SELECT l_orderkey AS doc, l_linenumber AS no, l_suppkey % 100 AS source, l_partkey % 300 AS start, l_quantity::BIGINT AS length,
    sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey % 100, l_partkey % 300, l_quantity ROWS UNBOUNDED PRECEDING) AS until, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey % 100, l_partkey % 300, l_quantity) AS place FROM lineitem),
a AS (SELECT o_orderkey AS id, o_custkey % 80 AS s, o_custkey % 80 + 1 + o_orderkey % 90 AS e FROM orders), t AS (SELECT doc, max(until) AS total FROM w GROUP BY doc),
p AS (SELECT id, place, row_number() OVER (PARTITION BY id ORDER BY place) AS piece, source, (start + greatest(s, until - length) - (until - length))::BIGINT AS start, (least(e, until) - greatest(s, until - length))::BIGINT AS length, e > total AS cut
      FROM a JOIN w ON w.doc = a.id AND s < until AND e > until - length JOIN t ON t.doc = a.id)
SELECT id, piece, start, length::BIGINT AS length, CASE WHEN cut THEN 'cut at the end' END AS problem, substr(hex(encode(text)), (2 * start + 1)::BIGINT, (2 * p.length)::BIGINT) AS bytes FROM p LEFT JOIN documents ON doc_id = p.source
UNION ALL SELECT id, NULL, NULL, NULL, 'no such place', NULL FROM a LEFT JOIN t ON t.doc = a.id WHERE total IS NULL OR s >= total""")
def virtual_ranges(spark, sf_dir):
    """Every order's lines as spans of a hundred documents, and of each such whole one range, as bytes of the documents."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("no"), (F.col("l_suppkey") % 100).alias("source"), (F.col("l_partkey") % 300).alias("start"), F.col("l_quantity").cast("long").alias("length"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 80).alias("start"), (1 + F.col("o_orderkey") % 90).alias("length"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), "text")
    pieces = spans.resolve(asked, spans.placed(lines)).join(texts, "source", "left")
    span = F.expr("substring(encode(text, 'UTF-8'), CAST(start + 1 AS INT), CAST(length AS INT))")
    return pieces.select("id", "piece", "start", "length", "problem", F.hex(span).alias("bytes"))


@query("""WITH w AS (SELECT page_id, len(regexp_extract_all(html, '[^ \\t\\n\\x0B\\f\\r]+')) AS n_source, len(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^ \\t\\n\\x0B\\f\\r]+')) AS n_text FROM pages)
SELECT page_id, n_source::BIGINT AS n_source, n_text::BIGINT AS n_text, round(n_text / greatest(n_source, 1), 6) AS coverage, n_text / greatest(n_source, 1) < 0.85 AS low FROM w""")
def coverage_ratio(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", fn.word_count(F.col("html")).alias("n_source"), fn.word_count(fn.without_tags(F.col("html"))).alias("n_text"))
    share = F.col("n_text") / F.greatest("n_source", F.lit(1))
    return pages.select("page_id", "n_source", "n_text", F.round(share, 6).alias("coverage"), (share < 0.85).alias("low"))


@query("""SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN bool_or(event_type = 'signup') AND bool_or(event_type <> 'signup') THEN 'mixed' WHEN bool_or(event_type = 'signup') THEN 'content' ELSE 'dimension' END AS kind
FROM events GROUP BY user_id, day""")
def kind_flags(spark, sf_dir):
    """By user and day, for over all days every user is mixed."""
    ops = events(spark, sf_dir).select("user_id", F.col("ts").cast("date").alias("day"), F.when(F.col("event_type") == "signup", "s").otherwise("c").alias("kind"))
    return journal_report.kinds(ops, ["user_id", "day"])


# Reading analytics (designs only, where the operators come from); a session ends after a gap of 30 minutes

_SESSIONS = """q AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800000000 THEN 0 ELSE 1 END AS ch FROM events),
s AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM q)"""


def _sessions(spark, sf_dir) -> DataFrame:
    return islands.number_sessions(events(spark, sf_dir), ["user_id"], "ts", "event_id", 1800)


@query(f"""WITH {_SESSIONS} SELECT user_id, session_no::BIGINT AS session_no, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event,
  (max(epoch_us(ts)) - min(epoch_us(ts)))::BIGINT AS duration_us, count(*) AS n_events, count(DISTINCT event_type) AS n_nodes FROM s GROUP BY user_id, session_no""")
def session_rollup(spark, sf_dir):
    return usage.session_summary(_sessions(spark, sf_dir), ["user_id", "session_no"], "ts", "event_id", "event_type")


@query(f"""WITH {_SESSIONS}, l AS (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id)) - epoch_us(ts) AS d FROM s)
SELECT event_type, coalesce(sum(d), 0)::BIGINT AS spent_us, count(*) AS n_visits FROM l GROUP BY event_type""")
def time_per_node(spark, sf_dir):
    return usage.time_per_node(_sessions(spark, sf_dir), ["user_id", "session_no"], "ts", "event_id", "event_type")


@query("""WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS u, event_id, ts, event_type FROM events),
l AS (SELECT *, lag(ts) OVER w AS p, lag(event_type) OVER w AS b FROM e WINDOW w AS (PARTITION BY u ORDER BY ts, event_id)),
n AS (SELECT *, sum((p IS NULL OR epoch_us(ts) - epoch_us(p) > 60000000)::INT) OVER w AS session_no, sum((b IS DISTINCT FROM event_type)::INT) OVER w AS run_no FROM l WINDOW w AS (PARTITION BY u ORDER BY ts, event_id))
SELECT u AS user_id, count(DISTINCT session_no) AS n_sessions, count(DISTINCT run_no) AS n_runs, sum(session_no * event_id)::BIGINT AS sessions_sum, sum(run_no * event_id)::BIGINT AS runs_sum FROM n GROUP BY u""")
def hot_sessions(spark, sf_dir):
    """Sessions (a gap of over a minute) and runs where one user has every third event, in parts of a range of the key each."""
    rows = events(spark, sf_dir).select(F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("user_id"), "event_id", "ts", "event_type")
    rows = islands.number_sessions(rows, ["user_id"], "ts", "event_id", 60, split=RANGES)
    rows = islands.number_runs(rows, ["user_id"], ["ts", "event_id"], "event_type", split=lambda ts: F.date_trunc("day", ts))
    sums = [F.sum(F.col(c) * F.col("event_id")).alias(n) for c, n in (("session_no", "sessions_sum"), ("run_no", "runs_sum"))]
    return rows.groupBy("user_id").agg(F.countDistinct("session_no").alias("n_sessions"), F.countDistinct("run_no").alias("n_runs"), *sums)


@query("SELECT (props->>'$.k')::BIGINT % 5 AS depth, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1")
def depth_hist(spark, sf_dir):
    return usage.depth_histogram(events(spark, sf_dir), F.get_json_object("props", "$.k").cast("long") % 5, F.col("event_type") == "view")


@query("SELECT hour(ts)::INTEGER AS hour, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users, grouping(hour(ts)) = 1 AS is_total FROM events GROUP BY GROUPING SETS ((hour(ts), event_type), ())")
def usage_report(spark, sf_dir):
    """Events and users by hour and kind, and the totals."""
    rows = events(spark, sf_dir).select(F.hour("ts").alias("hour"), "event_type", "user_id")
    return usage.report(rows, ["hour", "event_type"], "user_id").withColumnRenamed("n_persons", "n_users")


@query("""SELECT level, CASE level WHEN 'session' THEN date_trunc('hour', ts) WHEN 'weekly' THEN date_trunc('week', ts) ELSE date_trunc('month', ts) END::DATE::VARCHAR AS day, hour(CASE level WHEN 'session' THEN ts ELSE date_trunc('day', ts) - INTERVAL 0 HOUR END) * (level = 'session')::INTEGER AS hour,
  count(*) AS n_events, count(DISTINCT user_id) AS n_persons FROM events, (SELECT unnest(['session', 'weekly', 'monthly']) AS level) GROUP BY ALL""")
def sharing_levels(spark, sf_dir):
    """What each sharing level tells of all events."""
    told = [usage.at_level(events(spark, sf_dir), "ts", level, "user_id").select(F.lit(level).alias("level"), F.date_format("at", "yyyy-MM-dd").alias("day"), F.hour("at").alias("hour"), "n_events", "n_persons") for level in ("session", "weekly", "monthly")]
    return told[0].union(told[1]).union(told[2])


@query(f"""WITH {_SESSIONS}, l AS (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id)) - epoch_us(ts) AS d FROM s)
SELECT user_id, coalesce(sum(d), 0)::BIGINT AS spent_us, count(*) AS n_visits FROM l GROUP BY user_id ORDER BY spent_us DESC, user_id LIMIT 10""")
def usage_top_users(spark, sf_dir):
    return usage.time_per_node(_sessions(spark, sf_dir), ["user_id", "session_no"], "ts", "event_id", "user_id").orderBy(F.desc("spent_us"), "user_id").limit(10)


@query("""SELECT event_type AS node, next_node, count(*) AS n FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_node FROM events)
WHERE next_node IS NOT NULL GROUP BY 1, 2""")
def usage_bigrams(spark, sf_dir):
    return usage.bigrams(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type")


@query(f"""WITH {_SESSIONS} SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n_events, count(DISTINCT (user_id, session_no)) AS n_sessions,
  count(*) FILTER (user_id % 3 <> 0) AS n_consented, count(DISTINCT floor(value)::BIGINT) FILTER (user_id % 3 <> 0) AS n_nodes FROM s GROUP BY 1, 2""")
def weekly_rollup(spark, sf_dir):
    rows = _sessions(spark, sf_dir).withColumn("node", F.floor("value").cast("long"))
    return usage.weekly(rows, "ts", ["event_type"], ["user_id", "session_no"], "node", F.col("user_id") % 3 != 0)


@query("""SELECT hour(ts)::INTEGER AS hour, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_persons FROM events GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 65""")
def k_anonymize(spark, sf_dir):
    return usage.k_anonymous(events(spark, sf_dir).withColumn("hour", F.hour("ts")), ["hour", "event_type"], "user_id", 65)


@query("""WITH p AS (SELECT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
b AS (SELECT o_custkey, s_nationkey, count(*) AS n_same FROM p JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
c AS (SELECT o_custkey, 1 + o_orderkey % (SELECT count(*) FROM supplier) AS l_suppkey FROM orders),
k AS (SELECT o_custkey, l_suppkey, max(d) AS d, max(c) AS c FROM (SELECT *, 100 AS d, 0 AS c FROM p UNION ALL SELECT *, 0, 50 FROM c) GROUP BY 1, 2)
SELECT k.o_custkey, k.l_suppkey, (d + c + 5 * coalesce(n_same, 0))::BIGINT AS score FROM k JOIN supplier s ON s_suppkey = l_suppkey
LEFT JOIN b ON b.o_custkey = k.o_custkey AND b.s_nationkey = s.s_nationkey""")
def trust_score(spark, sf_dir):
    """Suppliers are nodes, their nations authors; an order cites a supplier by its key."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    bought = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("customer"), F.col("l_suppkey").alias("node"))
    supplier = table(spark, sf_dir, "supplier")
    cited = orders.select(F.col("o_custkey").alias("customer"), (1 + F.col("o_orderkey") % supplier.count()).alias("node"))
    scored = usage.trust_scores(bought, supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("author")), cited)
    return scored.select(F.col("customer").alias("o_custkey"), F.col("node").alias("l_suppkey"), "score")


@query("""WITH v AS (SELECT DISTINCT o_custkey, day(o_orderdate)::INTEGER AS x, month(o_orderdate)::INTEGER AS y FROM orders)
SELECT * FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.o_custkey = a.o_custkey AND b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y))""")
def mvr_survivors(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.dayofmonth("o_orderdate").alias("x"), F.month("o_orderdate").alias("y")).distinct()
    return clocks.survivors(rows, ["o_custkey"], ["x", "y"]).select("o_custkey", "x", "y")


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS k, l_quantity::BIGINT AS x, (l_discount * 100)::BIGINT AS y, day(l_shipdate) AS z FROM lineitem)
SELECT k, x, y, z FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.k = c.k AND o.x >= c.x AND o.y >= c.y AND o.z >= c.z AND (o.x > c.x OR o.y > c.y OR o.z > c.z))""")
def mvr_front(spark, sf_dir):
    """Every supplier's register under clocks of three peers: what no other write dominates."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("long").alias("x"), F.round(F.col("l_discount") * 100).cast("long").alias("y"), F.dayofmonth("l_shipdate").alias("z"))
    return clocks.survivors(lines.distinct(), ["k"], ["x", "y", "z"])


@query("SELECT user_id, count(*) AS n, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS digest FROM events GROUP BY user_id")
def log_digest(spark, sf_dir):
    return clocks.log_digest(events(spark, sf_dir), ["user_id"], "event_id")


# Sources: the driver tables written in each format's own text or bytes, and read back


@query("""WITH o AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'c' WHEN 'error' THEN 'd+' WHEN 'signup' THEN 'd-' ELSE 's' END AS kind,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)
SELECT 'journal-' || user_id || '-' || n // 10000 AS file, (n // 10 % 1000)::INTEGER AS block_idx, (n % 10)::INTEGER AS op_idx, kind, event_id::VARCHAR AS a,
  CASE WHEN kind IN ('c', 's') THEN 'é' || chr(128512) || event_id END AS b FROM o""")
def journal_decode(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "click", "c").when(F.col("event_type") == "error", "d+").when(F.col("event_type") == "signup", "d-").otherwise("s")
    rows = events(spark, sf_dir).select("user_id", "event_id", kind.alias("kind"), (F.row_number().over(w) - 1).alias("n"))

    def text(value):
        raw = F.encode(value, "UTF-8")
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value)), 4, "0")), raw)

    # a supplementary character is two surrogates in this format: its six bytes stand in plain
    face = F.unhex(F.lit("EDA0BDEDB880"))
    tail = F.col("event_id").cast("string")
    body = F.concat(F.encode(F.lit("é"), "UTF-8"), face, F.encode(tail, "UTF-8"))
    named = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body)), 4, "0")), body)
    op = F.concat(F.encode("kind", "UTF-8"), text(tail), F.when(F.col("kind").isin("c", "s"), named).otherwise(F.unhex(F.lit(""))))
    return journal.operations(_packed(rows.withColumn("op", F.hex(op)))).select("file", "block_idx", "op_idx", "kind", "a", "b")


def _packed(rows: DataFrame) -> DataFrame:
    """(file, content): journals of a thousand blocks of ten operations each, from (user_id, n, op: an operation's bytes as hex)."""
    blocks = rows.groupBy("user_id", F.floor(F.col("n") / 10).alias("block")).agg(F.sort_array(F.collect_list(F.struct("n", "op"))).alias("ops"))
    whole = F.array_join(F.transform("ops", lambda o: o["op"]), "")
    blocks = blocks.select("user_id", "block", F.concat(F.lit("74"), F.lpad(F.hex("block"), 8, "0"), F.lpad(F.hex((F.length(whole) / 2).cast("long")), 8, "0"), whole).alias("hex"))
    files = blocks.groupBy("user_id", F.floor(F.col("block") / 1000).alias("part")).agg(F.sort_array(F.collect_list(F.struct("block", "hex"))).alias("b"))
    content = F.unhex(F.concat(F.lit("475A5A30" + "0" * 24), F.array_join(F.transform("b", lambda x: x["hex"]), "")))
    return files.select(F.concat(F.lit("journal-"), F.col("user_id"), F.lit("-"), F.col("part")).alias("file"), content.alias("content"))


_JOURNALS = """o AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'c' WHEN 'error' THEN 'd+' WHEN 'signup' THEN 'd-' ELSE 's' END AS kind, (event_id % 9)::VARCHAR AS a, (event_id // 9 % 9)::VARCHAR AS b,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
j AS (SELECT 'journal-' || user_id || '-' || n // 10000 AS file, kind, a, b, (n // 10 % 1000) * 100 + CASE kind WHEN 'c' THEN 10 WHEN 's' THEN 20 ELSE 0 END + n % 10 AS seq FROM o),
p AS (SELECT file, a AS src, arg_max(kind, seq) AS kind, arg_max(b, seq) AS dst, max(seq) AS seq FROM j WHERE kind IN ('c', 'd+') GROUP BY ALL),
m AS (SELECT file, dst, arg_max(kind, seq) AS kind, max(seq) AS seq FROM (SELECT file, CASE kind WHEN 'c' THEN b ELSE a END AS dst, kind, seq FROM j WHERE kind IN ('c', 'd-')) GROUP BY ALL),
e AS (SELECT p.file, p.src, p.dst FROM p JOIN m ON m.file = p.file AND m.dst = p.dst AND m.seq = p.seq WHERE p.kind = 'c' AND m.kind = 'c')"""


def _journals(spark, sf_dir) -> DataFrame:
    """Decoded journals of each user over nine cells."""
    kind = F.when(F.col("event_type") == "click", "c").when(F.col("event_type") == "error", "d+").when(F.col("event_type") == "signup", "d-").otherwise("s")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    names = [(F.col("event_id") % 9).cast("string"), (F.floor(F.col("event_id") / 9) % 9).cast("string")]
    a, b = (F.concat(F.lit("0001"), F.hex(F.encode(c, "UTF-8"))) for c in names)
    op = F.concat(F.hex(F.encode("kind", "UTF-8")), a, F.when(F.col("kind").isin("c", "s"), b).otherwise(""))
    rows = events(spark, sf_dir).withColumn("kind", kind).select("user_id", n.alias("n"), op.alias("op"))
    return journal.operations(_packed(rows))


@query(f"WITH {_JOURNALS} SELECT file, src, dst FROM e")
def replayed_journals(spark, sf_dir):
    """Journals decoded, put into the order of a replay, and replayed."""
    ops = journal.in_order(_journals(spark, sf_dir))
    cell = [F.struct("file", F.col(c).alias("cell")).alias(c) for c in ("a", "b")]
    return links.replay(ops.select("kind", *cell, "seq")).select("src.file", F.col("src.cell").alias("src"), F.col("dst.cell").alias("dst"))


@query(f"WITH {_JOURNALS} SELECT file, CASE WHEN bool_or(kind = 's') AND bool_or(kind <> 's') THEN 'mixed' WHEN bool_or(kind = 's') THEN 'content' ELSE 'dimension' END AS kind FROM j GROUP BY file")
def journal_kinds(spark, sf_dir):
    return journal_report.kinds(_journals(spark, sf_dir), ["file"])


@query(f"""WITH {_JOURNALS}, c AS (SELECT file, count(*) AS n, max(seq // 100) AS last, array_to_string(list_filter([CASE WHEN count(*) FILTER (kind = 'c') > 0 THEN 'connect=' || count(*) FILTER (kind = 'c') END,
    CASE WHEN count(*) FILTER (kind = 'd+') > 0 THEN 'disconnect(+)=' || count(*) FILTER (kind = 'd+') END, CASE WHEN count(*) FILTER (kind = 'd-') > 0 THEN 'disconnect(-)=' || count(*) FILTER (kind = 'd-') END,
    CASE WHEN count(*) FILTER (kind = 's') > 0 THEN 'set-text=' || count(*) FILTER (kind = 's') END], lambda x: x IS NOT NULL), ', ') AS t FROM j GROUP BY file),
l AS (SELECT file, 0 AS k, '1. WHAT THIS FILE IS' AS line FROM c UNION ALL SELECT file, 1, 'File        : ' || file FROM c UNION ALL SELECT file, 2, 'Blocks      : ' || last + 1 || '  (stamps 0 to ' || last || ')' FROM c UNION ALL SELECT file, 3, 'Operations  : ' || t FROM c)
SELECT row_number() OVER (ORDER BY file, k) AS number, line FROM l""")
def report_lines(spark, sf_dir):
    """The overviews of all journals, written in order by several tasks and read back."""
    ops = materialise(_journals(spark, sf_dir), "journals")
    path = shared_path(spark, "report")
    journal_text.write_lines(journal_text.overview(ops, ops.select("file")), path)
    return journal_text.read_lines(spark, path)


_FLAT = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"


@query(f"""WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN role ELSE 'user' END AS speaker, {_FLAT} AS said FROM conversations),
k AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn) = speaker THEN 0 ELSE 1 END AS ch FROM c),
u AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS utterance FROM k)
SELECT 'conv-' || conv_id AS file, utterance::BIGINT AS utterance, speaker, (min(turn) * 61)::DOUBLE AS start_s, count(*) AS n_cues, string_agg(said, ' ' ORDER BY turn) AS text FROM u GROUP BY conv_id, utterance, speaker""")
def captions_utterances(spark, sf_dir):
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\\s+", " "))
    speaker = F.when(F.col("conv_id") % 2 == 0, F.col("role")).otherwise("user")
    at = F.col("turn") * 61
    time = F.format_string("%02d:%02d:%02d.000", F.floor(at / 3600), F.floor(at % 3600 / 60), at % 60)
    cue = F.concat(F.col("turn").cast("string"), F.lit("\n"), time, F.lit(" --> 99:00:00.000\n"), speaker, F.lit(": "), said)
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("cues"))
    text = F.concat(F.lit("WEBVTT\r\n\r\n"), F.array_join(F.transform("cues", lambda c: c["cue"]), "\n\n"))
    return transcripts.utterances(transcripts.cues(rows.select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("file"), text.alias("text"))))


@query("""SELECT 'conv-' || conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS message, greatest(0, turn * 61 - 100)::DOUBLE AS t_s, role AS sender, turn % 3 = 1 AS is_private,
  CASE WHEN rtrim(string_split(coalesce(text, ''), chr(10))[1]) = '' THEN '' ELSE rtrim(string_split(coalesce(text, ''), chr(10))[1]) || substr(coalesce(text, ''), length(string_split(coalesce(text, ''), chr(10))[1]) + 1) END AS text
FROM conversations""")
def chat_messages(spark, sf_dir):
    at = F.col("turn") * 61
    time = F.format_string("%02d:%02d:%02d", F.floor(at / 3600), F.floor(at % 3600 / 60), at % 60)
    sender = F.when(F.col("turn") % 3 == 1, F.concat("role", F.lit(" to Somebody (Direct Message)"))).otherwise(F.col("role"))
    line = F.concat(time, F.lit("\t"), sender, F.lit(":\t"), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    text = F.concat(F.lit("dropped first line\n"), F.array_join(F.transform("lines", lambda c: c["line"]), "\n"))
    return transcripts.chats(rows.select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("file"), text.alias("text")), subtract_s=100.0)


def _quoted_spans(docs: DataFrame) -> DataFrame:
    second = F.when(F.col("doc_id") % 5 == 0, "missing.txt").otherwise(F.concat(F.lit("DOC-"), F.col("doc_id"), F.lit(".txt")))
    stanza = F.concat(F.lit("TYPE=quotation\nENDSET 1\nhttp://host/doc-"), F.col("doc_id"), F.lit(".txt\nSTART=10\nLENGTH=40\nENDSET 2\nhttp://host/"), second, F.lit("\nSTART=20\nLENGTH=40\n"))
    sources = docs.select(F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    return transcripts.extract_spans(transcripts.spans(docs.select(F.concat(F.lit("link-"), F.col("doc_id")).alias("file"), stanza.alias("text"))), sources)


@query("""WITH s AS (SELECT doc_id, text, endset, CASE WHEN text IS NULL OR endset = 2 AND doc_id % 5 = 0 THEN 'source not found' WHEN 10 * endset + 40 > strlen(text) THEN 'span outside source' END AS problem
FROM documents, (SELECT unnest([1, 2]) AS endset))
SELECT 'link-' || doc_id AS file, endset::INTEGER AS endset, 1 AS span, 10 * endset::BIGINT AS start, 40::BIGINT AS length, CASE WHEN problem IS NULL THEN substr(hex(encode(text)), 20 * endset + 1, 80) END AS quoted, problem FROM s""")
def span_quotes(spark, sf_dir):
    """Of every document, as hex; short ones give their problem."""
    found = _quoted_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("file", "endset", "span", "start", "length", F.hex("bytes").alias("quoted"), "problem")


@query("""WITH e AS (SELECT o_custkey, o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders)
SELECT 'owner-' || o_custkey AS owner, 'd1' AS dim, src::VARCHAR AS src, dst::VARCHAR AS dst FROM e WHERE dst IS NOT NULL""")
def snapshot_edges(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("owner-"), F.col("o_custkey")).alias("ownerId"), F.col("o_orderkey").cast("string").alias("cellId"), F.lit("d1").alias("dimensionId"), F.lag("o_orderkey").over(w).cast("string").alias("negwardId"), F.lead("o_orderkey").over(w).cast("string").alias("poswardId"))
    cells = rows.select("ownerId", F.col("cellId").alias("id"), F.lit("plain").alias("kind"))
    dims = rows.select("ownerId", F.lit("d1").alias("id"), F.lit("user").alias("namespace"), F.lit("next").alias("name")).distinct()
    revisions = rows.groupBy("ownerId").agg(F.count("*").alias("revision"))
    told = nested.snapshot_json(cells, dims, rows, revisions).select(F.from_json("json", nested.SNAPSHOT).alias("s"))
    return nested.mirrored(told.select(F.col("s.ownerId").alias("ownerId"), F.inline("s.connections")))


@query("SELECT user_id, count(*) AS length, sum(strlen(props))::BIGINT AS byte_length FROM events GROUP BY user_id")
def log_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema.simpleString()[7:-1].replace(":", " ")
    stream = logs.open_log(spark, "parquet", sf_dir, schema, glob="events.parquet")
    return logs.lengths(logs.replicated(spark, stream), ["user_id"], "props")


@query("""WITH l AS (SELECT *, lag(ts) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum((p IS NULL OR epoch_us(ts) - epoch_us(p) >= 1800000000)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l)
SELECT user_id::VARCHAR AS "user", min(event_id) AS first_event, count(*) AS n_events, string_agg(event_type, '>' ORDER BY event_id) AS path FROM n GROUP BY user_id, k
HAVING epoch_us(max(ts)) + 1800000000 <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events)""")
def session_paths(spark, sf_dir):
    """Sessions of the events as a stream, with their paths in the order of event ids (the logical clock): those closed an hour before the last event."""
    schema = table(spark, sf_dir, "events").schema.simpleString()[7:-1].replace(":", " ")
    rows = logs.open_log(spark, "parquet", sf_dir, schema, glob="events.parquet")
    out = shared_path(spark, "sessions")
    sessions.follow(rows.select("event_id", F.col("user_id").cast("string").alias("user"), F.concat_ws("|", "event_type", "event_id").alias("node"), F.col("event_id").alias("clock"), F.col("ts").cast("timestamp").alias("at")), f"{out}/sessions", f"{out}/checkpoint")
    told = spark.read.parquet(f"{out}/sessions")
    first = F.substring_index(F.get("path", 0), "|", -1).cast("long")
    return told.select("user", first.alias("first_event"), "n_events", F.array_join(F.transform("path", lambda p: F.substring_index(p, "|", 1)), ">").alias("path"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_different FROM events GROUP BY 1")
def log_subscribed(spark, sf_dir):
    """Every block of the log through a subscriber that files each batch under its number."""
    schema = table(spark, sf_dir, "events").schema.simpleString()[7:-1].replace(":", " ")
    out = shared_path(spark, "subscribed")
    logs.subscribe(logs.open_log(spark, "parquet", sf_dir, schema, glob="events.parquet"), lambda blocks, batch: blocks.write.mode("overwrite").parquet(f"{out}/blocks/batch={batch}"), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/blocks").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_different"))


@query("""SELECT s_nationkey::VARCHAR AS owner, count(*) AS revision, s_suppkey::VARCHAR AS cell, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::VARCHAR AS next FROM supplier GROUP BY s_nationkey, s_suppkey""".replace("count(*) AS revision", "sum(count(*)) OVER (PARTITION BY s_nationkey)::BIGINT AS revision"))
def snapshot_files(spark, sf_dir):
    """A structure of each nation's suppliers, one file an owner, written and read back."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    names = [F.col("s_suppkey").cast("string").alias("cellId"), F.lit("d1").alias("dimensionId"), F.lag("s_suppkey").over(w).cast("string").alias("negwardId"), F.lead("s_suppkey").over(w).cast("string").alias("poswardId")]
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("ownerId"), *names)
    cells = rows.select("ownerId", F.col("cellId").alias("id"), F.lit("plain").alias("kind"))
    dims = rows.select("ownerId", F.lit("d1").alias("id"), F.lit("user").alias("namespace"), F.lit("next").alias("name")).distinct()
    path = shared_path(spark, "structures")
    nested.write_snapshots(nested.snapshot_json(cells, dims, rows, rows.groupBy("ownerId").agg(F.count("*").alias("revision"))), path)
    read = nested.read_snapshots(spark, f"{path}/*/*")["connections"]
    return read.select(F.col("ownerId").alias("owner"), "revision", F.col("cellId").alias("cell"), F.col("poswardId").alias("next"))


@query("""SELECT id, arg_max(c_custkey, c_custkey)::VARCHAR AS handle FROM (SELECT c_custkey, (c_custkey // 3)::VARCHAR AS id FROM customer) GROUP BY id""")
def last_users(spark, sf_dir):
    """Every nation's customers as a user file in which three share an id; the last one of the last file counts."""
    key = F.format_string("%012d", "c_custkey")
    one = F.struct(F.floor(F.col("c_custkey") / 3).cast("string").alias("id"), F.col("c_custkey").cast("string").alias("handle"))
    files = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 1000).alias("part")).agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), one.alias("u")))).alias("us"))
    text = F.to_json(F.struct(F.transform("us", lambda x: x["u"]).alias("users")))
    return nested.users(files.select(F.format_string("users-%09d", "part").alias("file"), text.alias("text"))).select("id", "handle")


# Numbering of nested heads, and sketches of note streams


def _section_numbers(lines: DataFrame) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    heads = lines.withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long"))
    heads = heads.select("l_orderkey", *order, "seq", F.when(F.col("seq") == 1, 0).otherwise(F.col("l_quantity").cast("int") % 3).alias("level"))
    return islands.number_heads(heads, ["l_orderkey"], order, "level", 3).select("l_orderkey", "seq", "number")


@query("""WITH h AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_quantity::INTEGER % 3 AS raw FROM lineitem),
l AS (SELECT *, CASE WHEN seq = 1 THEN 0 ELSE raw END AS level FROM h),
a AS (SELECT *, sum((level = 0)::INT) OVER (PARTITION BY l_orderkey ORDER BY seq) AS n0 FROM l),
b AS (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY l_orderkey, n0 ORDER BY seq) AS n1 FROM a),
c AS (SELECT *, sum((level = 2)::INT) OVER (PARTITION BY l_orderkey, n0, n1 ORDER BY seq) AS n2 FROM b)
SELECT l_orderkey, seq::BIGINT AS seq, CASE level WHEN 0 THEN n0::VARCHAR WHEN 1 THEN n0 || '.' || n1 ELSE n0 || '.' || n1 || '.' || n2 END AS number FROM c""")
def section_numbers(spark, sf_dir):
    """The heads of every order."""
    return _section_numbers(table(spark, sf_dir, "lineitem"))


_NOTES = """n AS (SELECT event_id, user_id, ts, floor(value)::BIGINT % 12 AS pitch, event_type = 'click' AS is_on FROM events WHERE event_type IN ('click', 'view')),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, pitch, is_on ORDER BY ts, event_id) AS k FROM n)"""


@query(f"""WITH {_NOTES} SELECT a.event_id AS on_id, b.event_id AS off_id, a.user_id, a.pitch FROM (SELECT * FROM s WHERE is_on) a
LEFT JOIN (SELECT * FROM s WHERE NOT is_on) b ON b.user_id = a.user_id AND b.pitch = a.pitch AND b.k = a.k""")
def note_pairs_fifo(spark, sf_dir):
    rows = events(spark, sf_dir, "click", "view").select("event_id", "user_id", "ts", (F.floor("value").cast("long") % 12).alias("pitch"), (F.col("event_type") == "click").alias("is_on"))
    return islands.pair_in_order(rows, ["user_id", "pitch"], ["ts", "event_id"], F.col("is_on"), "event_id", "on_id", "off_id").select("on_id", "off_id", "user_id", "pitch")


@query(f"WITH {_NOTES} SELECT user_id, min(pitch) AS lowest, max(pitch) AS highest, count(*) AS n_notes FROM n WHERE is_on GROUP BY GROUPING SETS ((user_id), ())")
def note_ranges(spark, sf_dir):
    """Of every user, and over all."""
    rows = events(spark, sf_dir, "click").select("user_id", (F.floor("value").cast("long") % 12).alias("pitch"))
    whole = notes.ranges(rows, [], "pitch").select(F.lit(None).cast(dict(rows.dtypes)["user_id"]).alias("user_id"), "lowest", "highest", "n_notes")
    return notes.ranges(rows, ["user_id"], "pitch").union(whole)


@query("""WITH t AS (SELECT event_id, user_id, ts, event_id % 97 AS delta FROM events)
SELECT event_id, user_id, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS tick FROM t""")
def absolute_ticks(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("delta", F.col("event_id") % 97)
    return notes.ticks(rows, ["user_id"], ["ts", "event_id"], "delta").select("event_id", "user_id", "tick")


@query("""WITH o AS (SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'c' WHEN 'error' THEN 'd+' WHEN 'signup' THEN 'd-' ELSE 's' END AS kind, user_id AS a,
  CASE WHEN event_type = 'click' THEN floor(value)::BIGINT % 150 END AS b FROM events),
f AS (SELECT a AS cell, seq, CASE kind WHEN 'c' THEN b END AS other FROM o WHERE kind IN ('c', 'd+')),
g AS (SELECT CASE kind WHEN 'c' THEN b ELSE a END AS cell, seq, CASE kind WHEN 'c' THEN a END AS other FROM o WHERE kind IN ('c', 'd-')),
n1 AS (SELECT f.seq AS op, p.other, p.seq AS link FROM f ASOF JOIN f p ON p.cell = f.cell AND p.seq < f.seq WHERE p.other IS NOT NULL),
n2 AS (SELECT op, n1.other AS had_next FROM n1 ASOF JOIN g ON g.cell = n1.other AND g.seq < n1.op WHERE g.seq = link),
m1 AS (SELECT g.seq AS op, p.other, p.seq AS link FROM g ASOF JOIN g p ON p.cell = g.cell AND p.seq < g.seq WHERE p.other IS NOT NULL),
m2 AS (SELECT op, m1.other AS had_prev FROM m1 ASOF JOIN f ON f.cell = m1.other AND f.seq < m1.op WHERE f.seq = link),
j AS (SELECT o.*, had_next, had_prev, kind = 'c' AND had_next IS NOT DISTINCT FROM b AS same FROM o LEFT JOIN n2 ON n2.op = seq LEFT JOIN m2 ON m2.op = seq)
SELECT seq, kind, a, b, CASE WHEN kind = 's' THEN 'text' WHEN same THEN 'noop' WHEN kind = 'c' THEN 'link' WHEN had_next IS NOT NULL OR had_prev IS NOT NULL THEN 'unlink' ELSE 'noop' END AS outcome,
  CASE WHEN NOT same THEN had_next END AS detached_next, CASE WHEN NOT same THEN had_prev END AS detached_prev FROM j""")
def replay_narration(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "c").when(F.col("event_type") == "error", "d+").when(F.col("event_type") == "signup", "d-").otherwise("s")
    target = F.when(F.col("event_type") == "click", F.floor("value").cast("long") % 150)
    return links.narrate(events(spark, sf_dir).select(kind.alias("kind"), F.col("user_id").alias("a"), target.alias("b"), F.col("event_id").alias("seq")))


@query("""SELECT user_id, event_id, hidden FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, greatest(count(*) OVER (PARTITION BY user_id) - 12, 0)::BIGINT AS hidden FROM events) WHERE rn <= 12""")
def top_per_block(spark, sf_dir):
    return facts.top_per_group(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 12).select("user_id", "event_id", "hidden")


@query("""SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(s_name, c_name) AS name, coalesce(s_acctbal, c_acctbal) AS balance
FROM customer FULL JOIN (SELECT s_suppkey + 100 AS s_suppkey, s_name, s_acctbal FROM supplier) ON s_suppkey = c_custkey""")
def registry_upsert(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    patch = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100).alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return facts.upsert(base, patch, "key")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Basic x' ELSE 'bearer  u' || o_custkey END AS header, 'u' || (o_custkey + o_orderkey % 3 - 1) AS owner, o_orderkey % 2 = 0 AS w,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'u' || o_custkey END AS caller FROM orders),
u AS (SELECT 'u' || c_custkey AS id FROM customer WHERE c_custkey % 11 <> 0)
SELECT o_orderkey, CASE WHEN caller IS NULL OR caller NOT IN (SELECT id FROM u) THEN 401 WHEN owner NOT IN (SELECT id FROM u) THEN 404 WHEN w AND caller <> owner THEN 403 ELSE 200 END AS status FROM r""")
def access_chain(spark, sf_dir):
    user = F.concat(F.lit("u"), F.col("o_custkey"))
    header = F.when(F.col("o_orderkey") % 7 == 0, "Basic x").otherwise(F.concat(F.lit("bearer  "), user))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", header.alias("header"), F.concat(F.lit("u"), F.col("o_custkey") + F.col("o_orderkey") % 3 - 1).alias("owner"))
    users = table(spark, sf_dir, "customer").filter("c_custkey % 11 <> 0").select(F.concat(F.lit("u"), F.col("c_custkey")).alias("user"))
    return facts.access_status(asked, users, users.withColumnRenamed("user", "owner"), F.col("o_orderkey") % 2 == 0).select("o_orderkey", "status")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'corrupted' ELSE 'verified' END AS state FROM documents""")
def content_verified(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    expected = docs.filter("doc_id % 3 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return facts.verified(docs, expected, "doc_id", "text", "digest")


@query("""WITH t AS (SELECT user_id, event_id AS tick, floor(value)::BIGINT % 100 AS rate FROM events WHERE event_type = 'signup'),
b AS (SELECT *, coalesce(sum(rate * d) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
      FROM (SELECT *, lead(tick) OVER (PARTITION BY user_id ORDER BY tick) - tick AS d FROM t))
SELECT e.event_id, e.user_id, (base + (e.event_id - tick) * rate)::BIGINT AS at FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN b ON b.user_id = e.user_id AND e.event_id >= b.tick""")
def tempo_map(spark, sf_dir):
    rate = (F.floor("value").cast("long") % 100).alias("rate")
    marks = notes.tempo_map(events(spark, sf_dir, "signup").select("user_id", "event_id", rate, F.col("event_id").alias("tick")), ["user_id"], "tick", "rate")
    clicks = events(spark, sf_dir, "click").select("user_id", "event_id", F.col("event_id").alias("tick"))
    return notes.at_times(clicks, marks, ["user_id"], "tick", "rate", "event_id").select("event_id", "user_id", "at")
