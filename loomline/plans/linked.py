"""Queries on linked-cell structures, journal reports, movements and clocks, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators import chunks, clocks, facts, journal_report, journal_text, links, store, versions
from loomline.plans.registry import events, query, table
from loomline.sources import cellstore, documents
from loomline.storage import materialise, shared_path

# Structures

_FRESH = """f(dim, src, dst) AS (VALUES ('d.dimensions', 'cell:d.dimensions', 'cell:d.namespaces'), ('d.dimensions', 'cell:d.namespaces', 'cell:d.namespace-members'),
  ('d.dimensions', 'cell:d.namespace-members', 'cell:d.namespace-siblings'), ('d.dimensions', 'cell:d.namespace-siblings', 'cell:d.views'), ('d.dimensions', 'cell:d.views', 'cell:d.clones'),
  ('d.dimensions', 'cell:d.clones', 'cell:d.user-views'), ('d.dimensions', 'cell:d.user-views', 'cell:d.dimensions'), ('d.namespace-members', 'head:d', 'cell:d.dimensions'),
  ('d.namespace-siblings', 'cell:d.dimensions', 'cell:d.namespaces'), ('d.namespace-siblings', 'cell:d.namespaces', 'cell:d.namespace-members'),
  ('d.namespace-siblings', 'cell:d.namespace-members', 'cell:d.namespace-siblings'), ('d.namespace-siblings', 'cell:d.namespace-siblings', 'cell:d.views'),
  ('d.namespace-siblings', 'cell:d.views', 'cell:d.clones'), ('d.namespace-siblings', 'cell:d.clones', 'cell:d.user-views'), ('d.views', 'h-view', 'i-view'),
  ('d.clones', 'h-view', 'h-clone'), ('d.clones', 'i-view', 'i-clone'), ('d.user-views', 'h-clone', 'i-clone'))"""


@query(f"""WITH {_FRESH}, e AS (SELECT dim, src AS cell, NULL AS negward, dst AS posward FROM f UNION ALL SELECT dim, dst, src, NULL FROM f)
SELECT s_suppkey::VARCHAR AS owner, dim, cell, max(negward) AS negward, max(posward) AS posward FROM e, supplier GROUP BY s_suppkey, dim, cell""")
def bootstrap_records(spark, sf_dir):
    """24 records for each supplier's fresh structure."""
    return store.records(store.bootstrap(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("owner")))["links"])


@query("""WITH RECURSIVE q AS (SELECT user_id AS owner, event_id AS seq, CASE WHEN event_id % 50 = 0 THEN 'd.z' WHEN event_id % 2 = 0 THEN 'd.x' ELSE 'd.y' END AS dim, (floor(value)::BIGINT % 12)::VARCHAR AS a, (event_id % 12)::VARCHAR AS b FROM events),
c AS (SELECT *, CASE WHEN a = b THEN 'self_link_forbidden' WHEN a = '11' OR b = '11' THEN 'unknown_cell' WHEN dim = 'd.z' THEN 'unknown_dimension' END AS early FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY owner, dim ORDER BY seq) AS k FROM c WHERE early IS NULL),
s(owner, dim, k, xs, ys, pairs, seq, status) AS (SELECT owner, dim, 0::BIGINT, CASE WHEN dim = 'd.x' THEN ['0'] ELSE []::VARCHAR[] END, CASE WHEN dim = 'd.x' THEN ['1'] ELSE []::VARCHAR[] END, CASE WHEN dim = 'd.x' THEN ['0>1'] ELSE []::VARCHAR[] END, NULL::BIGINT, NULL::VARCHAR FROM (SELECT DISTINCT owner, dim FROM n)
  UNION ALL SELECT s.owner, s.dim, n.k, CASE WHEN free THEN list_append(xs, n.a) ELSE xs END, CASE WHEN free THEN list_append(ys, n.b) ELSE ys END, CASE WHEN free THEN list_append(pairs, n.a || '>' || n.b) ELSE pairs END, n.seq,
    CASE WHEN free OR list_contains(pairs, n.a || '>' || n.b) THEN 'ok' ELSE 'restriction_r_violation' END
  FROM s JOIN n ON n.owner = s.owner AND n.dim = s.dim AND n.k = s.k + 1, LATERAL (SELECT NOT list_contains(s.xs, n.a) AND NOT list_contains(s.ys, n.b) AS free))
SELECT owner, seq, early AS status FROM c WHERE early IS NOT NULL UNION ALL SELECT owner, seq, status FROM s WHERE seq IS NOT NULL""")
def link_requests(spark, sf_dir):
    """Every event asks for a link between two of eleven cells of its user; on one dimension 0 and 1 are linked before."""
    dim = F.when(F.col("event_id") % 50 == 0, "d.z").when(F.col("event_id") % 2 == 0, "d.x").otherwise("d.y")
    asked = events(spark, sf_dir).select(F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), dim.alias("dim"), (F.floor("value").cast("long") % 12).cast("string").alias("a"), (F.col("event_id") % 12).cast("string").alias("b"))
    owners = asked.select("owner").distinct()
    cells = owners.select("owner", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("cell")).withColumn("cell", F.col("cell").cast("string"))
    dims = owners.select("owner", F.explode(F.array(F.lit("d.x"), F.lit("d.y"))).alias("dim"))
    there = owners.select("owner", F.lit("d.x").alias("dim"), F.lit("0").alias("src"), F.lit("1").alias("dst"))
    return store.link(asked, cells, dims, there).select("owner", "seq", "status")


def _chain(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))
    return rows.select(F.col("o_custkey").alias("owner"), F.lit("d1").alias("dim"), F.col("o_orderkey").alias("src"), F.col("after").alias("dst"), "before")


_NEXT = "n AS (SELECT o_custkey AS owner, o_orderkey AS src, lead(o_orderkey) OVER w AS dst, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


@query(f"""WITH {_NEXT} SELECT 2 * src + t AS seq, CASE WHEN t = 0 AND dst IS NOT NULL AND src % 5 <> 0 THEN 'ok' ELSE 'no_such_connection' END AS status
FROM n, (SELECT unnest([0, 1]) AS t) WHERE t = 0 OR src % 3 = 0""")
def unlink_requests(spark, sf_dir):
    """Every order asks to be unlinked from the next of its customer, some twice, some from themselves."""
    chain = _chain(spark, sf_dir)
    target = F.when(F.col("src") % 5 == 0, F.col("src")).otherwise(F.coalesce("dst", F.lit(-1)))
    tries = F.explode(F.when(F.col("src") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    asked = chain.select("owner", "dim", F.col("src").alias("a"), target.alias("b"), tries.alias("t")).withColumn("seq", 2 * F.col("a") + F.col("t")).drop("t")
    told, _ = store.unlink(asked, chain.filter("dst IS NOT NULL").select("owner", "dim", "src", "dst"))
    return told.select("seq", "status")


@query("""WITH RECURSIVE i AS (SELECT o_custkey AS owner, -o_orderkey AS s, o_orderkey AS b, CASE WHEN o_orderkey % 3 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS a FROM orders),
r AS (SELECT owner, b, [s] AS path FROM i WHERE a IS NULL UNION ALL SELECT i.owner, i.b, list_append(path, s) FROM r JOIN i ON i.owner = r.owner AND i.a = r.b),
p AS (SELECT owner, 'o' || b AS cell, path FROM r UNION ALL SELECT DISTINCT o_custkey, 'c' || o_custkey, []::BIGINT[] FROM orders),
l AS (SELECT owner, cell AS src, lead(cell) OVER (PARTITION BY owner ORDER BY path) AS dst FROM p)
SELECT owner, src, coalesce(dst, 'old' || owner) AS dst FROM l UNION ALL SELECT c_custkey, 'c' || c_custkey, 'old' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def clone_chains(spark, sf_dir):
    """Every order is a clone, put right after its customer's cell or after the order before it; before that, one old cell followed."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = orders.withColumn("before", F.when(F.col("o_orderkey") % 3 == 0, before))
    after = F.coalesce(F.concat(F.lit("o"), F.col("before")), F.concat(F.lit("c"), F.col("o_custkey")))
    inserts = orders.select(F.col("o_custkey").alias("owner"), F.lit(store.CLONES).alias("dim"), F.col("o_orderkey").alias("seq"), after.alias("a"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("b"))
    there = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.lit(store.CLONES).alias("dim"), F.concat(F.lit("c"), F.col("c_custkey")).alias("src"), F.concat(F.lit("old"), F.col("c_custkey")).alias("dst"))
    return store.splice(there, inserts)[1].select("owner", "src", "dst")


@query("""WITH RECURSIVE q AS (SELECT o_custkey AS owner, o_orderkey AS seq, o_orderkey % 7 AS a, o_orderkey // 7 % 7 AS b, o_orderkey % 3 > 0 AS splice, o_orderkey % 2 = 0 AS ring FROM orders),
c AS (SELECT *, CASE WHEN a = b AND NOT ring THEN 'self_link_forbidden' WHEN a = 6 OR b = 6 THEN 'unknown_cell' END AS early FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seq) AS k FROM c WHERE early IS NULL),
s(owner, k, links, seq, status) AS (SELECT DISTINCT owner, 0::BIGINT, [{'s': 0::BIGINT, 'd': 1::BIGINT}], NULL::BIGINT, NULL::VARCHAR FROM n
  UNION ALL SELECT s.owner, n.k,
    CASE WHEN same OR NOT free THEN links WHEN nxt IS NULL THEN list_append(links, {'s': n.a, 'd': n.b})
         ELSE list_concat(list_filter(links, lambda x: x.s <> n.a), [{'s': n.a, 'd': n.b}, {'s': n.b, 'd': nxt}]) END,
    n.seq, CASE WHEN same OR free THEN 'ok' WHEN n.splice THEN 'already_linked' ELSE 'restriction_r_violation' END
  FROM s JOIN n ON n.owner = s.owner AND n.k = s.k + 1,
    LATERAL (SELECT list_filter(links, lambda x: x.s = n.a)[1].d AS nxt, len(list_filter(links, lambda x: x.d = n.b)) AS before, len(list_filter(links, lambda x: x.s = n.b)) AS behind),
    LATERAL (SELECT coalesce(nxt = n.b, false) AS same, before = 0 AND (nxt IS NULL OR (n.splice AND behind = 0)) AS free)),
e AS (SELECT owner, arg_max(links, k) AS links FROM s GROUP BY owner)
SELECT owner, seq, early AS status, NULL::BIGINT AS src, NULL::BIGINT AS dst FROM c WHERE early IS NOT NULL
UNION ALL SELECT owner, seq, status, NULL, NULL FROM s WHERE seq IS NOT NULL UNION ALL SELECT owner, NULL, NULL, x.s, x.d FROM (SELECT owner, unnest(links) AS x FROM e)""")
def splice_requests(spark, sf_dir):
    """Every order asks its customer's structure for a link between two of six cells (two in three as a splice, half with self-rings), and the links in the end."""
    key = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), key.alias("seq"), F.lit("d").alias("dim"), (key % 7).alias("a"), (F.floor(key / 7) % 7).alias("b"), (key % 3 > 0).alias("splice"), (key % 2 == 0).alias("allow_self_ring"))
    owners = asked.select("owner").distinct()
    cells = owners.select("owner", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")).alias("cell"))
    known = asked.filter(~((F.col("a") == F.col("b")) & ~F.col("allow_self_ring")) & (F.col("a") < 6) & (F.col("b") < 6)).select("owner").distinct()
    there = known.select("owner", F.lit("d").alias("dim"), F.lit(0).cast("long").alias("src"), F.lit(1).cast("long").alias("dst"))
    told, after = store.apply_links(asked, cells, owners.select("owner", F.lit("d").alias("dim")), there)
    none = F.lit(None)
    return told.select("owner", "seq", "status", none.cast("long").alias("src"), none.cast("long").alias("dst")).union(after.select("owner", none.cast("long"), none.cast("string"), "src", "dst"))


@query("""WITH q AS (SELECT o_custkey AS owner, o_orderkey AS seq, CASE WHEN o_orderpriority = '1-URGENT' THEN 'gone' ELSE 'c' || o_custkey END AS of, 'k' || o_orderkey AS clone FROM orders),
g AS (SELECT *, lag(clone) OVER (PARTITION BY owner ORDER BY seq) AS before, lead(clone) OVER (PARTITION BY owner ORDER BY seq) AS later FROM q WHERE of <> 'gone')
SELECT owner, seq, CASE WHEN of = 'gone' THEN 'unknown_cell' ELSE 'ok' END AS status, NULL AS src, NULL AS dst FROM q
UNION ALL SELECT owner, NULL, NULL, of, clone FROM g WHERE later IS NULL UNION ALL SELECT owner, NULL, NULL, clone, before FROM g WHERE before IS NOT NULL""")
def made_clones(spark, sf_dir):
    """Every order asks for a clone of its customer's cell, urgent ones for that of a cell that isn't there."""
    orders = table(spark, sf_dir, "orders")
    of = F.when(F.col("o_orderpriority") == "1-URGENT", "gone").otherwise(F.concat(F.lit("c"), F.col("o_custkey")))
    asked = orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("seq"), of.alias("of"), F.concat(F.lit("k"), F.col("o_orderkey")).alias("clone"))
    cells = orders.select(F.col("o_custkey").alias("owner"), F.concat(F.lit("c"), F.col("o_custkey")).alias("cell")).distinct()
    none = spark.createDataFrame([], "owner long, dim string, src string, dst string").select(F.col("owner").cast(dict(asked.dtypes)["owner"]).alias("owner"), "dim", "src", "dst")
    told, _, after = store.make_clones(asked, cells, none)
    null = F.lit(None)
    return told.select("owner", "seq", "status", null.cast("string").alias("src"), null.cast("string").alias("dst")).union(after.select("owner", null.cast("long"), null.cast("string"), "src", "dst"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, coalesce(p_size::VARCHAR, '?') AS number FROM lineitem LEFT JOIN part ON p_partkey + 40 = l_partkey""")
def label_numbers(spark, sf_dir):
    """Every line refers to a part by a label; labels are numbered 40 above the parts, so the first have none."""
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_partkey").cast("string").alias("ref"))
    labels = table(spark, sf_dir, "part").select((F.col("p_partkey") + 40).cast("string").alias("label"), F.col("p_size").cast("string").alias("number"))
    return facts.label_refs(refs, labels, "ref")[0].select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "number")


@query("""SELECT event_id, coalesce(c_mktsegment, CASE WHEN event_type = 'error' THEN 'part of a name' ELSE 'unknown' END) AS meaning FROM events LEFT JOIN customer ON c_custkey = user_id AND event_type <> 'error'""")
def described_names(spark, sf_dir):
    """Names of dimensions (every user's), with a colon for errors, and what a glossary of customers says of them."""
    name = F.when(F.col("event_type") == "error", F.concat(F.lit("n:"), F.col("user_id"))).otherwise(F.concat(F.lit("n"), F.col("user_id")))
    glossary = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_custkey")).alias("name"), F.col("c_mktsegment").alias("meaning"))
    return journal_report.described(events(spark, sf_dir).select("event_id", name.alias("name")), "name", glossary, "part of a name", "unknown").select("event_id", "meaning")


@query(f"""WITH {_FRESH}, q AS (SELECT n_regionkey::VARCHAR AS owner, n_nationkey AS seq, 'n' || n_nationkey % 2 AS ns, substr(n_name, 1, 1) AS name FROM nation),
g AS (SELECT *, 'cell:' || ns || '.' || name AS cell FROM q QUALIFY row_number() OVER (PARTITION BY owner, ns, name ORDER BY seq) = 1),
r AS (SELECT owner, cell, lag(cell) OVER (PARTITION BY owner ORDER BY seq) AS prev, lead(cell) OVER (PARTITION BY owner ORDER BY seq) AS next, lag(cell) OVER (PARTITION BY owner, ns ORDER BY seq) AS sibling, ns FROM g)
SELECT owner, dim, src, dst FROM f, (SELECT DISTINCT owner FROM q) WHERE NOT (dim = 'd.dimensions' AND dst = 'cell:d.dimensions')
UNION ALL SELECT owner, 'd.dimensions', coalesce(prev, 'cell:d.user-views'), cell FROM r UNION ALL SELECT owner, 'd.dimensions', cell, 'cell:d.dimensions' FROM r WHERE next IS NULL
UNION ALL SELECT owner, CASE WHEN sibling IS NULL THEN 'd.namespace-members' ELSE 'd.namespace-siblings' END, coalesce(sibling, 'head:' || ns), cell FROM r""")
def dimension_chains(spark, sf_dir):
    """Dimensions named by nations are added to their regions' fresh structures; some names come twice."""
    asked = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("owner"), F.col("n_nationkey").alias("seq"), F.concat(F.lit("n"), F.col("n_nationkey") % 2).alias("namespace"), F.substring("n_name", 1, 1).alias("name"))
    fresh = store.bootstrap(asked.select("owner"))
    return store.add_dimensions(asked, fresh["dimensions"], fresh["links"])[1]


@query(f"WITH {_NEXT} SELECT owner, src, dst FROM n WHERE dst IS NOT NULL AND NOT (dst % 4 = 0 AND src % 6 = 0)")
def mirror_repair(spark, sf_dir):
    """Records of which every fourth lacks its negward and every sixth its posward half."""
    halves = _chain(spark, sf_dir).select("owner", "dim", F.col("src").alias("cell"), F.when(F.col("src") % 4 != 0, F.col("before")).alias("negward"), F.when(F.col("src") % 6 != 0, F.col("dst")).alias("posward"), F.col("src").alias("place"))
    return store.repair_mirrors(halves).select("owner", "src", "dst")


@query("""WITH q AS (SELECT o_custkey AS owner, o_orderkey AS seq, 1 + o_orderkey % (2 * (SELECT count(*) FROM customer)) AS k FROM orders)
SELECT seq, CASE WHEN k NOT IN (SELECT c_custkey FROM customer) THEN 'foreign_cell_not_found' WHEN k = owner OR row_number() OVER (PARTITION BY owner, k ORDER BY seq) > 1 THEN 'present' ELSE 'imported' END AS status FROM q""")
def foreign_cells(spark, sf_dir):
    """Every order imports a cell of some customer, half of whom aren't there."""
    customers = table(spark, sf_dir, "customer")
    cells = customers.select(F.col("c_custkey").alias("owner"), F.concat(F.lit("k"), F.col("c_custkey")).alias("cell"), F.lit("plain").alias("kind"))
    from_owner = 1 + F.col("o_orderkey") % (2 * customers.count())
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("seq"), from_owner.alias("from_owner"), F.concat(F.lit("k"), from_owner).alias("cell"))
    return store.import_foreign(asked, cells)[0].select("seq", "status")


@query(f"""WITH {_NEXT}, d AS (SELECT src AS cell, 'd' || owner % 3 AS dim, before IS NULL AND dst IS NULL AS bare FROM n)
SELECT cell, dim, true AS unlinked_too FROM d WHERE dim <> 'd0' UNION ALL SELECT cell, dim, false FROM d WHERE dim <> 'd0' AND NOT bare""")
def dimensions_present(spark, sf_dir):
    rows = _chain(spark, sf_dir).select("owner", F.concat(F.lit("d"), F.col("owner") % 3).alias("dim"), F.col("src").alias("cell"), F.col("before").alias("negward"), F.col("dst").alias("posward"))
    dims = rows.select("owner", "dim").distinct().filter("dim <> 'd0'")
    told = [store.dimensions_present(dims, rows, include).select("cell", "dim", F.lit(include).alias("unlinked_too")) for include in (True, False)]
    return told[0].union(told[1])


@query("""SELECT DISTINCT first_value(o_orderkey) OVER w AS head, last_value(o_orderkey) OVER w AS last, false AS is_circular FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def rank_ends(spark, sf_dir):
    chain = _chain(spark, sf_dir)
    return store.rank_ends(links.ranks(chain.filter("dst IS NOT NULL").select("src", "dst"), chain.select(F.col("src").alias("node")))).select("head", "last", "is_circular")


# Journals

_TEXTS = """o AS (SELECT user_id AS file, event_id // 20 AS block_idx, event_id % 20 AS op_idx, event_id AS stamp, CASE event_type WHEN 'click' THEN 'c' WHEN 'error' THEN 'd+' WHEN 'signup' THEN 'd-' ELSE 's' END AS kind,
  CASE WHEN floor(value)::BIGINT % 15 = 0 THEN 'savetime' ELSE (floor(value)::BIGINT % 40)::VARCHAR END AS a, CASE WHEN floor(value)::BIGINT % 15 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'x' ELSE event_id::VARCHAR END WHEN event_id % 11 = 0 THEN '' ELSE 't' || event_id END AS b FROM events)"""


def _text_ops(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "c").when(F.col("event_type") == "error", "d+").when(F.col("event_type") == "signup", "d-").otherwise("s")
    n, mark = F.floor("value").cast("long"), F.floor("value").cast("long") % 15 == 0
    saved = F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("event_id").cast("string"))
    text = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("t"), F.col("event_id")))
    return events(spark, sf_dir).select(F.col("user_id").alias("file"), F.floor(F.col("event_id") / 20).cast("int").alias("block_idx"), (F.col("event_id") % 20).cast("int").alias("op_idx"), F.col("event_id").alias("stamp"), kind.alias("kind"), F.when(mark, "savetime").otherwise((n % 40).cast("string")).alias("a"), F.when(mark, saved).otherwise(text).alias("b"))


@query(f"""WITH {_TEXTS}, s AS (SELECT * FROM o WHERE kind = 's'), t AS (SELECT file, a, arg_max(b, stamp) AS b FROM s GROUP BY file, a),
m AS (SELECT file, count(*) AS n_saves, arg_min(b, stamp) AS first_saved, arg_max(b, stamp) AS last_saved FROM s WHERE a = 'savetime' GROUP BY file)
SELECT t.file, count(*) FILTER (a <> 'savetime') AS n_cells, count(*) FILTER (a <> 'savetime' AND b = '') AS n_empty, count(*) FILTER (a = 'savetime') AS n_keys, coalesce(any_value(n_saves), 0) AS n_saves, any_value(first_saved) AS first_saved, any_value(last_saved) AS last_saved
FROM t LEFT JOIN m ON m.file = t.file GROUP BY t.file""")
def text_counts(spark, sf_dir):
    return journal_report.text_counts(_text_ops(spark, sf_dir))


@query(f"""WITH {_TEXTS}, m AS (SELECT file, stamp, b::BIGINT AS saved FROM o WHERE kind = 's' AND a = 'savetime' AND b <> 'x')
SELECT o.file, o.stamp, m.saved FROM (SELECT * FROM o WHERE kind = 'c') o ASOF LEFT JOIN m ON m.file = o.file AND o.stamp <= m.stamp""")
def saved_after(spark, sf_dir):
    """The first save at or after each connecting op."""
    ops = _text_ops(spark, sf_dir)
    return journal_report.saved_after(ops.filter("kind = 'c'").select("file", "stamp", F.col("op_idx").alias("tie")), journal_report.save_marks(ops), ["file"], "tie").select("file", "stamp", "saved")


@query(f"""WITH {_TEXTS}, t AS (SELECT a, arg_max(b, stamp) AS b FROM o WHERE kind = 's' AND a <> 'savetime' GROUP BY a)
SELECT c.cell, '#' || c.cell || CASE WHEN coalesce(b, '') = '' THEN ' (empty)' ELSE ' "' || b || '"' END AS label FROM (SELECT unnest(range(60))::VARCHAR AS cell) c LEFT JOIN t ON a = c.cell""")
def cell_labels(spark, sf_dir):
    ops = _text_ops(spark, sf_dir).withColumn("file", F.lit("all"))
    cells = spark.range(60).select(F.col("id").cast("string").alias("cell"))
    return journal_report.labelled(cells, journal_report.current_texts(ops).drop("file"), "cell").select("cell", "label")


@query("SELECT CASE WHEN event_id % 10 = 0 THEN '00' || event_id ELSE event_id::VARCHAR END AS cell FROM events WHERE event_id % 7 <> 0 ORDER BY event_id LIMIT 60")
def first_texts(spark, sf_dir):
    """The first sixty cells by number; keys that aren't numbers have no place among them."""
    name = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("k"), F.col("event_id"))).when(F.col("event_id") % 10 == 0, F.concat(F.lit("00"), F.col("event_id"))).otherwise(F.col("event_id").cast("string"))
    return journal_report.first_texts(events(spark, sf_dir).select(name.alias("cell")), 60)


@query("""WITH o AS (SELECT event_id, event_id // 50 AS block, CASE event_type WHEN 'click' THEN 'c' WHEN 'error' THEN 'd+' WHEN 'signup' THEN 'd-' ELSE 's' END AS kind, user_id AS a, CASE WHEN event_type = 'click' THEN floor(value)::BIGINT % 150 END AS b FROM events),
f AS (SELECT a AS cell, event_id AS seq, CASE kind WHEN 'c' THEN b END AS other FROM o WHERE kind IN ('c', 'd+')), g AS (SELECT CASE kind WHEN 'c' THEN b ELSE a END AS cell, event_id AS seq, CASE kind WHEN 'c' THEN a END AS other FROM o WHERE kind IN ('c', 'd-')),
n1 AS (SELECT f.seq AS op, p.other, p.seq AS link FROM f ASOF JOIN f p ON p.cell = f.cell AND p.seq < f.seq WHERE p.other IS NOT NULL), n2 AS (SELECT op, n1.other AS x FROM n1 ASOF JOIN g ON g.cell = n1.other AND g.seq < n1.op WHERE g.seq = link),
m1 AS (SELECT g.seq AS op, p.other, p.seq AS link FROM g ASOF JOIN g p ON p.cell = g.cell AND p.seq < g.seq WHERE p.other IS NOT NULL), m2 AS (SELECT op, m1.other AS y FROM m1 ASOF JOIN f ON f.cell = m1.other AND f.seq < m1.op WHERE f.seq = link),
j AS (SELECT o.*, x, y, kind = 'c' AND x IS NOT DISTINCT FROM b AS same FROM o LEFT JOIN n2 ON n2.op = event_id LEFT JOIN m2 ON m2.op = event_id)
SELECT block, count(*) FILTER (kind = 'c' AND NOT same) AS n_link, count(*) FILTER (kind IN ('d+', 'd-') AND (x IS NOT NULL OR y IS NOT NULL)) AS n_unlink, count(*) FILTER (kind = 'c' AND same OR kind IN ('d+', 'd-') AND x IS NULL AND y IS NULL) AS n_noop, count(*) FILTER (kind = 's') AS n_text, 0::BIGINT AS n_meta FROM j GROUP BY block""")
def block_summary(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "c").when(F.col("event_type") == "error", "d+").when(F.col("event_type") == "signup", "d-").otherwise("s")
    target = F.when(F.col("event_type") == "click", F.floor("value").cast("long") % 150)
    told = links.narrate(events(spark, sf_dir).select(kind.alias("kind"), F.col("user_id").alias("a"), target.alias("b"), F.col("event_id").alias("seq")))
    return journal_report.block_summary(told.withColumn("block", F.floor(F.col("seq") / 50)), ["block"])


# Movements and versions


@query("""SELECT event_id AS seq, user_id AS item, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_place, CASE WHEN event_id % 4 = 0 THEN 'loaned-out' ELSE 'relocated' END AS reason FROM events""")
def movements(spark, sf_dir):
    moves = events(spark, sf_dir).select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.col("event_type").alias("to"), F.when(F.col("event_id") % 4 == 0, "loaned-out").alias("reason"))
    return facts.move_items(moves)[0].select("seq", "item", "from_place", "reason")


@query("""SELECT user_id AS item, event_type AS place, epoch_us(ts) AS at_us FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type GROUP BY ALL""")
def history_instants(spark, sf_dir):
    rows = events(spark, sf_dir)
    moves = rows.select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.col("event_type").alias("to"))
    told = facts.history_at(moves, rows.select(F.col("event_id").alias("seq"), F.col("ts").alias("at")))
    return told.select("item", F.col("to").alias("place"), F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"))


@query("SELECT o_orderkey, s_name AS name, s_nationkey AS nation FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey")
def pulled_refs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    told = facts.pull(orders, "o_custkey", table(spark, sf_dir, "supplier"), "s_suppkey", ["s_name", "s_nationkey"], "place")
    return told.select("o_orderkey", F.col("place.s_name").alias("name"), F.col("place.s_nationkey").alias("nation"))


@query("""WITH v AS (SELECT o_custkey + 40 AS name, count(*) AS version FROM orders GROUP BY 1)
SELECT coalesce(v.name, c_custkey) AS name, coalesce(version, c_custkey % 5, 0)::BIGINT AS last_version FROM customer FULL JOIN v ON v.name = c_custkey""")
def registry_after_pull(spark, sf_dir):
    """Drives are numbered 40 above the customers, so the first of these have no drive and the last drives were never seen."""
    now = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 40).alias("name")).agg(F.count("*").alias("version"))
    seen = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), (F.col("c_custkey") % 5).alias("last_version"))
    files = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return versions.pull(files, files, seen, now, ["n_nationkey"], "name", F.col("n_name"))[1]


@query("""WITH m AS (SELECT DISTINCT l_returnflag AS a, l_linestatus AS b, l_linenumber AS c FROM lineitem), k AS (SELECT DISTINCT l_returnflag AS a, l_linestatus AS b FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 49)
SELECT a, b, count(*) AS n FROM m JOIN k USING (a, b) GROUP BY a, b""")
def compound_cells(spark, sf_dir):
    """Keys of two columns that were there before, with how often a third is found with them."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), F.col("l_linenumber").alias("c"), "l_quantity")
    made = facts.find_or_create_compound(lines.select("a", "b"), lines.filter("c = 1 AND l_quantity > 49").select("a", "b"), ["a", "b"])
    return lines.select("a", "b", "c").distinct().join(made.filter("NOT created"), ["a", "b"]).groupBy("a", "b").agg(F.count("*").alias("n"))


# Clocks


@query("""WITH o AS (SELECT o_orderkey, day(o_orderdate) AS x, month(o_orderdate) AS y, day(o_orderdate) % 7 AS y2, month(o_orderdate) % 5 AS z2 FROM orders)
SELECT o_orderkey, (x <= 0 AND y <= y2 AND (y < y2 OR z2 > 0)) AS before, (y2 <= y AND z2 <= 0 AND (x > 0 OR y2 < y)) AS after, NOT (x <= 0 AND y <= y2 AND (y < y2 OR z2 > 0)) AND NOT (y2 <= y AND z2 <= 0 AND (x > 0 OR y2 < y)) AS apart, (x + greatest(y, y2) + z2)::BIGINT AS merged FROM o""")
def clock_orders(spark, sf_dir):
    """Two clocks an order, of peers x and y, and of y and z."""
    day, month = F.dayofmonth("o_orderdate"), F.month("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("x"), day, F.lit("y"), month).alias("a"), F.create_map(F.lit("y"), day % 7, F.lit("z"), month % 5).alias("b"))
    a, b = F.col("a"), F.col("b")
    total = F.aggregate(F.map_values(clocks.merge(a, b)), F.lit(0), lambda s, x: s + x)
    return rows.select("o_orderkey", clocks.happens_before(a, b).alias("before"), clocks.happens_before(b, a).alias("after"), clocks.concurrent(a, b).alias("apart"), total.cast("long").alias("merged"))


@query("""SELECT l_orderkey, CASE WHEN bool_and(l_linenumber % 5 <> 0) THEN min(l_suppkey) END AS winner, count(*) AS n FROM lineitem GROUP BY l_orderkey""")
def concurrent_edits(spark, sf_dir):
    ops = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.when(F.col("l_linenumber") % 5 == 0, "move").otherwise("set-text").alias("kind"))
    return clocks.resolve_concurrent(ops, ["l_orderkey"], "kind", "l_suppkey")


@query("""SELECT event_id, CASE WHEN event_id + 30 <= (SELECT max(event_id) FROM events) THEN NULL ELSE 'theirs' END AS missing_in FROM events WHERE event_id + 30 > (SELECT max(event_id) FROM events)
UNION ALL SELECT -1 - event_id, 'mine' FROM events WHERE event_id < 3""")
def missing_ops(spark, sf_dir):
    """Two logs of all events that differ in a few: one lacks the last thirty, the other has three more. Found by digests of ranges."""
    mine = events(spark, sf_dir).select("event_id")
    last = mine.agg(F.max("event_id").alias("last"))
    theirs = mine.join(F.broadcast(last), F.col("event_id") + 30 <= F.col("last")).select("event_id").union(mine.filter("event_id < 3").select(-1 - F.col("event_id")))
    return clocks.missing_by_ranges(mine, theirs, "event_id")[0]


@query(None)
def chunked_versions(spark, sf_dir):
    """Two versions of every document, the second with a sentence before and one in the middle, as shared chunks: sums of each version.

    SQL can't tell chunks; ``tests/test_chunks.py`` reads every version back.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.lit("A new beginning. "), F.substring("text", F.lit(1), half), F.lit(" Something between. "), F.substring("text", half + 1, F.length("text")))
    rows = docs.select("doc_id", F.lit(1).alias("version"), "text").union(docs.select("doc_id", F.lit(2), edited))
    pieces = chunks.split(rows, ["doc_id", "version"], "text")
    return chunks.saving(chunks.manifest(pieces, ["doc_id", "version"]), ["version"])


@query("""WITH e AS (SELECT o_custkey, o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders)
SELECT o_orderkey || '|orders' AS cell, 'total ' || o_custkey || chr(10) || 'of ' || o_orderkey AS text, NULL AS dst FROM orders UNION ALL SELECT src || '|orders', NULL, dst || '|orders' FROM e WHERE dst IS NOT NULL""")
def cell_store(spark, sf_dir):
    """Every order as a cell of a text store, linked with its customer's next, written as lines and read back."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    around = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))

    def cell(c: str):
        return F.concat(F.col(c), F.lit("|orders"))

    def record(key, value):
        return F.when(value.isNotNull(), F.array(F.concat(F.lit(cellstore.KEY), key), F.concat(F.lit(cellstore.VAL), value))).otherwise(F.array().cast("array<string>"))

    text = F.concat(F.lit("total "), F.col("o_custkey"), F.lit("^nof "), F.col("o_orderkey"))
    here = cell("o_orderkey")
    lines = F.concat(record(here, text), record(F.concat(here, F.lit("-d.next")), cell("before")), record(F.concat(here, F.lit("+d.next")), cell("after")))
    path = shared_path(spark, "cells")
    journal_text.write_lines(around.select("o_orderkey", F.posexplode(lines).alias("k", "line")), path, ["o_orderkey", "k"], whole=1)
    now = materialise(cellstore.current(cellstore.read_records(spark, path).withColumn("file", F.lit("store"))), "records")
    null = F.lit(None).cast("string")
    return cellstore.cells(now).select("cell", "text", null.alias("dst")).union(documents.mirrored(cellstore.connections(now)).select("src", null, "dst"))
