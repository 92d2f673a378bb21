"""Queries on addresses, texts, comments, chats and request bodies, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import checks
from loomline.functions import text as fn
from loomline.operators import comments
from loomline.plans.registry import events, query, table
from loomline.sources import documents as nested
from loomline.sources import transcripts

# Addresses and names


@query("""WITH p AS (SELECT page_id, page_id % 9 AS k, 'u' || page_id AS u FROM pages)
SELECT page_id, CASE WHEN k IN (0, 1, 3, 6, 8) THEN u END AS uid, CASE k WHEN 0 THEN 'a/b' WHEN 1 THEN 'x y' WHEN 3 THEN '' WHEN 6 THEN 'p' WHEN 8 THEN '' END AS path, CASE k WHEN 0 THEN 'x/y' WHEN 6 THEN '2' WHEN 8 THEN 'a%zz' END AS version,
  CASE k WHEN 0 THEN 'blk' WHEN 1 THEN 'b' WHEN 8 THEN 'c' END AS block_ref, CASE k WHEN 1 THEN 'https://h.example' WHEN 6 THEN 'http://h:80' END AS origin,
  CASE k WHEN 0 THEN 'hm://' || u || '/a/b?v=x/y' WHEN 1 THEN 'hm://' || u || '/x y' WHEN 3 THEN 'hm://' || u WHEN 6 THEN 'hm://' || u || '/p?v=2' WHEN 8 THEN 'hm://' || u || '?v=a%zz' END AS resource FROM p""")
def address_parts(spark, sf_dir):
    """Nine shapes of addresses: schemes in capitals, empty segments, escapes, fragments, reserved words, foreign schemes."""
    shapes = ["HM://{}/a//b/?q=1&v=x%2Fy#blk+[3:9]", " https://h.example/hm/{}/x y#b+ ", "https://h.example/hm/API/{}", "hm://{}#", "https://h.example/other/{}", "ftp://h/hm/{}", "http://h:80/hm/{}/p/?v=1&v=2", "hm:///{}", "hm://{}?v=a%zz#c[1:2]"]
    url = F.element_at(F.array(*[F.replace(F.lit(x), F.lit("{}"), F.concat(F.lit("u"), F.col("page_id"))) for x in shapes]), (F.col("page_id") % 9 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", fn.address(url).alias("a"))
    return rows.select("page_id", "a.uid", F.array_join("a.path", "/").alias("path"), "a.version", "a.block_ref", "a.origin", F.when(F.col("a").isNotNull(), fn.resource_id(F.col("a"))).alias("resource"))


@query("""WITH n AS (SELECT p_partkey, p_partkey % 4 AS k, lower(p_brand) AS b FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN upper(b[1]) || b[2:] || ' Of it' WHEN 1 THEN upper(b[1]) || b[2:] WHEN 2 THEN '_-_' ELSE upper(b[1]) || replace(b[2:], '#', ' ') END AS title FROM n""")
def humanized_segments(spark, sf_dir):
    low = F.lower("p_brand")
    shape = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("-"), low, F.lit("_Of-it"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("--"), low, F.lit("_"))).when(F.col("p_partkey") % 4 == 2, "_-_").otherwise(F.replace(low, F.lit("#"), F.lit("-")))
    return table(spark, sf_dir, "part").select("p_partkey", fn.humanized(shape).alias("title"))


@query("""WITH s AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch_ms(o_orderdate) AS ms, o_orderdate AS d, o_orderkey % 3 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 0 THEN 'not a time' ELSE strftime(d, '%Y-%m-%d %H:%M') || ' UTC' END AS minute, strftime(d, '%Y-%m-%d %H:%M:%S') || ' UTC' AS second FROM s""")
def times_text(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    iso = F.when(F.col("o_orderkey") % 3 == 0, "not a time").otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.iso_minute(iso).alias("minute"), fn.millis_text(F.unix_millis(at)).alias("second"))


@query("""WITH d AS (SELECT doc_id, '"' || replace(replace(replace(replace(replace(coalesce(text, ''), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '"' AS q FROM documents)
SELECT doc_id, CASE WHEN length(q) <= 40 THEN q ELSE substr(q, 1, 38) || '…"' END AS quoted FROM d""")
def quotes(spark, sf_dir):
    """Texts as JSON strings, elided to forty characters."""
    return table(spark, sf_dir, "documents").select("doc_id", fn.quoted(F.coalesce("text", F.lit("")), 40).alias("quoted"))


@query("""WITH s AS (SELECT s_nationkey, list(s_name ORDER BY s_name) AS l FROM supplier GROUP BY 1), n AS (SELECT n_nationkey, coalesce(l, []) AS l FROM nation LEFT JOIN s ON s_nationkey = n_nationkey),
c AS (SELECT n_nationkey, CASE WHEN len(l) > 4 THEN list_append(l[1:4], 'others') ELSE l END AS l FROM n)
SELECT n_nationkey, CASE len(l) WHEN 0 THEN 'Unknown' WHEN 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] END AS names FROM c""")
def name_lists(spark, sf_dir):
    """The suppliers of each nation, the first four by name."""
    held = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list("s_name")).alias("l"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey").join(held, "n_nationkey", "left")
    return rows.select("n_nationkey", fn.name_list(F.coalesce("l", F.array().cast("array<string>"))).alias("names"))


# Comments


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS (SELECT doc_id, substr(t, 1, 7) || '[' || substr(t, 8, 4) || '](l' || doc_id || ')' || substr(t, 12) AS t FROM d)
SELECT doc_id, regexp_replace(substr(t, 1, 2) || '[' || substr(t, 3, 3) || '](l1)' || substr(t, 6), '^\\s+|\\s+$', '', 'g') AS linked FROM r""")
def annotated_text(spark, sf_dir):
    """Two links in every document, over characters 2 to 5 and 7 to 11."""
    spans = F.array(F.struct(F.lit(7).alias("start"), F.lit(11).alias("end"), F.concat(F.lit("l"), F.col("doc_id")).alias("link")), F.struct(F.lit(2).alias("start"), F.lit(5).alias("end"), F.lit("l1").alias("link")))
    return table(spark, sf_dir, "documents").select("doc_id", comments.with_links(F.col("text"), spans).alias("linked"))


def _turn_comments(spark, sf_dir) -> DataFrame:
    """Every conversation as an export: a turn replies to turn div 2, some to one that isn't there; texts are their first words."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    parent = F.when(F.col("turn") == 0, None).when(F.col("turn") % 7 == 6, "gone").otherwise((F.floor(F.col("turn") / 2)).cast("string"))
    target = F.when(F.col("turn") % 3 == 2, "").otherwise(F.concat(F.lit("t"), F.col("conv_id") % 2))
    return rows.select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("file"), F.col("turn").cast("string").alias("id"), parent.alias("parent"), target.alias("target"), F.col("turn").alias("place"), "role", "text")


@query("""WITH c AS (SELECT 'conv-' || conv_id AS file, turn::VARCHAR AS id, turn, CASE WHEN turn = 0 THEN NULL WHEN turn % 7 = 6 THEN 'gone' ELSE (turn // 2)::VARCHAR END AS parent FROM conversations)
SELECT c.file, c.id, CASE WHEN c.parent IS NULL THEN 'top' WHEN p.id IS NULL THEN 'orphan' ELSE 'reply' END AS reply FROM c LEFT JOIN c p ON p.file = c.file AND p.id = c.parent""")
def reply_classes(spark, sf_dir):
    return comments.reply_classes(_turn_comments(spark, sf_dir)).select("file", "id", "reply")


@query("""WITH c AS (SELECT 'conv-' || conv_id AS file, turn::VARCHAR AS id, turn, conv_id, CASE WHEN turn = 0 THEN NULL WHEN turn % 7 = 6 THEN 'gone' ELSE (turn // 2)::VARCHAR END AS parent FROM conversations)
SELECT c.file, count(*) AS n_comments, count(*) FILTER (p.id IS NULL) AS n_threads, CASE WHEN bool_or(c.turn % 3 <> 2) THEN 't' || any_value(c.conv_id) % 2 ELSE '' END AS targets FROM c LEFT JOIN c p ON p.file = c.file AND p.id = c.parent GROUP BY c.file""")
def comment_totals(spark, sf_dir):
    return comments.totals(_turn_comments(spark, sf_dir)).withColumn("targets", F.array_join("targets", ","))


@query("""WITH l AS (SELECT o_orderkey, o_orderkey % 6 AS n, o_orderkey % 4 = 0 AS long FROM orders),
b AS (SELECT o_orderkey, n, long, unnest(range(n)) AS i FROM l), c AS (SELECT *, 'block ' || i || CASE WHEN long AND i = 2 THEN ' that is longer than thirty characters' ELSE '' END AS t FROM b),
g AS (SELECT o_orderkey, n, n > 3 AND bool_and(i = 0 OR length(t) < 30) AS listed FROM c GROUP BY o_orderkey, n),
x AS (SELECT c.o_orderkey, i, CASE WHEN listed THEN CASE WHEN i = 0 THEN t || chr(10) ELSE '- ' || t END WHEN i % 3 = 0 THEN '**' || t || '**' || chr(10) WHEN i % 3 = 1 THEN '  - ' || t ELSE t || chr(10) END AS s FROM c JOIN g USING (o_orderkey, n))
SELECT o_orderkey, regexp_replace(coalesce(string_agg(s, chr(10) ORDER BY i), ''), '\\n$', '') AS body FROM l LEFT JOIN x USING (o_orderkey) GROUP BY o_orderkey""")
def body_lines(spark, sf_dir):
    """Comments of up to five blocks: headings, items and paragraphs, as a list where all are short."""
    longer = F.when((F.col("o_orderkey") % 4 == 0), F.lit(" that is longer than thirty characters")).otherwise("")

    def block(i):
        kind = F.when(i % 3 == 0, "Heading").otherwise("Paragraph")
        return F.struct(F.when(i % 3 == 1, 1).otherwise(0).alias("depth"), kind.alias("type"), F.concat(F.lit("block "), i.cast("string"), F.when(i == 2, longer).otherwise("")).alias("text"))

    n = F.col("o_orderkey") % 6
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), block)).otherwise(F.array().cast(comments.BLOCKS))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(comments.body_lines(blocks), "\n").alias("body"))


@query("""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(l, lambda x: regexp_replace(repeat('> ', (doc_id % 3)::INTEGER) || x, '\\s+$', '')), chr(10)) AS quoted FROM d""")
def quoted_lines(spark, sf_dir):
    lines = comments.quoted_lines(F.split(F.coalesce("text", F.lit("")), "\n"), (F.col("doc_id") % 3).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("quoted"))


@query("""WITH b AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'Heading' WHEN 1 THEN 'Code' WHEN 2 THEN 'Image' ELSE 'Other' END AS type, CASE floor(value)::BIGINT % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE 'x' END AS text, CASE WHEN event_id % 5 = 0 THEN 'l' ELSE '' END AS link, CASE WHEN event_id % 3 = 0 THEN 'b' || event_id ELSE '' END AS id FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM b WHERE CASE type WHEN 'Heading' THEN text = 'x' WHEN 'Code' THEN text <> '' WHEN 'Image' THEN link <> '' ELSE text = 'x' OR link <> '' END)
SELECT user_id, event_id, CASE WHEN id = '' THEN 'p' || n ELSE id END AS paragraph FROM k""")
def paragraph_ids(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Heading", "Code", "Image", "Other")]), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.element_at(F.array(*[F.lit(x) for x in ("", " ", "x")]), (F.floor("value").cast("long") % 3 + 1).cast("int"))
    rows = events(spark, sf_dir).select("user_id", "event_id", kind.alias("type"), text.alias("text"), F.when(F.col("event_id") % 5 == 0, "l").otherwise("").alias("link"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("b"), F.col("event_id"))).otherwise("").alias("block_id"))
    return comments.paragraph_ids(rows, "user_id", "event_id").select("user_id", "event_id", "paragraph")


@query("""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS t FROM conversations), b AS (SELECT conv_id, turn, unnest([0, 1]) AS seq, t FROM c)
SELECT 'conv-' || conv_id AS file, turn::VARCHAR AS id, CASE WHEN turn % 2 = 0 THEN 'Ann' ELSE 'somebody-' || substr('whom-nobody-knows', 1, 3) END AS author, seq::INTEGER AS seq, seq::INTEGER AS depth, CASE WHEN seq = 0 THEN 'Heading' ELSE 'Paragraph' END AS type, CASE WHEN seq = 0 THEN 'head ' || turn ELSE t END AS text FROM b WHERE seq = 0 OR t <> ''""")
def comment_blocks(spark, sf_dir):
    """Every conversation as the JSON of an export, and its blocks read back in preorder."""
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    block = F.struct(F.struct(F.lit("Heading").alias("type"), F.concat(F.lit("head "), F.col("turn")).alias("text")).alias("block"), F.array(F.struct(F.struct(F.lit("Paragraph").alias("type"), said.alias("text")).alias("block"))).alias("children"))
    author = F.when(F.col("turn") % 2 == 0, "a").otherwise("somebody-whom-nobody-knows")
    comment = F.struct(F.lpad(F.col("turn").cast("string"), 4, "0").alias("createTime"), F.col("turn").cast("string").alias("id"), author.alias("author"), F.array(block).alias("content"))
    made = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(comment)).alias("comments"))
    names = F.create_map(F.lit("a"), F.struct(F.struct(F.lit("Ann").alias("name")).alias("metadata")))
    files = made.select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("file"), F.to_json(F.struct("comments", names.alias("authors"))).alias("text"))
    told = nested.blocks(nested.comments(files), F.col("content"))
    return told.select("file", "id", "author", F.col("seq").cast("int").alias("seq"), "depth", "type", "text")


# Chats and captions


@query("""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, epoch_us(ts - TIMESTAMP '2024-01-01') / 1e6 AS s FROM events WHERE event_type = 'error'),
f AS (SELECT user_id, min(s) AS s FROM t GROUP BY 1), c AS (SELECT user_id, event_id, epoch_us(ts - TIMESTAMP '2024-01-01') / 1e6 + 30 AS at_s FROM events WHERE event_type = 'click'),
j AS (SELECT c.*, CASE WHEN at_s <= f.s THEN 1 ELSE t.turn END AS turn FROM c ASOF LEFT JOIN t ON t.user_id = c.user_id AND c.at_s >= t.s LEFT JOIN f ON f.user_id = c.user_id)
SELECT event_id, turn, row_number() OVER (PARTITION BY user_id, turn ORDER BY at_s, event_id) AS place FROM j""")
def chats_in_turns(spark, sf_dir):
    """A user's clicks are chats, their errors begin turns; meetings began with the year, and clocks are half a minute off."""
    from pyspark.sql import Window

    start = F.lit("2024-01-01").cast("timestamp")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start)) / 1e6
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    turns = events(spark, sf_dir, "error").select(F.col("user_id").alias("file"), turn.alias("turn"), seconds.alias("start_s"))
    chats = events(spark, sf_dir, "click").select(F.col("user_id").alias("file"), F.col("event_id").alias("message"), F.col("ts").alias("time"))
    anchors = chats.select("file", start.alias("meeting_start")).distinct()
    return transcripts.attach_chats(turns, chats, anchors, 30.0).select(F.col("message").alias("event_id"), "turn", F.col("place").cast("long").alias("place"))


@query("""SELECT 'conv-' || conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS message, (turn * 61)::BIGINT AS t_s, role AS sender, turn % 3 = 1 AS is_private,
  array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ' ') AS text FROM conversations""")
def wall_chats(spark, sf_dir):
    """Every conversation as a log with dated header lines; every third turn is private."""
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 61), "yyyy-MM-dd HH:mm:ss")
    whom = F.when(F.col("turn") % 3 == 1, "Somebody").otherwise("Everyone")
    line = F.concat(stamp, F.lit(" From "), F.col("role"), F.lit(" to "), whom, F.lit(":\n"), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    text = F.concat(F.lit("dropped\n"), F.array_join(F.transform("lines", lambda c: c["line"]), "\n"))
    told = transcripts.wall_chats(rows.select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("file"), text.alias("text")), include_private=True)
    return told.select("file", "message", (F.unix_seconds(F.col("time").cast("timestamp")) - 1_700_000_000).alias("t_s"), "sender", "is_private", "text")


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)
SELECT 'user-' || user_id AS file, n::INTEGER AS seq, 'w' || event_id AS word, printf('%02d:%02d:%02d.000', n // 3600, n % 3600 // 60, n % 60) AS ts FROM e""")
def word_timeline(spark, sf_dir):
    """A user's events are words, one a second; every cue shows the last two again before its own two."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = events(spark, sf_dir).select("user_id", F.concat(F.lit("w"), F.col("event_id")).alias("word"), (F.row_number().over(w) - 1).alias("n"))
    at = F.col("n")
    rows = rows.withColumn("ts", F.format_string("%02d:%02d:%02d.000", F.floor(at / 3600), F.floor(at % 3600 / 60), at % 60)).withColumn("cue", F.floor(at / 2))
    shown = rows.unionByName(rows.withColumn("cue", F.col("cue") + 1).join(rows.select("user_id", "cue").distinct(), ["user_id", "cue"]))
    cue = shown.groupBy("user_id", "cue").agg(F.sort_array(F.collect_list(F.struct("n", "ts", "word"))).alias("ws"))
    first = F.get("ws", 0)
    rest = F.transform(F.slice("ws", F.lit(2), F.size("ws")), lambda x: F.concat(F.lit("<"), x["ts"], F.lit("><c> "), x["word"], F.lit("</c>")))
    text = F.concat(first["ts"], F.lit(" --> 99:00:00.000\nline above\n"), first["word"], F.array_join(rest, ""))
    files = cue.select("user_id", "cue", text.alias("text")).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("cue", "text"))).alias("cues"))
    whole = F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("cues", lambda c: c["text"]), "\n\n"))
    return transcripts.word_timeline(files.select(F.concat(F.lit("user-"), F.col("user_id")).alias("file"), whole.alias("text")))


# Bodies, encodings, includes


@query("""WITH e AS (SELECT event_id, event_id % 6 AS k, user_id FROM events)
SELECT event_id, k IN (0, 5) AS ok, CASE k WHEN 0 THEN 'n' || user_id WHEN 5 THEN 'x' END AS name, CASE k WHEN 0 THEN true END AS splice, CASE k WHEN 0 THEN user_id::DOUBLE WHEN 1 THEN 2.5 END AS expected, CASE WHEN k IN (0, 5) THEN 200 ELSE 400 END AS status FROM e""")
def request_bodies(spark, sf_dir):
    """Six shapes of bodies: whole, empty name, name of another type, no name, no JSON, optional fields of other types."""
    shapes = ['{"name": "n{}", "splice": true, "expected": {}}', '{"name": "", "expected": 2.5}', '{"name": 5, "splice": "yes"}', "{}x", "[1, 2", '{"name": "x", "splice": 1, "expected": "7"}']
    body = F.element_at(F.array(*[F.replace(F.lit(x), F.lit("{}"), F.col("user_id").cast("string")) for x in shapes]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = events(spark, sf_dir).select("event_id", checks.required_string(body, "name").alias("r"), checks.optional_boolean(body, "splice").alias("splice"), checks.optional_number(body, "expected").alias("expected"))
    return rows.select("event_id", "r.ok", F.col("r.value").alias("name"), "splice", "expected", checks.status_of(F.when(F.col("r.ok"), "ok").otherwise("validation_error")).alias("status"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 404 WHEN 1 THEN 409 WHEN 2 THEN 400 WHEN 3 THEN 200 ELSE 400 END AS status FROM nation""")
def status_codes(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(x) for x in ("unknown_cell", "revision_conflict", "self_link_forbidden", "ok", "never heard of")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", checks.status_of(code).alias("status"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'é' || doc_id ELSE coalesce(text, '') END AS text, CASE WHEN doc_id % 3 = 0 THEN 'latin-1' ELSE 'utf-8' END AS encoding FROM documents""")
def decoded_text(spark, sf_dir):
    """Every third document is a line in Latin-1, the others are UTF-8."""
    old = F.concat(F.unhex(F.lit("E9")), F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    raw = F.when(F.col("doc_id") % 3 == 0, old).otherwise(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", checks.decoded(raw).alias("d")).select("doc_id", "d.text", "d.encoding")


@query("""SELECT page_id, CASE WHEN page_id % 3 > 0 THEN '{"a":' || page_id || '}' END AS payload FROM pages""")
def envelopes(spark, sf_dir):
    body = F.when(F.col("page_id") % 3 == 0, '{"other": 1}').otherwise(F.concat(F.lit('{"json": {"a": '), F.col("page_id"), F.lit('}, "meta": 1}')))
    return table(spark, sf_dir, "pages").select("page_id", checks.payload(body).alias("payload"))


@query("""WITH RECURSIVE b AS (SELECT p_partkey AS k, unnest([0, 1, 2]) AS n FROM part),
l AS (SELECT 'f' || k AS file, n, CASE WHEN n = 1 AND k > 0 THEN k // 4 END AS inc, CASE n WHEN 0 THEN 'top ' || k WHEN 1 THEN '#include "f' || k // 4 || CASE WHEN k > 0 THEN '"' ELSE '' END ELSE 'end ' || k END AS line, k FROM b),
r AS (SELECT file, [n] AS path, inc, line, 0 AS d FROM l UNION ALL SELECT r.file, list_append(path, l.n), l.inc, l.line, d + 1 FROM r JOIN l ON r.inc IS NOT NULL AND l.file = 'f' || r.inc WHERE d < 6 AND r.inc % 5 <> 4 AND 'f' || r.inc IN (SELECT file FROM l))
SELECT file, string_agg(line, chr(10) ORDER BY path) AS text FROM r WHERE inc IS NULL OR d = 6 OR inc % 5 = 4 OR 'f' || inc NOT IN (SELECT file FROM l) GROUP BY file""")
def included_files(spark, sf_dir):
    """Every part is a file of three lines, of which the second includes the file of a quarter of its key; some are never included."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    k, inc = F.col("p_partkey"), F.floor(F.col("p_partkey") / 4)
    middle = F.when(k > 0, F.concat(F.lit('#include "f'), inc, F.lit('"'))).otherwise(F.lit('#include "f0'))
    rows = part.select(F.concat(F.lit("f"), k).alias("file"), F.posexplode(F.array(F.concat(F.lit("top "), k), middle, F.concat(F.lit("end "), k))).alias("line_no", "line"))
    whole = checks.expand_includes(rows, keep=F.substring("name", 2, 20).try_cast("long") % 5 == 4)
    parts = F.sort_array(F.collect_list(F.struct("path", "line")))
    return whole.groupBy("file").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))


@query("""WITH c AS (SELECT conv_id, string_split(coalesce(text, ''), ' ') AS l FROM conversations), e AS (SELECT conv_id, unnest(range(len(l))) AS k, l FROM c)
SELECT conv_id, k::INTEGER AS col, max(length(l[k + 1]))::INTEGER AS width FROM e GROUP BY conv_id, k""")
def column_widths(spark, sf_dir):
    """Every conversation as a table, a row for each turn and a column for each word."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.split(F.coalesce("text", F.lit("")), " ").alias("cells"))
    return fn.column_widths(rows, ["conv_id"], "cells").select("conv_id", F.col("column").alias("col"), "width")


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 4 THEN p_partkey // 4 END AS parent FROM part),
r AS (SELECT id, id AS root, 0 AS depth, id AS top FROM n WHERE parent IS NULL UNION ALL SELECT n.id, r.root, r.depth + 1, CASE WHEN r.depth < 2 THEN n.id ELSE r.top END FROM r JOIN n ON n.parent = r.id),
h AS (SELECT top, count(*) AS hidden FROM r WHERE depth > 2 GROUP BY top)
SELECT id, root, depth, coalesce(hidden, 0) AS hidden FROM r LEFT JOIN h ON h.top = r.id WHERE depth <= 2""")
def outline_levels(spark, sf_dir):
    """Three levels of a forest of parts, each with how many lie below what is shown."""
    from loomline.operators import trees

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey >= 4 THEN p_partkey div 4 END").alias("parent"), F.col("p_partkey").alias("sort"))
    return trees.outline(part, 2).select("id", "root", "depth", "hidden")
