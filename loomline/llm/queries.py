"""The queries opN_<name> of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import chat_format, collocations, decontaminate, language_id, license_scan, ngram_join, packing, quality_rules, sharding, token_align, token_counts, url_filter, warc
from loomline.storage import materialise, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the planted conversation -7, digested from what the formatter wrote."""
    planted = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{PROBE}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    out = chat_format.format_chats(rows)
    told = F.array_join(F.transform("read", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumns({"loss": chat_format.read_loss_text(F.col("segments")), "read": chat_format.read_turns(F.col("formatted"))}).select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP1_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(7 + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 7 ELSE 8 END + length(text)
      + len(regexp_extract_all(text, '[\\[<\\\\]')))::BIGINT AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL AND after IS NOT NULL
                WHEN 'user' THEN (before IS NULL OR before IN ('system', 'assistant')) AND after IS NOT NULL
                WHEN 'assistant' THEN before IS NOT NULL AND before = 'user' ELSE false END) AS valid
FROM s GROUP BY conv_id
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document under the current policy."""
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = F.lit(quality_rules.BASE.mask()).cast("long")
    return quality_rules.apply_policy(rows, quality_rules.POLICIES[quality_rules.CURRENT]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "fail_bits"
    )


OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, string_split(text, chr(10)) AS ls FROM d),
p AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
q AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM p),
r AS (SELECT k, count(DISTINCT i + o) AS n FROM q, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY k),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT k, unnest(ls) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k),
m AS (SELECT t.k, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '!'))::BIGINT AS n_bangs, coalesce(n_lines, 0)::BIGINT AS n_lines
      FROM t LEFT JOIN r ON r.k = t.k LEFT JOIN l ON l.k = t.k),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
        + 8 * (10 * n_bangs > 3 * n_words)::BIGINT + 16 * (2 * n_dup_lines > n_lines)::BIGINT
        + 32 * (word_chars < 2 * n_words)::BIGINT + 64 * (word_chars > 20 * n_words)::BIGINT + 128 * (n_symbols > n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  fail_bits & 127 = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM b
"""

JOIN_4_85 = ngram_join.Join(width=4, num=85, den=100)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by Jaccard similarity of their four-word shingles, 85 hundredths or more."""
    return ngram_join.join_components(table(spark, sf_dir, "documents"), JOIN_4_85).select("doc_id", "n_shingles", "component_id")


OP2_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) BETWEEN 1 AND 3 THEN [array_to_string(w, ' ')] WHEN len(w) = 0 THEN []
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM t),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS i, b.doc_id AS j FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY i, j
      HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT i, j FROM p UNION SELECT j, i FROM p),
r(v, c) AS (SELECT i, i FROM e UNION SELECT e.j, r.c FROM r JOIN e ON e.i = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT g.doc_id, len(s)::BIGINT AS n_shingles, coalesce(m.c, g.doc_id) AS component_id FROM g LEFT JOIN m ON m.v = g.doc_id
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model learnt from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    told = language_id.predict(docs, language_id.train(docs))
    return told.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the rules, else by trees trained on the URLs that the rules decide."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.train(url_filter.labelled_by_rules(pages)))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through legacy ARC records into WARC archives, and read back."""
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items, by windows of ten words."""
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[b:b + 9], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS b FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM v),
p AS (SELECT k, size, b, array_to_string(w[b:b + size - 1], ' ') AS g
      FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS b FROM d, z WHERE len(w) >= size)),
h AS (SELECT k, item_id, b, p.size AS size FROM p JOIN v ON p.g = v.g AND p.size = v.size),
n AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(b, b + size)) AS q FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT k, item_id::VARCHAR AS s FROM h) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.k = d.k LEFT JOIN t ON t.k = d.k
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, one of them replayed: provisional counts, their revision, withdrawn documents.

    Documents enter with a quarter of their bytes as provisional count of each tokenizer, then come the counts proper,
    then documents labelled toxic leave; the revision arrives a second time and is not applied again.
    """
    guess = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4).cast("long")
    docs = table(spark, sf_dir, "documents").withColumn("old_tokens", guess)
    known = materialise(token_counts.count_tokens(docs, carry=("old_tokens",)), "counts")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    kinds = F.explode(F.array(*[F.lit(t) for t in token_counts.TOKENIZERS])).alias("tokenizer")
    provisional = docs.groupBy("source", "lang").agg(F.count("*").alias("d_docs"), F.sum("old_tokens").alias("d_tokens"))
    revised = token_counts.revisions(known)
    rollup = token_counts.Rollup(spark, shared_path(spark, "rollup"))
    rollup.commit("001-provisional", provisional.select("source", "lang", kinds, "d_docs", "d_tokens"))
    rollup.commit("002-revised", revised)
    rollup.compact()
    rollup.commit("003-withdrawn", token_counts.deletes(known.join(toxic, "doc_id", "left_semi")))
    rollup.commit("002-revised", revised)
    return rollup.totals()


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under both tokenizers in groups, and its links scored by the corpus-wide counts."""
    aligned = materialise(token_align.align(table(spark, sf_dir, "documents")), "aligned")
    counts = materialise(token_align.pair_counts(aligned), "counts")
    return token_align.score_links(aligned, counts)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language's 2,000 best-scored phrases of two to four words."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM d)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.phrase, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (SELECT DISTINCT lang, a AS m, array_to_string(ws[i:i + size - 1], ' ') AS phrase
          FROM (SELECT lang, a, ws, size, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM c WHERE cut = 1 AND k > 2))),
longest AS (SELECT lang, phrase, max(m) AS m FROM parts GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN longest t ON t.lang = b.lang AND t.phrase = b.phrase
WHERE t.m IS NULL OR 100::HUGEINT * t.m < 80::HUGEINT * a QUALIFY rank <= 2000
"""


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 and slot there, by a ring whose loads are at most one apart."""
    return sharding.place(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM p),
b AS (SELECT *, hex || '' AS h FROM m)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h || '0000', 1 + (i * 5) // 4, 3))::BIGINT // (1 << (12 - 5 - (i * 5) % 4))) % 32)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to FROM b
"""

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_decontamination": op7_decontamination,
    "op8_url_filter": op8_url_filter,
    "op9_token_counts": op9_token_counts,
    "op10_license_scan": op10_license_scan,
    "op11_token_alignment": op11_token_alignment,
    "op12_collocations": op12_collocations,
    "op13_sharding": op13_sharding,
}
ORACLES = {"op1_chat_format": OP1_SQL, "op2_ngram_jaccard": OP2_SQL, "op3_warc": OP3_SQL, "op5_quality_rules": OP5_SQL, "op7_decontamination": OP7_SQL, "op12_collocations": OP12_SQL}
