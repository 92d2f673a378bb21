"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

1. ``index`` stores the postings (row, position, term) of every benchmark term in the training texts as a table.
2. Their counts tell which terms of each window are rare. The ``RARE`` rarest positions of every window are its probes.
3. ``alignments`` fetches only the probes' postings and subtracts the probe's offset in the item: postings of the same
   (row, item, difference) lie on one alignment, and only alignments where all probes of some window meet remain.
4. ``exact`` intersects the postings of all other terms of the aligned windows with the places where they should stand,
   and reports every window whose words are all there; no text is read again. ``proximity`` reports rows where an item's
   rare terms come close together though not as a phrase.

Benchmark tables (terms, probes, items) are broadcast only while their counted size is under BROADCAST_ROWS; beyond,
the same joins run by a shuffle.

Words are runs of digits, A-Z lower-cased, a-z and non-ASCII characters. Defined cases: null, empty and wordless texts
have n_words 0 and no hits; an item with fewer words than a window, but not none, is one window; items without words
never occur; repeated rows are reported each, with equal results; equal item_ids are one item name with several texts;
empty tables give no rows, or no hits; a row is known by a 64-bit hash of doc_id and text, so null and repeated doc_ids
do no harm (of 10^10 different rows two or three pairs are expected to share one, and would be reported together); columns other than doc_id, text and item_id are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.shared import ascii_lower, row_hash
from loomline.storage import discard, materialise

WINDOW = 10
RARE = 2
BROADCAST_ROWS = 1_000_000
#: Up to so many rows of documents (with an alignment, with a hit) are broadcast; beyond, the same joins run by a shuffle.
BROADCAST_KEYS = 500_000
#: Everything between words, before and after A-Z is lower-cased.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text as an array, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), lambda w: w != "")


def row_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``rk``, a hash of both."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), row_hash(F.col("doc_id"), F.col("text")).alias("rk"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast where its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class Benchmark:
    """items (item, item_id, words), terms (term_id, term, low, ascii), windows (item, begin, size), and the number of item words."""

    items: DataFrame
    terms: DataFrame
    rows: int


def benchmark_of(benchmark: DataFrame, window: int = WINDOW) -> Benchmark:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    items = materialise(items.withColumn("item", F.xxhash64(F.coalesce("item_id", F.lit("-")), F.array_join("words", " "))), "items")
    terms = items.select(F.explode("words").alias("term")).distinct()
    terms = terms.select(F.xxhash64("term").alias("term_id"), "term", F.lower("term").alias("low"), F.octet_length("term").alias("bytes"), (F.octet_length("term") == F.length("term")).alias("plain"))
    terms = materialise(terms, "terms")
    return Benchmark(items, terms, items.select(F.sum(F.size("words")).alias("n")).first()["n"] or 0)


def index(docs: DataFrame, bench: Benchmark) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, rk, n_words) and the postings (rk, pos, term_id), both stored.

    Words are matched by their lower case, which Spark folds fast for ASCII, and then exactly: a plain term matches
    only a word of as many bytes, any other only the word whose A-Z alone are lower-cased.
    """
    keyed = row_key(docs).select("doc_id", "rk", F.coalesce("text", F.lit("")).alias("text"))
    split = F.split("text", BETWEEN)  # only the first and the last part may be empty
    outside = F.greatest(F.lit(0), F.size(split) - (F.element_at(split, 1) == "").cast("int") - (F.element_at(split, -1) == "").cast("int"))
    rows = materialise(keyed.select("doc_id", "rk", outside.cast("long").alias("n_words")), "rows")
    lead = F.substring("text", 1, 1).rlike(BETWEEN).cast("int")
    words = keyed.select("rk", lead.alias("lead"), F.posexplode(split).alias("pos", "word")).withColumn("low", F.lower("word"))
    same = F.when(F.col("plain"), F.octet_length("word") == F.col("bytes")).otherwise(ascii_lower(F.col("word")) == F.col("term"))
    postings = words.join(sized(bench.terms, bench.rows), "low").filter(same).select("rk", (F.col("pos") - F.col("lead")).alias("pos"), "term_id")
    return rows, materialise(postings, "postings")


def probes_of(bench: Benchmark, postings: DataFrame, window: int = WINDOW, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """Probes (item, at, term_id, least), and for each item its windows' probes (item, needs: array of begin and positions).

    ``least`` is how many probes of the item must meet before any of its windows can be there.
    """
    counts = postings.groupBy("term_id").agg(F.count("*").alias("df"))
    counted = bench.terms.select("term_id", "term").join(counts, "term_id", "left").select("term", "term_id", F.coalesce("df", F.lit(0)).alias("df"))
    placed = bench.items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("at", "term")).join(counted, "term")
    begins = F.sequence(F.greatest(F.lit(0), F.col("at") - (window - 1)), F.greatest(F.lit(0), F.least(F.col("at"), F.col("n") - window)))
    inside = placed.select("item", "at", "term_id", "df", F.explode(begins).alias("begin"))
    rank = F.row_number().over(Window.partitionBy("item", "begin").orderBy("df", "at"))
    chosen = inside.withColumn("r", rank).withColumn("rarest", F.min("df").over(Window.partitionBy("item", "begin"))).filter((F.col("r") <= rare) & (F.col("rarest") > 0))
    chosen = materialise(chosen.select("item", "begin", "at", "term_id"), "probes")
    needs = chosen.groupBy("item", "begin").agg(F.sort_array(F.collect_list("at")).alias("ats")).groupBy("item").agg(F.collect_list(F.struct("begin", "ats")).alias("needs"))
    least = needs.select("item", F.array_min(F.transform("needs", lambda w: F.size(w["ats"]))).alias("least"))
    return chosen.select("item", "at", "term_id").distinct().join(least, "item"), needs


def alignments(postings: DataFrame, probes: DataFrame, needs: DataFrame, rows: int) -> DataFrame:
    """(rk, item, diff, begins): where the item's word 0 would stand, and the windows whose probes all meet there."""
    hits = postings.join(sized(probes, rows), "term_id").select("rk", "item", (F.col("pos") - F.col("at")).alias("diff"), "at", "least")
    met = hits.groupBy("rk", "item", "diff").agg(F.collect_set("at").alias("met"), F.min("least").alias("least"))
    met = met.filter(F.size("met") >= F.col("least")).join(sized(needs, rows), "item")
    whole = F.filter("needs", lambda w: F.size(F.array_except(w["ats"], F.col("met"))) == 0)
    return met.select("rk", "item", "diff", F.sort_array(F.transform(whole, lambda w: w["begin"])).alias("begins")).filter(F.size("begins") > 0)


def exact(postings: DataFrame, bench: Benchmark, aligned: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rk, item_id, first, last): the windows that occur, every one of their terms having a posting in its place."""
    aligned = materialise(aligned, "aligned")
    placed = bench.items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("at", "term")).join(bench.terms.select("term", "term_id"), "term")
    placed = materialise(placed.select("item", "at", "term_id", F.least(F.lit(window), F.col("n")).alias("size")), "places")
    keys = materialise(aligned.select("rk").distinct(), "keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    there = postings.join(keys, "rk", "left_semi").distinct()
    sizes = placed.select("item", "size").distinct()
    windows = aligned.join(sized(sizes, bench.rows), "item")
    wanted = windows.select("rk", "item", "diff", F.explode(F.array_distinct(F.flatten(F.transform("begins", lambda b: F.sequence(b, b + F.col("size") - 1))))).alias("at"))
    wanted = wanted.join(sized(placed.drop("size"), bench.rows), ["item", "at"]).select("rk", "item", "diff", "at", (F.col("diff") + F.col("at")).alias("pos"), "term_id")
    met = wanted.join(there, ["rk", "pos", "term_id"], "left_semi").groupBy("rk", "item", "diff").agg(F.collect_set("at").alias("met"))
    whole = F.filter("begins", lambda b: F.size(F.array_except(F.sequence(b, b + F.col("size") - 1), F.col("met"))) == 0)
    found = windows.join(met, ["rk", "item", "diff"]).select("rk", "item", "diff", "size", F.explode(whole).alias("begin"))
    named = found.join(sized(bench.items.select("item", "item_id"), bench.rows), "item")
    return named.select("rk", "item_id", (F.col("diff") + F.col("begin")).alias("first"), (F.col("diff") + F.col("begin") + F.col("size") - 1).alias("last"))


def _covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("last"))
    return F.aggregate(
        spans, zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], a["last"] + 1) + 1)).alias("n"), F.greatest(a["last"], s["last"]).alias("last")), lambda a: a["n"]
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted array) and contaminated of every row."""
    bench = benchmark_of(benchmark, window)
    rows, postings = index(docs, bench)
    probes, needs = probes_of(bench, postings, window)
    hits = exact(postings, bench, alignments(postings, probes, needs, bench.rows), window)
    told = hits.groupBy("rk").agg(
        _covered(F.sort_array(F.collect_set(F.struct("first", "last")))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set(F.coalesce("item_id", F.lit("")))).alias("items"),
    )
    told = materialise(told, "hits")  # from here on nothing reads the postings
    discard(postings)
    out = rows.join(F.broadcast(told) if told.count() <= BROADCAST_KEYS else told, "rk", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "rk", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def proximity(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 5) -> DataFrame:
    """(doc_id, item_id, first): rows where all probes of one of an item's windows come within ``slack`` words of their places.

    The alignment's difference is widened to blocks of ``slack`` + 1 (each posting enters its block and the next), so
    the join stays one on equal keys.
    """
    bench = benchmark_of(benchmark, window)
    rows, postings = index(docs, bench)
    probes, needs = probes_of(bench, postings, window)
    hits = postings.join(sized(probes, bench.rows), "term_id").select("rk", "item", (F.col("pos") - F.col("at")).alias("diff"), "at")
    block = F.floor(F.col("diff") / (slack + 1)).cast("int")
    near = hits.withColumn("block", F.explode(F.array(block, block + 1))).groupBy("rk", "item", "block").agg(F.collect_set("at").alias("met"), F.min("diff").alias("first"))
    whole = F.exists("needs", lambda w: F.size(F.array_except(w["ats"], F.col("met"))) == 0)
    near = near.join(sized(needs, bench.rows), "item").filter(whole).groupBy("rk", "item").agg(F.min("first").alias("first"))
    return rows.join(near, "rk").join(sized(bench.items.select("item", "item_id"), bench.rows), "item").select("doc_id", "item_id", F.col("first").cast("long").alias("first"))
