"""Comment threads as text: links inside blocks, lists, quoting, totals and the pages of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import iso_minute
from loomline.operators import trees

BLOCKS = "array<struct<depth:int,type:string,text:string>>"


def with_links(text: Column, spans: Column) -> Column:
    """Spans (array of start, end, link; offsets in code points) of a text as ``[words](link)``, put in from the right, and trimmed."""
    ordered = F.reverse(F.array_sort(spans))

    def put(t: Column, s: Column) -> Column:
        middle = F.substring(t, s["start"] + 1, s["end"] - s["start"])
        return F.concat(F.substring(t, F.lit(1), s["start"]), F.lit("["), middle, F.lit("]("), s["link"], F.lit(")"), F.substring(t, s["end"] + 1, F.length(t)))

    return F.regexp_replace(F.aggregate(ordered, F.coalesce(text, F.lit("")), put), r"^\s+|\s+$", "")


def body_lines(blocks: Column) -> Column:
    """Lines of a comment's blocks (BLOCKS, without blank texts).

    More than three blocks, of which all but the first have under 30 characters, are a list under the first. Else a
    heading is bold and a block of its own, an indented block an item, any other a paragraph.
    """
    rest = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))
    listed = F.concat(F.array(F.get(blocks, 0)["text"], F.lit("")), F.transform(rest, lambda b: F.concat(F.lit("- "), b["text"])))

    def lines(b: Column) -> Column:
        indent = F.repeat(F.lit("  "), b["depth"])
        head = F.array(F.concat(indent, F.lit("**"), b["text"], F.lit("**")), F.lit(""))
        return F.when(b["type"] == "Heading", head).when(b["depth"] > 0, F.array(F.concat(indent, F.lit("- "), b["text"]))).otherwise(F.array(b["text"], F.lit("")))

    plain = F.flatten(F.transform(blocks, lines))
    ended = F.when(F.try_element_at(plain, F.lit(-1)) == "", F.slice(plain, F.lit(1), F.size(plain) - 1)).otherwise(plain)
    return F.when((F.size(blocks) > 3) & F.forall(rest, lambda b: F.length(b["text"]) < 30), listed).otherwise(ended)


def quoted_lines(lines: Column, depth: Column) -> Column:
    """Lines behind ``> `` for every level, without blanks at their ends."""
    return F.transform(lines, lambda x: F.regexp_replace(F.concat(F.repeat(F.lit("> "), depth), x), r"\s+$", ""))


def produces(kind: Column, text: Column, link: Column) -> Column:
    """Whether a block makes a paragraph: by its type it needs words, any text, a link, or either."""
    kind, text, link = F.coalesce(kind, F.lit("Paragraph")), F.coalesce(text, F.lit("")), F.coalesce(link, F.lit(""))
    words = F.trim(text) != ""
    return F.when(kind.isin("Heading", "Paragraph"), words).when(kind.isin("Code", "Math"), text != "").when(kind.isin("Image", "Video", "File", "Embed"), link != "").otherwise(words | (link != ""))


def paragraph_ids(blocks: DataFrame, by: str, order: str) -> DataFrame:
    """Blocks (by, order, block_id, type, text, link) that make paragraphs, named by their id or, without one, ``p`` and their number among those."""
    kept = blocks.filter(produces(F.col("type"), F.col("text"), F.col("link")))
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return kept.withColumn("paragraph", F.coalesce(F.nullif("block_id", F.lit("")), F.concat(F.lit("p"), n)))


def reply_classes(comments: DataFrame) -> DataFrame:
    """Comments (file, id, parent) with ``reply``: top, reply (its parent is there) or orphan (its parent is not)."""
    there = comments.select("file", F.col("id").alias("parent"), F.lit(True).alias("_there")).distinct()
    asked = F.coalesce("parent", F.lit("")) != ""
    return comments.join(there, ["file", "parent"], "left").withColumn("reply", F.when(~asked, "top").when(F.col("_there"), "reply").otherwise("orphan")).select(*comments.columns, "reply")


def totals(comments: DataFrame) -> DataFrame:
    """(file, n_comments, n_threads, targets): a thread begins where no parent is or none is there; targets sorted, without repeats."""
    told = reply_classes(comments)
    target = F.when(F.coalesce("target", F.lit("")) != "", F.col("target"))
    return told.groupBy("file").agg(F.count("*").alias("n_comments"), F.count_if(F.col("reply") != "reply").alias("n_threads"), F.sort_array(F.collect_set(target)).alias("targets"))


def markdown(comments: DataFrame) -> DataFrame:
    """(file, text): comments (file, id, parent, author, created, place, target, blocks) of each file as nested quotes, thread by thread.

    Siblings and threads are in the order of their time, then place. Comments on a reply cycle, which no thread reaches,
    come last, without nesting. A file's page is one value: an export is the unit of output.
    """
    key = F.struct("file", "id")
    nodes = comments.select(key.alias("id"), F.when(F.coalesce("parent", F.lit("")) != "", F.struct("file", F.col("parent").alias("id"))).alias("parent"), F.struct("created", "place").alias("sort"))
    placed = trees.preorder(nodes).select("id.file", "id.id", "root", F.coalesce("depth", F.lit(0)).alias("depth"), F.when(F.col("root").isNotNull(), F.struct("root_sort", "root", "pos")).alias("path"))
    time = F.when(F.col("created") == "", "unknown time").otherwise(iso_minute(F.col("created")))
    head = F.array(F.concat(F.lit("**"), F.col("author"), F.lit("** · "), time), F.lit(""))
    rows = comments.join(placed, ["file", "id"]).withColumn("lines", quoted_lines(F.concat(head, body_lines(F.col("blocks")), F.array(F.lit(""))), F.col("depth")))
    thread = rows.groupBy("file", "root").agg(F.sort_array(F.collect_list(F.struct("path", "created", "place", "lines"))).alias("parts"))
    thread = thread.select("file", F.col("root").isNull().alias("lost"), F.get("parts", 0)["path"].alias("path"), F.flatten(F.transform("parts", lambda p: p["lines"])).alias("lines"))
    pages = thread.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("lost", "path", "lines"))).alias("threads"))

    def section(t: Column, k: Column) -> Column:
        title = F.when(t["lost"], "## Unreachable").otherwise(F.concat(F.lit("## Thread "), k + 1))
        return F.concat(F.array(title, F.lit("")), t["lines"], F.array(F.lit("---"), F.lit("")))

    sums = totals(comments)
    one = F.size("targets") == 1
    title = F.concat(F.lit("# Comments"), F.when(one, F.concat(F.lit(": "), F.get("targets", 0))).otherwise(""))
    named = F.when(one, F.concat(F.lit("Target: `"), F.get("targets", 0), F.lit("`"))).otherwise(F.concat(F.lit("Targets: "), F.array_join(F.transform("targets", lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", ")))
    intro = F.when(F.size("targets") > 0, F.array(named, F.lit(""))).otherwise(F.array().cast("array<string>"))
    count = F.concat(F.col("n_comments"), F.lit(" comments in "), F.col("n_threads"), F.lit(" threads. Replies are nested with `>` blockquotes."))
    top = F.concat(F.array(title, F.lit("")), intro, F.array(count, F.lit(""), F.lit("---"), F.lit("")))
    lines = F.concat(top, F.flatten(F.transform("threads", section)))
    return pages.join(sums, "file").select("file", F.concat(F.regexp_replace(F.array_join(lines, "\n"), r"\s+$", ""), F.lit("\n")).alias("text"))
