"""The report of link journals as lines of text: what each file holds, what its blocks did, and the ranks in the end.

Lines are rows (file, section, a, b, c, line) whose keys order them; ``write_lines`` writes any such rows as text files
that follow each other in that order, by several tasks.

Defined cases: a journal without operations has its overview and says that nothing was stored; a damaged one is reported up to the
damage, with a warning; null texts are empty; several journals are reported one after the other by file name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import millis_text, quoted
from loomline.operators import links
from loomline.operators.facts import top_per_group
from loomline.operators.journal_report import SAVE_KEY
from loomline.operators.scans import RANGES, scan
from loomline.sources.journal import in_order
from loomline.storage import materialise

# The names of the kinds of operations, in the order they are counted, and the phrases of the report.
KINDS = {"c": "connect", "d+": "disconnect(+)", "d-": "disconnect(-)", "s": "set-text"}
FREE_KEY, ARROW = "nextfreeid", "  →  "
OVERVIEW, HISTORY, STATE = "1. WHAT THIS FILE IS", "2. HISTORY (one block per timestamp, in file order)", "3. CURRENT STATE (after replaying every block)"
NO_BLOCKS, NO_LINKS = "(no blocks: nothing was ever stored in this file)", "No cell is linked on this dimension."

_LINE = ["file", "section", "a", "b", "c", "line"]


def _number(n: int) -> Column:
    return F.lit(n).cast("long")


def _line(section: int, a: Column | int, b: Column | int, c: Column | int, text: Column | str) -> list[Column]:
    keys = [k.cast("long") if isinstance(k, Column) else _number(k) for k in (a, b, c)]
    return ["file", F.lit(section).alias("section"), *[k.alias(n) for k, n in zip(keys, "abc", strict=True)], (text if isinstance(text, Column) else F.lit(text)).alias("line")]


def _cell(name: str | Column) -> Column:
    return F.concat(F.lit("#"), F.col(name) if isinstance(name, str) else name)


def overview(ops: DataFrame, names: DataFrame) -> DataFrame:
    """Lines of the first section for every file of ``names``, from decoded operations (with their error rows)."""
    whole = F.col("error").isNull()
    sums = ops.groupBy("file").agg(F.max("block_idx").alias("last"), F.min_by("stamp", "block_idx").alias("first_stamp"), F.max_by("stamp", "block_idx").alias("last_stamp"), F.max("error").alias("error"), *[F.count_if(whole & (F.col("kind") == k)).alias(f"n{i}") for i, k in enumerate(KINDS)])
    rows = names.select("file").distinct().join(sums, "file", "left")
    counts = F.array(*[F.when(F.col(f"n{i}") > 0, F.concat(F.lit(f"{name}="), F.col(f"n{i}"))) for i, name in enumerate(KINDS.values())])
    stamps = F.when(F.col("first_stamp").isNotNull(), F.concat(F.lit("  (stamps "), F.col("first_stamp"), F.lit(" to "), F.col("last_stamp"), F.lit(")"))).otherwise("")
    told = F.array(
        F.lit(OVERVIEW),
        F.concat(F.lit("File        : "), F.col("file")),
        F.concat(F.lit("Blocks      : "), F.coalesce(F.col("last") + 1, F.lit(0)), stamps),
        F.when(F.size(F.array_compact(counts)) > 0, F.concat(F.lit("Operations  : "), F.array_join(counts, ", "))),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("WARNING - the file could not be read to the end: "), F.col("error"))),
    )
    return rows.select("file", F.posexplode(told).alias("at", "text")).filter("text IS NOT NULL").select(*_line(1, F.col("at"), 0, 0, F.col("text")))


def _numbered(ops: DataFrame) -> DataFrame:
    """Operations in the order of their replay, with ``n`` over all files."""
    rows = in_order(ops).filter("kind IS NOT NULL")
    return materialise(scan(rows, [], ["file", "seq"], sums={"n": F.lit(1).cast("long")}, split=RANGES), "operations")


def _told(ops: DataFrame) -> DataFrame:
    """(file, block_idx, stamp, n, outcome, line): every operation with the sentence that says what it did."""
    def here(c: str) -> Column:
        return F.struct("file", F.col(c).alias("cell"))

    did = links.narrate(ops.select("kind", here("a").alias("a"), here("b").alias("b"), F.col("n").alias("seq")))
    texts = scan(ops.filter("kind = 's'"), ["file", "a"], ["n"], before={"old": F.coalesce("b", F.lit(""))}, split=RANGES).select("n", "old")
    rows = ops.join(did.select(F.col("seq").alias("n"), "outcome", F.col("detached_next.cell").alias("next"), F.col("detached_prev.cell").alias("prev")), "n").join(texts, "n", "left")
    gone = F.array_join(F.array(F.concat(F.lit("its old + neighbour "), _cell("next"), F.lit(" was detached")), F.concat(_cell("b"), F.lit("'s old - neighbour "), _cell("prev"), F.lit(" was detached"))), "; ")
    sign, side = F.substring("kind", 2, 1), F.coalesce("next", "prev")
    text = F.coalesce("b", F.lit(""))
    saved = F.when(text.rlike("^[0-9]+$"), millis_text(text.try_cast("long"))).otherwise(text)
    line = (
        F.when((F.col("kind") == "c") & (F.col("outcome") == "noop"), F.concat(F.lit("Link "), _cell("a"), F.lit(ARROW), _cell("b"), F.lit(" (already linked, no change)")))
        .when(F.col("kind") == "c", F.concat(F.lit("Link "), _cell("a"), F.lit(ARROW), _cell("b"), F.when(gone != "", F.concat(F.lit("   ("), gone, F.lit(")"))).otherwise("")))
        .when(F.col("outcome") == "noop", F.concat(F.lit("Unlink "), _cell("a"), F.lit(": it had no "), sign, F.lit(" neighbour, so nothing changed")))
        .when(F.col("outcome") == "unlink", F.concat(F.lit("Unlink "), _cell("a"), F.lit(" from its "), sign, F.lit(" neighbour "), _cell(side)))
        .when(F.col("a") == SAVE_KEY, F.concat(F.lit("Save time recorded: "), saved))
        .when(F.col("a") == FREE_KEY, F.concat(F.lit("Next free cell ID is now "), text, F.when(F.coalesce("old", F.lit("")) != "", F.concat(F.lit(" (was "), F.col("old"), F.lit(")"))).otherwise("")))
        .when(F.col("old").isNull(), F.concat(F.lit("Set text of "), _cell("a"), F.lit(" to "), quoted(text, 60)))
        .otherwise(F.concat(F.lit("Change text of "), _cell("a"), F.lit(" from "), quoted(F.col("old"), 40), F.lit(" to "), quoted(text, 40)))
    )
    outcome = F.when(F.col("a").isin(SAVE_KEY, FREE_KEY) & (F.col("kind") == "s"), "meta").otherwise(F.col("outcome"))
    return rows.select("file", "block_idx", "stamp", "n", outcome.alias("outcome"), line.alias("line"))


def history(ops: DataFrame, names: DataFrame, most: int = 12) -> DataFrame:
    """Lines of the second section: each block's stamp and sums, and its first ``most`` operations."""
    told = materialise(_told(_numbered(ops)), "told")
    sums = told.groupBy("file", "block_idx", "stamp", "outcome").agg(F.count("*").alias("k"), F.min("n").alias("first"))
    parts = F.array_sort(F.collect_list(F.struct("first", F.concat(F.col("k"), F.lit(" "), F.col("outcome")).alias("t"))))
    blocks = sums.groupBy("file", "block_idx", "stamp").agg(F.sum("k").alias("n"), F.array_join(F.transform(parts, lambda p: p["t"]), ", ").alias("summary"))
    head = blocks.select(*_line(2, F.col("block_idx"), 0, 0, F.concat(F.lit("Stamp "), F.col("stamp"), F.lit("  -  "), F.col("n"), F.lit(" operation(s): "), F.col("summary"))))
    shown = top_per_group(told, ["file", "block_idx"], [F.col("n")], most).select(*_line(2, F.col("block_idx"), 1, F.col("n"), F.concat(F.lit("   "), F.col("line"))))
    more = blocks.filter(F.col("n") > most).select(*_line(2, F.col("block_idx"), 2, 0, F.concat(F.lit("   … and "), F.col("n") - most, F.lit(" more"))))
    title = names.select("file").distinct().select(*_line(2, -1, 0, 0, HISTORY))
    empty = names.select("file").distinct().join(told.select("file").distinct(), "file", "left_anti").select(*_line(2, 0, 0, 0, NO_BLOCKS))
    return title.union(head).union(shown).union(more).union(empty)


def state(ops: DataFrame, names: DataFrame, most: int = 12) -> DataFrame:
    """Lines of the third section: sums over the ranks, their lengths, and the ranks, longest first, their middles elided."""
    def node(c: str) -> Column:
        return F.concat("file", F.lit("\0"), c)

    moves = _numbered(ops).filter("kind <> 's'").select("kind", node("a").alias("a"), node("b").alias("b"), F.col("n").alias("seq"))
    edges = materialise(links.replay(moves), "edges")
    ranked = materialise(links.ranks(edges), "ranks")
    file, cell = (F.substring_index(F.col(c), "\0", k) for c, k in (("head", 1), ("node", -1)))
    lengths = materialise(links.lengths(ranked).withColumn("file", file), "lengths")
    sums = lengths.groupBy("file").agg(F.sum("len").alias("cells"), F.count("*").alias("ranks"), F.count_if("is_circular").alias("rings"))
    linear = F.col("ranks") - F.col("rings")
    records = edges.groupBy(F.substring_index("src", "\0", 1).alias("file")).agg(F.count("*").alias("records"))
    top = F.array(
        F.concat(F.lit("Linked cells  : "), F.col("cells")),
        F.concat(F.lit("Ranks         : "), F.col("ranks"), F.lit("  ("), linear, F.lit(" linear, "), F.col("rings"), F.lit(" circular)")),
        F.concat(F.lit("Link records  : "), F.col("records")),
    )
    lines = sums.join(records, "file").select("file", F.posexplode(top).alias("at", "text")).select(*_line(3, 1, F.col("at"), 0, F.col("text")))
    sizes = lengths.groupBy("file", "len").agg(F.count("*").alias("k"))
    sizes = top_per_group(sizes, ["file"], [F.col("len")], most).select(*_line(3, 2, F.col("len"), 0, F.concat(F.lit("Rank lengths  : "), F.col("k"), F.lit(" rank(s) of "), F.col("len"), F.lit(" cells"))))
    parts = links.elide(ranked, most).withColumn("text", F.when(F.col("node").isNull(), F.concat(F.lit("… "), F.col("hidden"), F.lit(" more cells …"))).otherwise(_cell(cell)))
    chain = parts.groupBy("head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), ARROW).alias("text"))
    chain = chain.join(lengths, "head")
    ring = F.when(F.col("is_circular"), ", circular").otherwise("")
    # longest first; of one length numeric heads by value, so their order is told by a padded name
    first = F.substring_index("head", "\0", -1)
    order = [F.desc("len"), (~first.rlike("^[0-9]+$")).cast("int"), F.lpad(first, 40, "0"), first]
    chain = scan(chain.select("file", "text", "len", ring.alias("ring"), *[c.alias(f"k{i}") for i, c in enumerate([-F.col("len"), *order[1:]])]), ["file"], ["k0", "k1", "k2", "k3"], sums={"place": F.lit(1)}, split=RANGES)
    ranks = chain.select(*_line(3, 3, F.col("place"), 0, F.concat(F.lit("Rank "), F.col("place"), F.lit(" ("), F.col("len"), F.lit(" cells"), F.col("ring"), F.lit("): "), F.col("text"))))
    title = names.select("file").distinct().select(*_line(3, 0, 0, 0, STATE))
    empty = names.select("file").distinct().join(sums.select("file"), "file", "left_anti").select(*_line(3, 1, 0, 0, NO_LINKS))
    return title.union(lines).union(sizes).union(ranks).union(empty)


def report(ops: DataFrame, names: DataFrame, most: int = 12) -> DataFrame:
    """All lines of the reports on decoded journals (``sources.journal.operations``); ``names`` (file) adds those without any row."""
    names = materialise(names.select("file").union(ops.select("file")).distinct(), "files")
    return overview(ops, names).union(history(ops, names, most)).union(state(ops, names, most))


def write_lines(lines: DataFrame, path: str, order: Sequence[str] = tuple(_LINE[:-1]), text: str = "line", files: int | None = None, whole: int | None = None) -> None:
    """``text`` of all rows in ``order`` as text files (as many as their size asks for, or up to ``files``), whose names
    follow that order: read one after the other they are the whole. Rows that agree in the first ``whole`` columns of
    ``order`` are never parted by the end of a file."""
    along = order[:whole]
    ranged = lines.repartitionByRange(files, *along) if files else lines.repartitionByRange(*along)
    ranged.sortWithinPartitions(*order).select(F.col(text).alias("value")).write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, line) of what ``write_lines`` wrote, numbered from 1."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("part"), F.monotonically_increasing_id().alias("at"))
    rows = materialise(rows, "lines")  # a task reads whole files or blocks of one in order, so ``at`` grows within a file
    return scan(rows, [], ["part", "at"], sums={"number": F.lit(1).cast("long")}, split=RANGES).select("number", F.col("value").alias("line"))
