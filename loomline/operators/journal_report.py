"""What a report on link journals tells: save marks, texts, labels, kinds, and what the blocks did."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import quoted
from loomline.operators.asof import asof
from loomline.operators.facts import latest
from loomline.operators.store import by_id

#: Bookkeeping keys have names, cells have numbers.
IS_CELL = "^[0-9]+$"
SAVE_KEY = "savetime"


def current_texts(ops: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """(by, cell, text): the last text op of each cell or bookkeeping key, in file order; a null text is empty."""
    texts = ops.filter("kind = 's'").withColumn("b", F.coalesce("b", F.lit("")))
    return latest(texts, [*by, "a"], "b", ["block_idx", "op_idx"]).select(*by, F.col("a").alias("cell"), F.col("b").alias("text"))


def save_marks(ops: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """(by, stamp, saved, block_idx, op_idx) of the save marks whose value is all digits."""
    marks = ops.filter((F.col("kind") == "s") & (F.col("a") == SAVE_KEY) & F.col("b").rlike("^[0-9]+$"))
    return marks.select(*by, "stamp", F.col("b").try_cast("long").alias("saved"), "block_idx", "op_idx")


def saved_after(rows: DataFrame, marks: DataFrame, by: Sequence[str], tie: str) -> DataFrame:
    """Rows (by, stamp, tie) with ``saved``: the first save at or after their stamp, null after the last."""
    marks = marks.withColumn(tie, F.struct("block_idx", "op_idx"))
    keyed = rows.withColumn(tie, F.struct(F.col(tie).cast("int").alias("block_idx"), F.lit(0).alias("op_idx"))) if tie in rows.columns else rows
    return asof(keyed, marks.select(*by, "stamp", tie, "saved"), list(by), "stamp", {"saved": "saved"}, tie, forward=True)


def text_counts(ops: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """(by, n_cells, n_empty, n_keys, n_saves, first_saved, last_saved): cells and keys by their current text, marks in file order."""
    now = current_texts(ops, by)
    cell = F.col("cell").rlike(IS_CELL)
    counts = now.groupBy(*by).agg(F.count_if(cell).alias("n_cells"), F.count_if(cell & (F.col("text") == "")).alias("n_empty"), F.count_if(~cell).alias("n_keys"))
    place = F.struct("block_idx", "op_idx")
    saves = ops.filter((F.col("kind") == "s") & (F.col("a") == SAVE_KEY)).groupBy(*by).agg(F.count("*").alias("n_saves"), F.min_by("b", place).alias("first_saved"), F.max_by("b", place).alias("last_saved"))
    return counts.join(saves, list(by), "left").withColumn("n_saves", F.coalesce("n_saves", F.lit(0)))


def first_texts(texts: DataFrame, n: int) -> DataFrame:
    """The first ``n`` cells by id order, numbers by value."""
    return texts.filter(F.col("cell").rlike(IS_CELL)).orderBy(*by_id(F.col("cell"))).limit(n)


def labelled(cells: DataFrame, texts: DataFrame | None, cell: str, width: int = 40) -> DataFrame:
    """Cells with ``label``: ``#id`` without any texts at hand, else ``#id "text"``, or ``#id (empty)`` where there is none."""
    name = F.concat(F.lit("#"), F.col(cell))
    if texts is None:
        return cells.withColumn("label", name)
    known = texts.select(F.col("cell").alias(cell), F.col("text").alias("_text"))
    told = F.when(F.coalesce("_text", F.lit("")) == "", F.concat(name, F.lit(" (empty)"))).otherwise(F.concat(name, F.lit(" "), quoted(F.col("_text"), width)))
    return cells.join(known, cell, "left").withColumn("label", told).drop("_text")


def kinds(ops: DataFrame, by: Sequence[str], names: DataFrame | None = None) -> DataFrame:
    """(by, kind) of each journal: content (texts only), dimension (links only) or mixed.

    ``names`` (by, name) adds journals without any operation: one named CONTENT, in any case, is content, others dimensions.
    """
    text, link = F.bool_or(F.col("kind") == "s"), F.bool_or(F.col("kind") != "s")
    found = ops.groupBy(*by).agg(F.when(text & link, "mixed").when(text, "content").otherwise("dimension").alias("kind"))
    if names is None:
        return found
    guess = F.when(F.upper("name") == "CONTENT", "content").otherwise("dimension")
    return names.join(found, list(by), "left").select(*by, F.coalesce("kind", guess).alias("kind"))


def described(names: DataFrame, name: str, glossary: DataFrame, part: str, other: str) -> DataFrame:
    """Names with ``meaning`` from glossary (name, meaning); ``part`` for unknown ones with a colon, ``other`` for the rest."""
    known = F.broadcast(glossary.select(F.col("name").alias(name), "meaning")) if glossary.count() <= 100_000 else glossary.select(F.col("name").alias(name), "meaning")
    default = F.when(F.contains(name, F.lit(":")), part).otherwise(other)
    return names.join(known, name, "left").withColumn("meaning", F.coalesce("meaning", default))


def block_summary(narrated: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many ops of each block linked, unlinked, did nothing, wrote a cell's text or a bookkeeping key (rows of ``links.narrate`` with ``by``)."""
    cell = F.col("a").cast("string").rlike(IS_CELL)
    counts = {"n_link": F.col("outcome") == "link", "n_unlink": F.col("outcome") == "unlink", "n_noop": F.col("outcome") == "noop", "n_text": (F.col("outcome") == "text") & cell, "n_meta": (F.col("outcome") == "text") & ~cell}
    return narrated.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def is_cell(name: Column) -> Column:
    return name.rlike(IS_CELL)
