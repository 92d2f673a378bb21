"""Cell stores as text: pairs of lines ``KEY=…`` and ``VAL=…`` that hold every cell's text and both ends of every link.

A file is read in blocks by several tasks; which key a value belongs to is told by the line before it, across the blocks by a
scan in ranges. Keys are ``number|slice`` for cells, and a cell followed by ``+d.name`` or ``-d.name`` for its link on that
side of a dimension.

Defined cases: line ends may be CR LF or LF, and blank lines are skipped; bytes are Windows-1252; ``^n`` in a value is a
line feed; an empty value is an empty text; a value without key, a key without value and any other line are problems,
and everything else is read; a key told twice counts as often as it is there, ``current`` keeps the last; an empty file
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.scans import RANGES, scan
from loomline.storage import materialise

# Fixed values of the format: how the two lines begin, the escape of a line feed, and how a link's key is built.
KEY, VAL, LINE_FEED, LINK = "KEY=", "VAL=", "^n", r"^(.+)([+-])(d[.].+)$"


#: What bytes 80 to 9F are in Windows-1252; the five that it leaves open stay control characters.
_UPPER = "".join(chr(b) for b in range(0x80, 0xA0))
_WINDOWS = "".join(bytes([ord(c)]).decode("cp1252", "ignore") or c for c in _UPPER)


def _decoded(line: str) -> Column:
    """Bytes that were read as text: Latin-1, but for those 32 characters."""
    return F.translate(F.decode(F.col(line).cast("binary"), "ISO-8859-1"), _UPPER, _WINDOWS)


def read_records(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, place, key, value, problem) of the stores under ``path``; ``place`` orders a file's records."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace(_decoded("value"), "\r$", "").alias("line"))
    # within a block a task reads line after line, so ``at`` grows there; written, so that it is told once
    lines = materialise(lines.filter(F.trim("line") != ""), "lines")
    rows = scan(lines, ["file"], ["block", "at"], sums={"place": F.lit(1).cast("long")}, before={"prior": F.col("line")}, split=RANGES)
    last = rows.groupBy("file").agg(F.max_by(F.struct("place", "line"), "place").alias("end")).select("file", (F.col("end.place") + 1).alias("place"), F.col("end.line").alias("prior"))
    rows = rows.select("file", "place", "line", "prior").union(last.select("file", "place", F.lit(None).cast("string"), "prior"))

    def body(line: str) -> Column:
        return F.substring(line, F.lit(5), F.length(line))

    is_key, is_val, after_key = (F.coalesce(F.startswith(c, F.lit(t)), F.lit(False)) for c, t in (("line", KEY), ("line", VAL), ("prior", KEY)))
    pair = F.struct(body("prior").alias("key"), F.replace(body("line"), F.lit(LINE_FEED), F.lit("\n")).alias("value"), F.lit(None).cast("string").alias("problem"))

    def trouble(key: Column, text: str) -> Column:
        return F.struct(key.alias("key"), F.lit(None).cast("string").alias("value"), F.lit(text).alias("problem"))

    none = F.lit(None).cast("string")
    told = F.array_compact(F.array(
        F.when(is_val & after_key, pair),
        F.when(is_val & ~after_key, trouble(none, "a value without key")),
        F.when(after_key & ~is_val, trouble(body("prior"), "a key without value")),
        F.when(F.col("line").isNotNull() & ~is_val & ~is_key, trouble(none, "no such line")),
    ))
    return rows.select("file", "place", F.inline(told))


def current(records: DataFrame) -> DataFrame:
    """The last record of each key that has no problem."""
    sound = records.filter("problem IS NULL")
    return sound.groupBy("file", "key").agg(F.max_by("value", "place").alias("value"))


def cells(records: DataFrame) -> DataFrame:
    """(file, cell, number, slice, text) of records (file, key, value) that are no links."""
    rows = records.filter(F.col("value").isNotNull() & ~F.col("key").rlike(LINK))
    return rows.select("file", F.col("key").alias("cell"), F.substring_index("key", "|", 1).try_cast("long").alias("number"), F.when(F.contains("key", F.lit("|")), F.regexp_extract("key", r"^[^|]*[|](.*)$", 1)).alias("slice"), F.col("value").alias("text"))


def connections(records: DataFrame) -> DataFrame:
    """(ownerId, dimensionId, cellId, negwardId, poswardId): both ends of the links, as ``documents.mirrored`` and ``half_links`` read them."""
    rows = records.filter(F.col("value").isNotNull() & F.col("key").rlike(LINK))
    part = [F.regexp_extract("key", LINK, k) for k in (1, 2, 3)]
    side = [F.when(part[1] == s, F.col("value")) for s in "-+"]
    return rows.select(F.col("file").alias("ownerId"), part[2].alias("dimensionId"), part[0].alias("cellId"), side[0].alias("negwardId"), side[1].alias("poswardId"))
