"""Requests and files before anything reads them: bodies, status codes, envelopes, encodings and includes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.storage import discard, materialise

# The status that each error is answered with.
STATUS = {
    "self_link_forbidden": 400,
    "validation_error": 400,
    "unknown_structure": 404,
    "unknown_cell": 404,
    "unknown_dimension": 404,
    "no_such_connection": 404,
    "foreign_cell_not_found": 404,
    "duplicate_dimension": 409,
    "restriction_r_violation": 409,
    "revision_conflict": 409,
}


def status_of(code: Column) -> Column:
    """The status of an error code: 400 for codes that aren't known, 200 for ok."""
    known = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.when(code == "ok", 200).otherwise(F.coalesce(F.try_element_at(known, code), F.lit(400)))


def _typed(body: Column, field: str, kinds: tuple[str, ...]) -> Column:
    """A field of a JSON object where its value is of one of the kinds (as schema_of_variant names them), else null."""
    value = F.try_variant_get(F.try_parse_json(body), f"$.{field}", "variant")
    return F.when(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0).isin(*kinds), value)


def required_string(body: Column, field: str) -> Column:
    """(ok, value, message): the field must be a string and not empty."""
    value = F.try_variant_get(_typed(body, field, ("STRING",)), "$", "string")
    ok = F.coalesce(value != "", F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("value"), F.when(~ok, f'"{field}" must be a non-empty string').alias("message"))


def optional_boolean(body: Column, field: str) -> Column:
    """The field where it is a boolean; anything else counts as not given."""
    return F.try_variant_get(_typed(body, field, ("BOOLEAN",)), "$", "boolean")


def optional_number(body: Column, field: str) -> Column:
    """The field where it is a number; anything else counts as not given."""
    return F.try_variant_get(_typed(body, field, ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")), "$", "double")


def payload(body: Column) -> Column:
    """What an envelope holds under ``json``, as text; null where there is nothing to decode."""
    return F.get_json_object(body, "$.json")


def decoded(content: Column) -> Column:
    """(text, encoding) of bytes: UTF-8, else Latin-1."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.when(utf8, F.struct(F.decode(content, "UTF-8").alias("text"), F.lit("utf-8").alias("encoding"))).otherwise(F.struct(F.decode(content, "ISO-8859-1").alias("text"), F.lit("latin-1").alias("encoding")))


def included(line: Column) -> Column:
    """The name that a line ``#include "NAME"`` (in either quotes) brings in; null for other lines."""
    after = F.ltrim(F.substring(line, F.lit(9), F.length(line)))
    quote, rest = F.substring(after, 1, 1), F.substring(after, F.lit(2), F.length(after))
    shaped = F.startswith(line, F.lit("#include")) & F.substring(line, 9, 1).isin(" ", "\t") & quote.isin("'", '"') & (F.locate('"', rest) + F.locate("'", rest) > 0) & F.contains(rest, quote)
    return F.when(shaped, F.split_part(rest, quote, F.lit(1)))


def expand_includes(files: DataFrame, keep: Column | None = None, depth: int = 6) -> DataFrame:
    """Lines (file, path, line) of files (file, line_no, line) with include lines replaced by the lines of the named file, ``depth`` deep.

    Deeper includes, those of files that aren't there and those that ``keep`` (of ``name``) names, such as setup files,
    stay as they are. A line is placed by the array of line numbers on the way to it, so the order needs no state.
    """
    base = materialise(files.select("file", "line_no", "line", included(F.col("line")).alias("name")), "lines")
    here = base.select("file", F.array("line_no").alias("path"), "line", "name")
    inner = base.select(F.col("file").alias("name"), F.col("line_no").alias("_n"), F.col("line").alias("_line"), F.col("name").alias("_name"))
    there = base.select(F.col("file").alias("name")).distinct()
    for _ in range(depth):
        asked = here.filter(F.col("name").isNotNull() & ~(F.lit(False) if keep is None else F.coalesce(keep, F.lit(False))))
        wanted = asked.join(there, "name", "left_semi")
        rest = here.join(wanted.select("file", "path"), ["file", "path"], "left_anti")
        grown = wanted.drop("line").join(inner, "name").select("file", F.concat("path", F.array("_n")).alias("path"), F.col("_line").alias("line"), F.col("_name").alias("name"))
        before, here = here, materialise(rest.select("file", "path", "line", "name").union(grown), "expanded")
        discard(before)
    return here.select("file", "path", "line")
