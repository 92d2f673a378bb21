"""Facts with history: current values, trails, connections and references.

Defined cases: null keys are one key where rows are grouped (latest, trail, histories, movements, top rows) and match
nothing where rows refer (pull, resolve, label_refs, access_status; ``find_or_create`` makes a null key like any other
that isn't there, ``find_or_create_compound`` finds it); a null value is a value in ``latest`` and histories, and left out
of ``trail``; of rows that tie in ``order`` any one may count, so it should end with a unique column; repeated rows count
each, but in sets (both_ways, members, find_or_create) once; a row of ``upsert`` whose fields are null changes nothing;
empty tables give no rows. Columns whose names begin with an underscore are the operators' own; any other name of a
caller's is kept, but for one that an output is named like, which is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The last write of each key: one aggregation with partial sums, no sort."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def trail(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Keys whose value changed, with all values in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    out = df.groupBy(*by).agg(F.countDistinct(value).alias("n_values"), F.array_join(F.transform(rows, lambda r: r["_value"].cast("string")), ">").alias("trail"))
    return out.filter("n_values > 1")


def without_repeats(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """History rows without those that assert the value that already held."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_before", before).filter(~F.col("_before").eqNullSafe(F.col(value)) | F.col("_before").isNull()).drop("_before")


def both_ways(edges: DataFrame, a: str = "a", b: str = "b", keep: Sequence[str] = ()) -> DataFrame:
    """(node, other) and ``keep`` (a connection's type) seen from either end, as a set: parallel ones of one type count once."""
    return edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *keep).union(edges.select(b, a, *keep)).distinct()


def move_items(moves: DataFrame, reason: str = "relocated") -> tuple[DataFrame, DataFrame]:
    """Movements (item, seq, to, reason) with ``from_place`` (null on the first), and where each item is now (item, place)."""
    w = Window.partitionBy("item").orderBy("seq")
    told = moves.withColumn("from_place", F.lag("to").over(w)).withColumn("reason", F.coalesce("reason", F.lit(reason)))
    return told, moves.groupBy("item").agg(F.max_by("to", "seq").alias("place"))


def history_at(moves: DataFrame, instants: DataFrame) -> DataFrame:
    """(item, to, at) of the movements that changed an item's place, with the instant of their transaction (seq, at).

    A movement to where the item already is asserts nothing new; equal places at one instant count once.
    """
    return without_repeats(moves, ["item"], "to", ["seq"]).join(instants, "seq").select("item", "to", "at").distinct()


def pull(items: DataFrame, ref: str, places: DataFrame, key: str, fields: Sequence[str], name: str) -> DataFrame:
    """Items with the row they refer to as a struct ``name`` of its fields; null where it refers to nothing that is there."""
    inner = places.select(F.col(key).alias(ref), F.struct(*fields).alias(name))
    return items.join(inner, ref, "left")


def find_or_create_compound(wanted: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``find_or_create`` for cells keyed by several columns; null keys are keys."""
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    made = find_or_create(wanted.select(key.alias("_key")), existing.select(key.alias("_key")), "_key")
    return wanted.select(*keys, key.alias("_key")).distinct().join(made, "_key").drop("_key")


def members(df: DataFrame, owner: str, array: str, name: str) -> DataFrame:
    """(owner, member) of an array column, as a set."""
    return df.select(owner, F.explode(array).alias(name)).distinct()


def resolve(refs: DataFrame, ref: str, tables: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """A polymorphic reference: the first table of (kind, table, key, label) that has it gives kind and label."""
    out, kinds, labels = refs, [], []
    for k, (kind, table, key, label) in enumerate(tables):
        out = out.join(table.select(F.col(key).alias(f"_k{k}"), F.col(label).alias(f"_l{k}")), F.col(ref) == F.col(f"_k{k}"), "left")
        kinds.append(F.when(F.col(f"_k{k}").isNotNull(), F.lit(kind)))
        labels.append(F.col(f"_l{k}"))
    return out.select(*refs.columns, F.coalesce(*kinds).alias("kind"), F.coalesce(*labels).alias("label"))


def find_or_create(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key, created): each wanted key once, and whether it had to be made."""
    there = existing.select(key).distinct().withColumn("_there", F.lit(True))
    return wanted.select(key).distinct().join(there, key, "left").select(key, F.col("_there").isNull().alias("created"))


def first_found(candidates: DataFrame, by: Sequence[str], priority: str, found: Column) -> DataFrame:
    """Of the candidates that were found, the one of least priority for each key."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(priority))
    return candidates.filter(found).withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each group, each with ``hidden``: how many more the group has.

    Groups are counted by partial sums, and of each group only n rows of every task are shuffled, however large it is.
    """
    kept = [c for c in df.columns if c != "hidden"]
    first = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n)
    sizes = df.groupBy(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)]).agg(F.count("*").alias("_n"))
    same = F.lit(True)
    for k, c in enumerate(by):
        same &= first[c].eqNullSafe(sizes[f"_by{k}"])
    return first.join(sizes, same).select(*[first[c] for c in kept], F.greatest(F.col("_n") - n, F.lit(0)).alias("hidden"))


def upsert(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """A shallow merge: fields of the patch override where they aren't null; new keys come in."""
    fields = [c for c in base.columns if c != key]
    other = patch.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return base.join(other, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in fields])


def access_status(requests: DataFrame, users: DataFrame, structures: DataFrame, writing: Column) -> DataFrame:
    """Requests (header, owner) with ``status``, in this order: 401 unknown caller, 404 unknown owner, 403 writing another's, 200."""
    caller = F.regexp_extract("header", "(?i)^Bearer\\s+(.+)$", 1)
    known = users.select(F.col("user").alias("_user")).distinct()
    there = structures.select(F.col("owner").alias("owner"), F.lit(True).alias("_there")).distinct()
    rows = requests.withColumn("_caller", caller).join(known, F.col("_caller") == F.col("_user"), "left").join(there, "owner", "left")
    status = F.when(F.col("_user").isNull(), 401).when(F.col("_there").isNull(), 404).when(writing & (F.col("_user") != F.col("owner")), 403).otherwise(200)
    return rows.withColumn("status", status).drop("_caller", "_user", "_there")


def verified(content: DataFrame, expected: DataFrame, key: str, text: str, digest: str) -> DataFrame:
    """(key, state): verified, corrupted or new, by SHA-256."""
    rows = content.select(key, F.sha2(text, 256).alias("_is")).join(expected.select(key, F.col(digest).alias("_should")), key, "left")
    return rows.select(key, F.when(F.col("_should").isNull(), "new").when(F.col("_is") == F.col("_should"), "verified").otherwise("corrupted").alias("state"))


def label_refs(refs: DataFrame, labels: DataFrame, ref: str) -> tuple[DataFrame, DataFrame]:
    """References with the ``number`` their label (label, number) has, ``?`` where there is none; and the unresolved ones (ref, n)."""
    told = refs.join(labels.select(F.col("label").alias(ref), F.col("number").alias("_number")), ref, "left")
    missing = told.filter("_number IS NULL").groupBy(ref).agg(F.count("*").alias("n"))
    return told.withColumn("number", F.coalesce("_number", F.lit("?"))).drop("_number"), missing
