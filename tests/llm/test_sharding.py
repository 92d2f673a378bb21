"""The ring with bounded loads against keys inserted one by one, and the promises of its law."""

import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomline.llm import sharding as s
from tests.llm.helpers import docs


def one_by_one(spark, rows, shards, vnodes, slack=0.0):
    """How many rows of each arc go to each shard when every row is inserted alone: those that fit their home first."""
    places = sorted((r["pos"], r["shard"]) for r in s.ring(spark, shards, vnodes).collect())
    at = rows.select(s._position(F.lit("key"), "doc_id").alias("pos")).collect()
    arcs = sorted(bisect_left(places, (r["pos"], -1)) % len(places) for r in at)
    room, told, over = s.capacities(len(arcs), shards, slack), Counter(), []
    for arc in arcs:
        home = places[arc][1]
        if room[home]:
            room[home] -= 1
            told[arc, home] += 1
        else:
            over.append(arc)
    for arc in over:
        k = arc
        while not room[places[k][1]]:
            k = (k + 1) % len(places)
        room[places[k][1]] -= 1
        told[arc, places[k][1]] += 1
    return told, places


def check(spark, df, shards, vnodes, slack=0.0, **how):
    got = s.place(df, shards, vnodes, slack, **how)
    told, places = one_by_one(spark, df, shards, vnodes, slack)
    arcs = got.withColumn("pos", s._position(F.lit("key"), "doc_id")).collect()
    assert Counter((bisect_left(places, (r["pos"], -1)) % len(places), r["shard"]) for r in arcs) == told
    slots = defaultdict(list)
    for r in arcs:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return arcs


@pytest.mark.parametrize("n, shards, vnodes, slack", [(1000, 16, 8, 0.0), (999, 5, 3, 0.0), (7, 16, 4, 0.0), (800, 8, 16, 0.25), (1, 1, 1, 0.0)])
def test_equals_keys_inserted_one_by_one(spark, n, shards, vnodes, slack):
    rows = check(spark, docs(spark, [(k * 31 - 7, f"text {k % 10}") for k in range(n)]), shards, vnodes, slack, bucket=20)
    counts = Counter(r["shard"] for r in rows)
    loads = [counts[k] for k in range(shards)]
    assert max(loads) - min(loads) <= 1 if not slack else max(loads) <= -(-n * (1 + slack) // shards)
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(k * 31 - 7, 1 + len(f"text {k % 10}"), zlib.crc32(f"text {k % 10}".encode())) for k in range(n)}


def test_hot_key_repeated_rows_nulls(spark):
    rows = [(5, "same")] * 300 + [(5, f"other {k}") for k in range(200)] + [(None, None)] * 40 + [(None, ""), (6, "é")] + [(k, "x") for k in range(100, 200)]
    got = check(spark, docs(spark, rows), 4, 8, bucket=10)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((k, 1 + len((t or "").encode()), zlib.crc32((t or "").encode())) for k, t in rows)
    assert {r["grown_shard"] for r in got} == {None} and {r["law"] for r in got} == {"rows"}


def test_large_groups_of_repeated_rows_are_expanded_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(s, "CHUNK", 50)
    monkeypatch.setattr(s, "BROADCAST_BUCKETS", 0)
    check(spark, docs(spark, [(1, "a")] * 777 + [(2, "b")] * 50 + [(k, "c") for k in range(3, 90)]), 4, 4, bucket=30)


def test_one_more_shard_moves_little(spark):
    df = docs(spark, [(k, "x") for k in range(6000)])
    for slack, most in ((0.0, 0.2), (0.25, 0.12)):
        before, after = ({r["doc_id"]: r["shard"] for r in s.place(df, n, 128, slack).collect()} for n in (16, 17))
        assert sum(before[k] != after[k] for k in before) / len(before) < most
    away = s.place(df).filter("shard <> home").count() / 6000
    assert away < 0.1


def test_empty_table_and_clashing_columns(spark):
    assert s.place(docs(spark, [])).collect() == []
    df = docs(spark, [(k, "x") for k in range(20)]).selectExpr("*", "1 AS arc", "2 AS pos", "3 AS rank", "4 AS copies", "5 AS home")
    assert s.place(df).count() == 20


def test_too_little_room_is_told():
    with pytest.raises(ValueError):
        s.walk([0, 1], [3, 3], [2, 3])
