"""Operators on small fixtures, against plain sequential models."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import clocks, facts, links, trees, usage, versions
from loomline.operators.asof import asof


def test_asof_ties_and_missing(spark):
    left = spark.createDataFrame([(1, 10, 100), (1, 5, 101), (2, 1, 102), (1, 7, 103)], "k int, t int, id int")
    right = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 9, 3), (3, 0, 4)], "k int, t int, id int")

    def got(**options):
        return {r["id"]: r["m"] for r in asof(left, right, ["k"], "t", {"id": "m"}, "id", **options).collect()}

    assert got() == {100: 3, 101: None, 102: None, 103: 2}
    assert got(clamp=True) == {100: 3, 101: 1, 102: None, 103: 2}
    assert got(forward=True) == {100: None, 101: 1, 102: None, 103: 1}


def model(ops):
    forward, backward = {}, {}
    for kind, a, b in ops:
        if kind == "c":
            if a in forward:
                backward.pop(forward.pop(a))
            if b in backward:
                forward.pop(backward.pop(b))
            forward[a], backward[b] = b, a
        elif kind == "d+" and a in forward:
            backward.pop(forward.pop(a))
        elif kind == "d-" and a in backward:
            forward.pop(backward.pop(a))
    return set(forward.items())


@pytest.mark.parametrize("seed", range(4))
def test_replay_is_the_sequential_model(spark, seed):
    rng = random.Random(seed)
    ops = [(rng.choice(["c", "c", "d+", "d-"]), str(rng.randrange(8)), str(rng.randrange(8))) for _ in range(60)]
    rows = [(k, kind, a, b if kind == "c" else None) for k, (kind, a, b) in enumerate(ops)]
    got = links.replay(spark.createDataFrame(rows, "seq long, kind string, a string, b string").repartition(3))
    assert {(r["src"], r["dst"]) for r in got.collect()} == model(ops)
    assert links.broken(got).count() == 0


def test_ranks_of_chains_rings_and_single_nodes(spark):
    edges = [("1", "2"), ("2", "3"), ("9", "10"), ("10", "100"), ("100", "9"), ("7", "7")] + [(f"c{k:03}", f"c{k + 1:03}") for k in range(70)]
    got = links.ranks(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("alone",)], "node string"))
    by = {r["node"]: (r["head"], r["pos"], r["is_circular"]) for r in got.collect()}
    assert [by[n] for n in ("1", "2", "3")] == [("1", 0, False), ("1", 1, False), ("1", 2, False)]
    assert by["9"] == ("9", 0, True) and by["10"] == ("9", 1, True) and by["100"] == ("9", 2, True)
    assert by["7"] == ("7", 0, True) and by["alone"] == ("alone", 0, False) and by["c070"] == ("c000", 70, False)
    linear = [r for r in by.values() if not r[2]]
    assert len(linear) == sum(1 for r in linear if r[1] == 0) + 2 + 70  # cells = ranks + links
    shown = links.elide(got.filter("head = 'c000'"), 10).orderBy("pos").collect()
    assert [r["node"] for r in shown] == [*(f"c{k:03}" for k in range(7)), None, "c068", "c069", "c070"] and shown[7]["hidden"] == 61
    assert links.ranks(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_containers(spark):
    edges = spark.createDataFrame([("big", "small"), ("small", "comic"), ("x", "y"), ("y", "x")], "container string, thing string")
    got = {tuple(r) for r in trees.closure(edges).collect()}
    assert {t for c, t in got if c == "big"} == {"small", "comic"} and ("x", "x") in got


def test_threads(spark):
    rows = [("a", None, "2"), ("b", "a", "3"), ("c", "a", "1"), ("d", "b", "0"), ("e", "gone", "1"), ("p", "q", "1"), ("q", "p", "1")]
    got = trees.preorder(spark.createDataFrame(rows, "id string, parent string, sort string")).orderBy("root_sort", "root", "pos").collect()
    assert [(r["id"], r["depth"]) for r in got if r["root"]] == [("e", 0), ("a", 0), ("c", 1), ("b", 1), ("d", 2)]
    assert {r["id"] for r in got if r["root"] is None} == {"p", "q"}


def test_views(spark):
    cells = spark.createDataFrame([(k,) for k in range(6)], "cell int")
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3), (0, 3, 2), (1, 2, 99), (1, 99, 4), (0, 5, 0)], "axis int, src int, dst int")
    got = {r["cell"]: (r["x"], r["y"]) for r in trees.grid_view(cells.filter("cell = 0"), edges, cells).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 5: (-1, 0), 3: (0, 1), 2: (2, 0)}


def test_facts(spark):
    both = {tuple(r) for r in facts.both_ways(spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "a string, b string")).collect()}
    assert both == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")}
    photos = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", "x"])], "photo int, items array<string>")
    assert {tuple(r) for r in facts.members(photos, "photo", "items", "item").collect()} == {(1, "x"), (1, "y"), (2, "x")}
    made = facts.find_or_create(spark.createDataFrame([("k",), ("n",), ("n",)], "key string"), spark.createDataFrame([("k",)], "key string"), "key")
    assert {tuple(r) for r in made.collect()} == {("k", False), ("n", True)}
    moves = spark.createDataFrame([(1, "shelf"), (2, "shelf"), (3, "loan"), (4, "shelf")], "tx int, loc string").withColumn("item", F.lit(1))
    assert [r["tx"] for r in facts.without_repeats(moves, ["item"], "loc", ["tx"]).orderBy("tx").collect()] == [1, 3, 4]


def test_versions(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, v string")
    new = spark.createDataFrame([("a", "2"), ("c", None), ("d", "1")], "path string, v string")
    assert {tuple(r) for r in versions.diff(old, new, ["path"], "v").collect()} == {("a", "modified"), ("b", "deleted"), ("d", "added")}
    assert {r["path"] for r in versions.to_mirror(new.filter("v IS NOT NULL"), old, ["path"], F.col("v")).collect()} == {"a", "d"}
    asked = spark.createDataFrame([(k % 30, k) for k in range(40)] + [(0, 99)], "k int, t int")
    assert {r["k"] for r in versions.fifo(asked, "k", ["t"]).collect()} == set(range(6, 30))
    now = spark.createDataFrame([("o", 3)], "owner string, revision long")
    wanted = spark.createDataFrame([("o", 3), ("o", 2), ("o", None), ("new", 0)], "owner string, expected long")
    assert [r["accepted"] for r in versions.commit_conflict(now, wanted, ["owner"]).orderBy("owner", F.desc("expected")).collect()] == [True, True, False, True]


def test_clocks(spark):
    clock = "map<string,int>"
    rows = spark.createDataFrame([({"a": 1}, {"a": 1, "b": 1}), ({"a": 2}, {"b": 1}), ({"a": 1}, {"a": 1})], f"x {clock}, y {clock}")
    x, y = F.col("x"), F.col("y")
    got = rows.select(clocks.happens_before(x, y), clocks.happens_before(y, x), clocks.concurrent(x, y), clocks.merge(x, y), clocks.tick(x, "a")).collect()
    assert [tuple(r[:3]) for r in got] == [(True, False, False), (False, False, True), (False, False, True)]
    assert got[1][3] == {"a": 2, "b": 1} and got[0][4] == {"a": 2}
    mine, theirs = (spark.createDataFrame([(k,) for k in ks], "op int") for ks in ((1, 2, 3), (2, 3, 4)))
    assert {tuple(r) for r in clocks.missing(mine, theirs, "op").collect()} == {(1, "theirs"), (4, "mine")}


def test_sharing_levels(spark):
    with pytest.raises(ValueError):
        usage.shared_level(F.col("ts"), "daily")
    row = spark.sql("SELECT TIMESTAMP '2024-05-16 13:45:01' AS ts").select(*[usage.shared_level(F.col("ts"), k).cast("string") for k in ("raw", "session", "weekly", "monthly")]).first()
    assert [r[:13] for r in row] == ["2024-05-16 13", "2024-05-16 13", "2024-05-13 00", "2024-05-01 00"]


def test_defined_cases_of_facts(spark):
    df = spark.createDataFrame([(None, 1, 5, 9), (None, 2, 6, 9), (None, 3, 7, 9), ("a", 1, None, 9)], "k string, o int, v int, hidden int")
    got = sorted((r["k"] or "", r["o"], r["hidden"]) for r in facts.top_per_group(df, ["k"], ["o"], 2).collect())
    assert got == [("", 1, 1), ("", 2, 1), ("a", 1, 0)]
    assert {r["k"]: r["v"] for r in facts.latest(df, ["k"], "v", ["o"]).collect()} == {None: 7, "a": None}
    keys = spark.createDataFrame([(None,), ("a",), ("a",)], "k string")
    assert {r["k"]: r["created"] for r in facts.find_or_create(keys, keys, "k").collect()} == {None: True, "a": False}
    assert {r["k"]: r["created"] for r in facts.find_or_create_compound(keys, keys, ["k"]).collect()} == {None: False, "a": False}
    assert facts.top_per_group(df.limit(0), ["k"], ["o"], 2).collect() == []


def test_defined_cases_of_reports(spark):
    from loomline.operators import usage

    df = spark.createDataFrame([(None, "p"), (None, None), (1, "p")], "g int, who string")
    rows = {(r["g"], r["is_total"]): (r["n_events"], r["n_persons"]) for r in usage.report(df, ["g"], "who").collect()}
    assert rows == {(None, False): (2, 1), (1, False): (1, 1), (None, True): (3, 1)}
    assert usage.report(df.limit(0), ["g"], "who").collect() == []
