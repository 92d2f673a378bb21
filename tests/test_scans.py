"""Scans in parts against plain loops, and threads against a recursive walk."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomline.operators import trees
from loomline.operators.scans import RANGES, scan


def looped(rows):
    """Running sum, last value that isn't null, and the value before, of rows (k, o, v) by key."""
    out, state = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        total, last, before = state.get(k, (None, None, None))
        total = total if v is None else (total or 0) + v
        last = last if v is None else v
        out[o] = (total, last, before)
        state[k] = (total, last, v)
    return out


@pytest.mark.parametrize("split", [None, RANGES, lambda o: F.floor(o / 7)])
def test_scans_equal_a_loop(spark, split):
    rng = random.Random(4)
    hot = [(1, k, rng.choice([None, 1, 5])) for k in range(0, 300, 2)]
    rows = hot + [(rng.choice([None, 2, 3]), k, rng.choice([None, 2, 7])) for k in range(1, 200, 2)]
    df = spark.createDataFrame(rows, "k int, o int, v int").repartition(3)
    got = scan(df, ["k"], ["o"], {"total": F.col("v")}, {"last": F.col("v")}, {"before": F.col("v")}, split)
    assert {r["o"]: (r["total"], r["last"], r["before"]) for r in got.collect()} == looped(rows)


@pytest.mark.parametrize("split", [None, RANGES])
def test_clashing_names_and_empty_tables(spark, split):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "part int, row int, k0 int, o0 int, turn int, s0 int")
    got = scan(df, ["part"], ["row"], {"x": F.col("k0")}, split=split).collect()
    assert [tuple(r) for r in got] == [(1, 2, 3, 4, 5, 6, 3)]
    assert scan(df.limit(0), ["part"], ["row"], {"x": F.col("k0")}, split=split).collect() == []


def walked(nodes):
    """(root, depth, pos, size) of every node that a root reaches."""
    best = {}
    for i, p, s in nodes:
        best[i] = min(best.get(i, (s, p or "", p)), (s, p or "", p))
    children, out = {}, {}
    for i, (s, _, p) in best.items():
        children.setdefault(p if p in best else None, []).append((s, i))
    for s, root in children.get(None, []):
        stack, place = [(s, root, 0)], 0
        order = []
        while stack:
            s, node, depth = stack.pop()
            order.append(node)
            out[node] = [root, depth, place, 1]
            place += 1
            stack += [(*c, depth + 1) for c in sorted(children.get(node, []), reverse=True)]
        for node in reversed(order):
            p = best[node][2]
            if node != root:
                out[p][3] += out[node][3]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("seed, split", [(0, None), (1, RANGES)])
def test_random_forests(spark, seed, split):
    rng = random.Random(seed)
    nodes = [(f"n{k}", rng.choice([None, "gone", *[f"n{rng.randrange(max(k, 1))}"] * 6]), str(rng.randrange(5))) for k in range(120)]
    nodes += [("c1", "c2", "0"), ("c2", "c1", "0"), ("under", "c1", "1"), ("self", "self", "1"), ("n5", "n4", "0")]
    nodes = [n for n in nodes if n[0] != n[1] or n[0] == "self"]
    got = trees.preorder(spark.createDataFrame(nodes, "id string, parent string, sort string").repartition(3), split).collect()
    assert {r["id"]: (r["root"], r["depth"], r["pos"], r["size"]) for r in got if r["root"]} == walked(nodes)
    assert {r["id"] for r in got if not r["root"]} == {"c1", "c2", "under", "self"}


def test_a_chain_of_100_000_nodes(spark):
    began = time.time()
    chain = spark.range(100_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).alias("sort"))
    bad = trees.preorder(chain).filter("root <> 0 OR depth <> id OR pos <> id OR size <> 100000 - id OR root IS NULL")
    assert bad.count() == 0 and time.time() - began < 120


def test_heads_of_all_levels_are_counted_in_one_order(spark):
    """One shuffle and one sort, also behind the window that tells the places: four of each before."""
    from loomline.plans import bindings as b

    plan = b.QUERIES["section_numbers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_preorder_broadcasts_nothing(spark, monkeypatch):
    """Tables that compress well were broadcast, by way of the driver."""
    from loomline.operators import trees

    plans = []
    write = trees.materialise
    monkeypatch.setattr(trees, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    nodes = spark.range(200).selectExpr("id", "CASE WHEN id > 3 THEN id div 4 END AS parent", "id AS sort")
    got = {r["id"]: (r["root"], r["depth"], r["size"]) for r in trees.preorder(nodes).collect()}
    assert got[0] == (0, 0, 1) and got[199] == (3, 3, 1) and got[3] == (3, 0, 29) and len(got) == 200
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
