"""Linked-cell mutations against a sequential model, and the structures they begin with."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import links, store


def test_a_fresh_structure_has_24_records(spark):
    fresh = store.bootstrap(spark.createDataFrame([("u",), ("u",), ("v",)], "owner string"))
    records = store.records(fresh["links"])
    assert {tuple(r) for r in records.groupBy("owner").count().collect()} == {("u", 24), ("v", 24)}
    assert fresh["cells"].filter("owner = 'u'").count() == 12 and fresh["dimensions"].filter("owner = 'v'").count() == 7
    ring = fresh["links"].filter("owner = 'u' AND dim = 'd.dimensions'").select("src", "dst")
    assert [r["n"] for r in links.ranks(ring).groupBy("head", "is_circular").agg(F.count("*").alias("n")).collect()] == [7]
    assert links.broken(fresh["links"].filter("dim = 'd.clones' AND owner = 'u'")).count() == 0


def sequential(requests, cells, dims, there):
    nxt, prv, out = dict(), dict(), {}
    for o, d, a, b in there:
        nxt[o, d, a], prv[o, d, b] = b, a
    for o, seq, d, a, b in sorted(requests, key=lambda r: r[1]):
        if a == b:
            out[seq] = "self_link_forbidden"
        elif (o, a) not in cells or (o, b) not in cells:
            out[seq] = "unknown_cell"
        elif (o, d) not in dims:
            out[seq] = "unknown_dimension"
        elif nxt.get((o, d, a), b) != b or prv.get((o, d, b), a) != a:
            out[seq] = "restriction_r_violation"
        else:
            nxt[o, d, a], prv[o, d, b], out[seq] = b, a, "ok"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_links_are_accepted_as_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    cells = {(o, str(c)) for o in "uv" for c in range(8)}
    dims = {("u", "x"), ("u", "y"), ("v", "x")}
    there = [("u", "x", "0", "1"), ("v", "x", "3", "4")]
    requests = [(rng.choice("uv"), k, rng.choice("xyz"), str(rng.randrange(9)), str(rng.randrange(9))) for k in range(120)]
    got = store.link(
        spark.createDataFrame(requests, "owner string, seq long, dim string, a string, b string").repartition(3),
        spark.createDataFrame(list(cells), "owner string, cell string"),
        spark.createDataFrame(list(dims), "owner string, dim string"),
        spark.createDataFrame(there, "owner string, dim string, src string, dst string"),
    ).collect()
    assert {r["seq"]: r["status"] for r in got} == sequential(requests, cells, dims, there)
    assert {r["status"] for r in got} == {"ok", "self_link_forbidden", "unknown_cell", "unknown_dimension", "restriction_r_violation"}


def test_a_long_chain_of_competing_links(spark):
    """Every request competes with the next, so that what is accepted hangs on all before."""
    requests = [("u", 2 * k + t, "x", str(k), str(k + 1 - t)) for k in range(30) for t in (0, 1) if k or not t]
    cells, dims = {("u", str(k)) for k in range(40)}, {("u", "x")}
    got = store.link(spark.createDataFrame(requests, "owner string, seq long, dim string, a string, b string"), spark.createDataFrame(list(cells), "owner string, cell string"), spark.createDataFrame(list(dims), "owner string, dim string"), spark.createDataFrame([], "owner string, dim string, src string, dst string"))
    assert {r["seq"]: r["status"] for r in got.collect()} == sequential(requests, cells, dims, [])


def one_after_the_other(requests, cells, dims, there):
    """Statuses and links by replaying requests (owner, seq, dim, a, b, splice, ring) on two maps."""
    nxt, prv, out = {}, {}, {}
    for o, d, a, b in there:
        nxt[o, d, a], prv[o, d, b] = b, a
    for o, seq, d, a, b, splice, ring in sorted(set(requests), key=lambda r: (r[1] is None, r[1])):
        p, m, q = (o, d, a), (o, d, b), (o, d, b)
        if a == b and not ring:
            out[o, seq] = "self_link_forbidden"
        elif (o, a) not in cells or (o, b) not in cells:
            out[o, seq] = "unknown_cell"
        elif (o, d) not in dims:
            out[o, seq] = "unknown_dimension"
        elif nxt.get(p) == b and p in nxt:
            out[o, seq] = "ok"
        elif m in prv or (p in nxt and (not splice or q in nxt)):
            out[o, seq] = "already_linked" if splice else "restriction_r_violation"
        else:
            if p in nxt:
                nxt[q] = nxt[p]
                prv[o, d, nxt[p]] = b
            nxt[p], prv[m], out[o, seq] = b, a, "ok"
    return out, {(o, d, a, b) for (o, d, a), b in nxt.items()}


ASKED = "owner string, seq long, dim string, a string, b string, splice boolean, allow_self_ring boolean"
LINKS = "owner string, dim string, src string, dst string"


def applied(spark, requests, cells, dims, there):
    told, after = store.apply_links(spark.createDataFrame(requests, ASKED).repartition(3), spark.createDataFrame(list(cells), "owner string, cell string"), spark.createDataFrame(list(dims), "owner string, dim string"), spark.createDataFrame(there, LINKS))
    return {(r["owner"], r["seq"]): r["status"] for r in told.collect()}, [tuple(r[c] for c in ("owner", "dim", "src", "dst")) for r in after.collect()]


@pytest.mark.parametrize("seed, component", [(0, 200_000), (1, 200_000), (2, 0), (3, 200_000)])
def test_batches_equal_requests_one_after_the_other(spark, seed, component, monkeypatch):
    monkeypatch.setattr(store, "COMPONENT", component)
    rng = random.Random(seed)
    names = [str(k) for k in range(rng.choice([6, 14, 30]))]
    cells = {(o, c) for o in "uv" for c in names}
    there = [("u", "x", "0", "1"), ("u", "x", "1", "2"), ("v", "x", "3", "3"), ("v", "y", "2", "0")]
    dims = {("u", "x"), ("u", "y"), ("v", "x"), ("v", "y")}
    requests = [(rng.choice("uv"), k, rng.choice("xxyz"), rng.choice([*names, "gone"]), rng.choice(names), rng.random() < 0.7, rng.random() < 0.5) for k in range(160)]
    requests += requests[:3]
    expected, links = one_after_the_other(requests, cells, dims, there)
    told, after = applied(spark, requests, cells, dims, there)
    assert told == expected and sorted(after) == sorted(links)
    assert len({r[:3] for r in after}) == len({(o, d, b) for o, d, _, b in after}) == len(after)  # Restriction R
    assert {"ok", "already_linked", "restriction_r_violation"} <= set(told.values())


def test_splice_moves_no_cell_that_is_linked(spark):
    there = [("u", "d", "x", "b"), ("u", "d", "a", "c")]
    rows = spark.createDataFrame([("u", "d", 1, "a", "b"), ("u", "d", 2, "a", "n"), ("u", "d", 3, "a", "n"), ("u", "d", 4, "a", "m"), ("u", "d", 5, "a", "n")], "owner string, dim string, seq long, a string, b string")
    told, after = store.splice(spark.createDataFrame(there, LINKS), rows)
    assert [r["status"] for r in told.orderBy("seq").collect()] == ["already_linked", "ok", "ok", "ok", "already_linked"]
    assert {(r["src"], r["dst"]) for r in after.collect()} == {("x", "b"), ("a", "m"), ("m", "n"), ("n", "c")}


def test_an_empty_batch_and_nulls(spark):
    there = [("u", "d", "x", "b")]
    assert applied(spark, [], [("u", "x")], [("u", "d")], there) == ({}, there)
    told, after = applied(spark, [("u", 1, "d", None, "b", True, None), (None, 2, "d", "x", "b", None, None), ("u", 3, "d", "b", "x", None, None)], [("u", "x"), ("u", "b")], [("u", "d")], there)
    assert told == {("u", 1): "unknown_cell", (None, 2): "unknown_cell", ("u", 3): "ok"} and sorted(after) == [("u", "d", "b", "x"), *there]


def test_a_chain_of_100_000_splices(spark):
    asked = spark.range(100_000).select(F.lit("u").alias("owner"), F.lit("d").alias("dim"), F.col("id").alias("seq"), F.col("id").cast("string").alias("a"), (F.col("id") + 1).cast("string").alias("b"))
    told, after = store.splice(spark.createDataFrame([("u", "d", "0", "end")], LINKS), asked)
    assert told.filter("status <> 'ok'").count() == 0
    assert after.filter("dst <> CASE WHEN src = '100000' THEN 'end' ELSE cast(cast(src AS int) + 1 AS string) END").count() == 0 and after.count() == 100_001


@pytest.mark.parametrize("seed", range(2))
def test_splices_are_inserts_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    chain, inserts = ["a", "z"], []
    for k in range(25):
        after = rng.choice(chain[:-1])
        inserts.append(("u", "d", k, after, f"n{k}"))
        chain.insert(chain.index(after) + 1, f"n{k}")
    got = store.splice(spark.createDataFrame([("u", "d", "a", "z"), ("v", "d", "a", "z")], "owner string, dim string, src string, dst string"), spark.createDataFrame(inserts, "owner string, dim string, seq long, a string, b string").repartition(2))[1]
    assert {(r["src"], r["dst"]) for r in got.filter("owner = 'u'").collect()} == set(zip(chain, chain[1:], strict=False))
    assert [(r["src"], r["dst"]) for r in got.filter("owner = 'v'").collect()] == [("a", "z")]


def test_clones_and_unlinks(spark):
    link = "owner string, dim string, src string, dst string"
    cells = spark.createDataFrame([("u", "c", "plain")], "owner string, cell string, kind string")
    asked = spark.createDataFrame([("u", 1, "c", "k1"), ("u", 2, "c", "k2"), ("u", 3, "gone", "k3")], "owner string, seq long, of string, clone string")
    told, new, now = store.make_clones(asked, cells, spark.createDataFrame([], link))
    assert {r["seq"]: r["status"] for r in told.collect()} == {1: "ok", 2: "ok", 3: "unknown_cell"} and {r["cell"] for r in new.collect()} == {"k1", "k2"}
    assert {(r["src"], r["dst"]) for r in now.collect()} == {("c", "k2"), ("k2", "k1")}
    told, left = store.unlink(spark.createDataFrame([("u", 1, "d", "a", "b"), ("u", 2, "d", "a", "b"), ("u", 3, "d", "b", "a")], "owner string, seq long, dim string, a string, b string"), spark.createDataFrame([("u", "d", "a", "b"), ("u", "d", "b", "c")], link))
    assert [r["status"] for r in told.orderBy("seq").collect()] == ["ok", "no_such_connection", "no_such_connection"]
    assert [tuple(r) for r in left.collect()] == [("u", "d", "b", "c")]


def test_contradicting_halves_are_repaired_by_the_last(spark):
    schema = "owner string, dim string, cell string, negward string, posward string, place int"
    halves = [("u", "d", "a", None, "b", 1), ("u", "d", "c", None, "b", 2), ("u", "d", "e", "c", None, 3)]
    got = store.repair_mirrors(spark.createDataFrame(halves, schema))
    assert {(r["src"], r["dst"]) for r in got.collect()} == {("c", "e")}
    assert store.repair_mirrors(spark.createDataFrame([("u", "d", "a", None, None, 1)], schema)).collect() == []


def test_imports_leave_the_foreign_structure_alone(spark):
    cells = spark.createDataFrame([("u", "k1", "plain"), ("v", "k2", "plain")], "owner string, cell string, kind string")
    asked = spark.createDataFrame([("u", 1, "v", "k9"), ("u", 2, "v", "k2"), ("u", 3, "v", "k2"), ("v", 4, "u", "k1")], "owner string, seq long, from_owner string, cell string")
    told, new = store.import_foreign(asked, cells)
    assert {r["seq"]: r["status"] for r in told.collect()} == {1: "foreign_cell_not_found", 2: "imported", 3: "present", 4: "imported"}
    assert {(r["owner"], r["cell"], r["true_owner"]) for r in new.collect()} == {("u", "k2", "v"), ("v", "k1", "u")}


def test_numbers_come_before_names(spark):
    rows = spark.createDataFrame([("home",), ("100",), ("9",), ("10",), ("007",), ("a1",), ("123456789012345678901234567890123456789012",)], "cell string")
    assert [r["cell"] for r in rows.orderBy(*store.by_id(F.col("cell"))).collect()] == ["007", "9", "10", "100", "123456789012345678901234567890123456789012", "a1", "home"]


@pytest.mark.parametrize("owner, component", [(200_000, 200_000), (0, 200_000), (0, 0), (150, 200_000)])
def test_owners_are_replayed_or_joined_with_one_result(spark, owner, component, monkeypatch):
    monkeypatch.setattr(store, "OWNER", owner)
    monkeypatch.setattr(store, "COMPONENT", component)
    rng = random.Random(5)
    names = [str(k) for k in range(9)]
    cells, dims = {(o, c) for o in "uvw" for c in names}, {(o, d) for o in "uvw" for d in "xy"}
    there = [("u", "x", "0", "1"), ("u", "x", "1", "2"), ("v", "x", "3", "3"), ("w", "y", "2", "0"), ("only", "y", "2", "0")]
    requests = [(rng.choice("uuuuvw"), k, rng.choice("xxyz"), rng.choice([*names, "gone"]), rng.choice(names), rng.random() < 0.7, rng.random() < 0.5) for k in range(200)]
    requests += [*requests[:3], (None, 300, "x", "4", "5", True, False), ("u", 301, None, "4", "5", True, False), ("u", 302, "x", "4", None, True, False)]
    expected, links = one_after_the_other(requests, cells, dims, there)
    told, after = applied(spark, [*requests, ("u", None, "x", "4", "5", True, False)], cells, dims, there)
    assert told == expected | {("u", None): "unknown_cell"} and sorted(after) == sorted(links)


def test_many_small_owners_take_one_shuffle(spark, monkeypatch):
    """No join and no round for owners that a task can replay: six tables were written for each round before."""
    written = []
    write = store.materialise
    monkeypatch.setattr(store, "materialise", lambda df, name: written.append(name) or write(df, name))
    rows = spark.range(400).select((F.col("id") % 90).alias("owner"), F.lit("d").alias("dim"), F.col("id").alias("seq"), (F.col("id") % 3).alias("a"), (F.col("id") + 10).alias("b"))
    told, after = store.splice(spark.createDataFrame([], "owner long, dim string, src long, dst long"), rows)
    assert told.filter("status = 'ok'").count() == 400 == after.count() and written == ["batch", "large", "replayed"]


def test_clones_of_many_owners_take_one_replay(spark, monkeypatch):
    written = []
    write = store.materialise
    monkeypatch.setattr(store, "materialise", lambda df, name: written.append(name) or write(df, name))
    asked = spark.range(300).select((F.col("id") % 70).alias("owner"), F.col("id").alias("seq"), F.lit("c").alias("of"), F.concat(F.lit("k"), F.col("id") % 280).alias("clone"))
    cells = spark.range(60).select(F.col("id").alias("owner"), F.lit("c").alias("cell"))
    told, new, after = store.make_clones(asked, cells, spark.createDataFrame([], "owner long, dim string, src string, dst string"))
    ok = sum(k % 70 < 60 for k in range(280))  # the last twenty clones are there already
    assert {r["status"]: r["count"] for r in told.groupBy("status").count().collect()} == {"ok": ok, "already_linked": 20, "unknown_cell": 280 - ok} and new.count() == after.count() == ok
    assert written == ["clones", "batch", "large", "replayed"]


@pytest.mark.parametrize("name", ["splice_requests", "link_requests"])
def test_batches_of_requests_take_one_replay(spark, name, monkeypatch):
    from loomline.plans import bindings as b

    written = []
    write = store.materialise
    monkeypatch.setattr(store, "materialise", lambda df, name: written.append(name) or write(df, name))
    b.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert written == ["batch", "large", "replayed"]


@pytest.mark.parametrize("owner", [200_000, 0])
def test_a_clone_is_made_once(spark, owner, monkeypatch):
    """A request repeated right behind itself was ok twice, and its clone a cell twice; one without a seq was ok without a link."""
    monkeypatch.setattr(store, "OWNER", owner)
    cells = spark.createDataFrame([("u", "c"), ("u", "e"), (None, "c")], "owner string, cell string")
    rows = [("u", 1, "c", "k1"), ("u", 2, "c", "k1"), ("u", 3, "e", "k1"), ("u", 4, "k1", "k2"), ("u", 5, "c", "e"), ("u", 6, "c", "c"), ("u", 7, "gone", "e"), ("u", 8, "c", "k3"), ("u", 8, "c", "k3")]
    rows += [("u", None, "c", "k4"), ("u", 9, "c", None), ("u", 10, None, "k5"), (None, 11, "c", "c"), ("u", 12, "gone", "gone"), ("u", 13, "e", "old"), ("u", 14, "e", "k6")]
    told, new, after = store.make_clones(spark.createDataFrame(rows, "owner string, seq long, of string, clone string"), cells, spark.createDataFrame([("u", store.CLONES, "c", "old")], LINKS))
    assert told.columns == ["owner", "seq", "of", "clone", "status"] and told.count() == len(rows) - 1
    status = {r["seq"]: r["status"] for r in told.collect()}
    assert status == {k: "ok" for k in (1, 8, 14)} | {k: "already_linked" for k in (2, 3, 5, 6, 7, 13)} | {k: "unknown_cell" for k in (None, 4, 9, 10, 11, 12)}
    assert sorted((r["cell"], r["of"]) for r in new.collect()) == [("k1", "c"), ("k3", "c"), ("k6", "e")]
    assert sorted((r["src"], r["dst"]) for r in after.collect()) == [("c", "k3"), ("e", "k6"), ("k1", "old"), ("k3", "k1")]


def test_clones_are_checked_without_a_join(spark):
    """What is there goes through the replay with the requests: three joins shuffled the requests again before."""
    asked = spark.range(50).select((F.col("id") % 7).alias("owner"), F.col("id").alias("seq"), F.lit("c").alias("of"), F.concat(F.lit("k"), "id").alias("clone"))
    cells = spark.range(7).select(F.col("id").alias("owner"), F.lit("c").alias("cell"))
    for out in store.make_clones(asked, cells, spark.createDataFrame([], "owner long, dim string, src string, dst string")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("kind", ["long", "string", "decimal(30,2)", "double", "timestamp"])
def test_names_stay_what_they_are_in_a_replay(spark, kind):
    """Whole numbers beyond doubles, texts, and kinds that are no plain objects of NumPy, each beside nulls."""
    name = {"timestamp": "timestamp_micros({})"}.get(kind, f"cast({{}} AS {kind})").format
    big = 2**53 + 1 if kind != "timestamp" else 1_700_000_000_000_001
    asked = spark.range(40).selectExpr(f"{name(f'{big} + id % 4')} AS owner", f"IF(id = 7, NULL, {big} + id) AS seq", "'d' AS dim", f"{name(f'{big} + 2 * id')} AS a", f"IF(id = 9, NULL, {name(f'{big} + 2 * id + 2000')}) AS b", "IF(id = 11, NULL, id % 2 = 0) AS splice")
    told, after = store.splice(spark.createDataFrame([], f"owner {kind}, dim string, src {kind}, dst {kind}"), asked)
    assert [told.schema[c].dataType for c in ("owner", "seq", "a", "b")] == [asked.schema[c].dataType for c in ("owner", "seq", "a", "b")]
    expected = asked.selectExpr("owner", "seq", "dim", "a", "b", "IF(seq IS NULL OR b IS NULL, 'unknown_cell', 'ok') AS status")
    assert told.exceptAll(expected).count() == 0 == expected.exceptAll(told).count()
    links = expected.filter("status = 'ok'").select("owner", "dim", "a", "b")
    assert after.exceptAll(links).count() == 0 == links.exceptAll(after).count()
