"""Virtual documents, revisions, skylines and cut scans against plain versions."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from loomline.operators import clocks, islands, spans
from loomline.operators.scans import RANGES
from loomline.sources.revisions import Revisions

SPANS = "doc string, no int, source string, start long, length long"
RANGE = "id int, doc string, start long, length long"


@pytest.mark.parametrize("split", [None, RANGES])
def test_ranges_of_virtual_documents(spark, split):
    rng = random.Random(1)
    sources = {s: "".join(rng.choice("abcdefgh") for _ in range(200)) for s in "PQ"}
    rows = [(rng.choice(["x", "y", None]), k, rng.choice("PQ"), rng.randrange(100), rng.choice([0, 1, 5, 30, None, -2])) for k in range(40)]
    whole = {d: "".join(sources[s][a : a + n] for dd, _, s, a, n in rows if dd == d and n and n > 0) for d in ("x", "y", None)}
    asked = [(k, rng.choice(["x", "y", None, "gone"]), rng.choice([-1, *range(0, 250, 3), None]), rng.choice([0, 1, 7, 60, 999, None])) for k in range(80)]
    asked.append(asked[3])
    got = {}
    for r in spans.resolve(spark.createDataFrame(asked, RANGE), spans.placed(spark.createDataFrame(rows, SPANS).repartition(3), split)).collect():
        got.setdefault(r["id"], []).append(r)
    for k, d, s, n in asked[:-1]:
        text = whole.get(d, "")
        parts = sorted(got[k], key=lambda r: r["piece"] or 0)
        if s is None or n is None or s < 0 or n <= 0 or s >= len(text):
            assert {r["problem"] for r in parts} == {"no such place"} and len(parts) == (2 if k == 3 else 1)
            continue
        parts = parts[:: 2 if k == 3 else 1]
        assert [r["piece"] for r in parts] == list(range(1, len(parts) + 1))
        assert "".join(sources[r["source"]][r["start"] : r["start"] + r["length"]] for r in parts) == text[s : s + n]
        assert {r["problem"] for r in parts} == {"cut at the end" if s + n > len(text) else None}
    assert spans.resolve(spark.createDataFrame([], RANGE), spans.placed(spark.createDataFrame([], SPANS))).collect() == []


def test_of_two_writers_one_wins(spark, tmp_path):
    log = Revisions(spark, str(tmp_path / "a table"))
    assert (log.current(), log.read()) == (0, None)
    gate, told = threading.Barrier(2), []

    def write(name):
        def change(_):
            gate.wait(60)  # both have seen revision 0
            return spark.createDataFrame([(name,)], "who string")

        told.append((name, *log.commit(change, expected=0)))

    writers = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(status for _, status, _ in told) == ["ok", "revision_conflict"]
    winner = next(n for n, status, _ in told if status == "ok")
    assert [r["who"] for r in log.read().collect()] == [winner] and log.current() == 1


def test_commits_in_a_row(spark, tmp_path):
    log = Revisions(spark, str(tmp_path))
    one = spark.createDataFrame([(1,)], "x int")
    assert log.commit(lambda _: one, expected=3) == ("revision_conflict", 0) and log.commit(lambda _: None) == ("refused", 0)
    assert log.commit(lambda _: one) == ("ok", 1) and log.commit(lambda now: now) == ("ok", 2)
    tries = []

    def slow(now):
        tries.append(now.count())
        if len(tries) == 1:  # another writer comes between
            assert log.commit(lambda old: old.union(one)) == ("ok", 3)
        return now.union(now)

    assert log.commit(slow) == ("ok", 4) and tries == [1, 2]
    assert [log.read(k).count() for k in (1, 2, 3, 4)] == [1, 1, 2, 4] and log.commit(lambda now: now.limit(0), expected=4) == ("ok", 5) and log.read().count() == 0


@pytest.mark.parametrize("n, front", [(1, 20_000), (3, 20_000), (3, 7), (4, 3)])
def test_skylines(spark, monkeypatch, n, front):
    monkeypatch.setattr(clocks, "FRONT", front)
    rng = random.Random(n)
    rows = [(rng.choice(["a", "b", None]), *(rng.choice([None, *range(9)]) for _ in range(n))) for _ in range(150)]
    rows += rows[:5]
    names = [f"c{k}" for k in range(n)]
    got = clocks.survivors(spark.createDataFrame(rows, "k string, " + ", ".join(f"{c} int" for c in names)).repartition(4), ["k"], names)
    low = [(k, *(-1 if c is None else c for c in clock)) for k, *clock in rows]

    def alive(row):
        return not any(o[0] == row[0] and o != row and all(x >= y for x, y in zip(o[1:], row[1:], strict=True)) for o in low)

    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r, x in zip(rows, low, strict=True) if alive(x))


@pytest.mark.parametrize("split", [RANGES, lambda t: F.floor(t / 11)])
def test_islands_in_parts_are_the_same(spark, split):
    rng = random.Random(7)
    rows = [(1 if k % 3 else rng.choice([2, None]), k, rng.choice(["a", "b", None]), rng.choice([0, 1, 2, None])) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, t int, v string, level int").withColumn("ts", F.timestamp_seconds(F.col("t") * F.col("t"))).repartition(3)
    marker = F.col("v") == "a"

    def same(a, b):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))

    same(islands.number_runs(df, ["k"], ["t"], "v"), islands.number_runs(df, ["k"], ["t"], "v", split=split))
    same(islands.number_after(df, ["k"], ["t"], marker, "n", False), islands.number_after(df, ["k"], ["t"], marker, "n", False, split))
    heads = [islands.number_heads(df, ["k"], "t", "level", 3, starred=F.col("t") % 5 == 0, appendix=F.col("t") == 90, split=s) for s in (None, split)]
    same(*heads)
    day = RANGES if split == RANGES else (lambda ts: F.date_trunc("hour", ts))
    same(islands.number_sessions(df, ["k"], "ts", "t", 100), islands.number_sessions(df, ["k"], "ts", "t", 100, split=day))
