import random
import re

from loomline.llm import decontaminate as d
from tests.llm.helpers import docs, lower, prose

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall(lower(text or ""))


def brute(rows, bench, window=10):
    out = []
    for doc_id, text in rows:
        w, hit, items = words(text), set(), set()
        for item_id, t in bench:
            v = words(t)
            size = min(window, len(v))
            grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
            for i in range(len(w) - size + 1 if size else 0):
                if tuple(w[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    items.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(items), bool(hit)))
    return sorted(out, key=str)


def run(spark, rows, bench):
    got = d.decontaminate(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string"))
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in got.collect()), key=str)


def fixture():
    rng = random.Random(2)
    bench = [(k, prose(1000 + k, n, 80)) for k, n in enumerate([10, 11, 25, 60, 9, 3, 1])] + [(7, ""), (8, None), (9, "É ß K k 1 É ß K k 1 zz"), (9, "same item again twice over and over and over we go"), (10, "the the the the the the the the the the the")]
    rows = []
    for k in range(40):
        w = prose(k, rng.choice([5, 40, 300]), 80).split()
        if k % 2:
            v = (bench[k % 7][1]).split()
            a = rng.randrange(max(1, len(v) - 9))
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() if k % 3 else x + "," for x in v[a : a + rng.choice([9, 10, 14])]]
        rows.append((k, " ".join(w)))
    rows += [(90, None), (91, ""), (92, "!!"), (93, "é ß k K 1 é ß k k 1 zz"), (94, "É ß\u212a K k 1"), (95, "É-ß K K 1 É ß k k 1 ZZ"), (96, "the " * 30), (96, "the " * 30), (96, "other"), (97, prose(5000, 20000) + " " + bench[2][1])]
    return rows, bench


def test_matches_brute_force(spark):
    rows, bench = fixture()
    assert run(spark, rows, bench) == brute(rows, bench)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    rows, bench = fixture()
    monkeypatch.setattr(d, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(d, "BROADCAST_KEYS", -1)
    assert run(spark, rows, bench) == brute(rows, bench)


def test_empty_tables_and_null_ids(spark):
    rows, bench = fixture()
    assert run(spark, [], bench) == []
    assert run(spark, rows[:3], []) == brute(rows[:3], [])
    odd = [(None, bench[3][1]), (1, bench[3][1])]
    assert run(spark, odd, bench) == brute(odd, bench)


def test_proximity_bears_gaps(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, item), (2, item.replace("epsilon", "epsilon extra words here")), (3, "alpha " + "z " * 50 + item[6:].replace("beta", "b")), (4, "nothing at all")]
    found = d.proximity(docs(spark, rows), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in found} >= {1, 2} and 4 not in {r["doc_id"] for r in found}
