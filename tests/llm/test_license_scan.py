import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.llm import license_scan as s
from tests.llm.helpers import docs, prose


def test_patience_anchors_and_gaps():
    a, b = "a b x c d a".split(), "z a b c d q a".split()
    got = s.patience(a, b)
    assert all(a[i] == b[j] for i, j in got) and [i for i, _ in got] == [0, 1, 3, 4, 5]


@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_patience_is_an_alignment(a, b):
    got = s.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    if a == b:
        assert len(got) == len(a)


@given(st.lists(st.integers(0, 50), unique=True, max_size=20))
def test_increasing_is_longest(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    got = [values[i] for i in s._increasing(values)]
    assert got == sorted(got) and len(got) == max(best, default=0)


def test_notices_are_found(spark):
    t = s.TEMPLATES
    rows = [
        (1, prose(1, 50) + "\n" + t["mit-line"]),
        (2, (t["apache-2.0-line"] + "\n") * 3 + prose(2, 30)),
        (3, t["mit-grant"].replace("hereby ", "").replace("merge, publish,", "merge or publish") + prose(3, 20)),
        (4, "the of this License under version " * 40),
        (5, None),
        (6, ""),
        (7, t["gpl-3.0-line"].upper() + " " + t["all-rights-reserved"]),
        (8, " ".join(f"{w} {prose(9, 30)}" for w in t["gpl-3.0-line"].split())),
        (9, prose(4, 30000) + " " + t["gpl-3.0-header"] + " " + prose(5, 30000)),
        (1, "repeated row"),
    ]
    got = s.scan(docs(spark, rows).withColumn("license", F.lit("clash"))).collect()
    by = {r["doc_id"]: r for r in got if r["n_words"] != 2}
    assert len(got) == len(rows)
    assert (by[1]["license"], by[1]["coverage"], by[1]["first_word"], by[1]["last_word"]) == ("mit-line", 1.0, 50, 54)
    assert by[2]["license"] == "apache-2.0-line" and by[2]["coverage"] == 1.0
    assert by[3]["license"] == "mit-grant" and 0.9 < by[3]["coverage"] < 1
    assert by[4]["license"] is None and by[8]["license"] is None
    assert (by[5]["license"], by[5]["coverage"], by[6]["n_words"]) == (None, 0.0, 0)
    assert by[7]["licenses"] == "all-rights-reserved,gpl-3.0-line" and by[7]["license"] == "gpl-3.0-line"
    assert by[9]["license"] == "gpl-3.0-header" and by[9]["first_word"] == 30000
    assert s.scan(docs(spark, [])).collect() == []


def test_relatives_are_told_apart(spark):
    lines = {
        "Released under the BSD License.": "bsd-line",
        "Licensed under CC BY 4.0.": "cc-by-4.0-line",
        "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0-line",
        "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa-4.0-line",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-line",
        "Licensed under CC BY-NC 3.0.": "",
        "Licensed under the Apache License, Version 1.1.": "",
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0-line",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl-3.0-line",
        "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0-line",
        "Licensed under CC BY-SA 4.0. Licensed under CC BY 4.0.": "cc-by-4.0-line,cc-by-sa-4.0-line",
        s.TEMPLATES["gpl-3.0-header"].replace("General", "Affero General"): "agpl-3.0-header",
    }
    rows = list(enumerate(lines))
    got = {r["doc_id"]: r["licenses"] for r in s.scan(docs(spark, rows)).collect()}
    assert got == {k: lines[line] for k, line in rows}


def test_whole_texts_are_found_once_a_place(spark):
    whole = [n for n in s.TEMPLATES if n.endswith("-text")]
    edited = s.TEMPLATES["gpl-3.0-text"].split()
    edited = " ".join(w if k % 97 else "edited" for k, w in enumerate(edited, 1))
    both = s.TEMPLATES["bsd-3-clause-text"] + prose(1, 400) + " " + s.TEMPLATES["bsd-2-clause-text"]
    affero = s.TEMPLATES["gpl-3.0-text"].replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("GNU General", "GNU Affero General")
    rows = [(k, prose(k, 30) + "\n" + s.TEMPLATES[n] + "\n" + prose(k + 50, 30)) for k, n in enumerate(whole)]
    rows += [(100, prose(3, 50) + " " + edited), (101, both), (102, affero)]
    got = {r["doc_id"]: r for r in s.scan(docs(spark, rows)).collect()}
    texts = {k: [n for n in r["licenses"].split(",") if n.endswith(("-text", "-grant"))] for k, r in got.items()}
    assert {k: texts[k] for k in range(len(whole))} == {k: [n] for k, n in enumerate(whole)}
    assert texts[100] == ["gpl-3.0-text"] and texts[101] == ["bsd-2-clause-text", "bsd-3-clause-text"] and texts[102] == []


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_recall_against_longest_common_subsequences(spark):
    """Edited notices in prose: whatever a plain subsequence of a stretch of the text covers, the scan finds, nine in ten at least."""
    rng = random.Random(11)
    names = ["mit-grant", "gpl-3.0-header", "apache-2.0-header", "mpl-2.0-header", "cc-by-4.0-notice", "isc-line"]
    templates = {n: s.TEMPLATES[n] for n in names}
    texts = []
    for _ in range(90):
        words = s.words_of(templates[rng.choice(names)])
        edited = [w if rng.random() > share else rng.choice(["", "edited", f"{w} {w}"]) for share in [rng.choice([0.05, 0.15, 0.25, 0.35])] for w in words]
        around = rng.choice(names)
        texts.append(f"{prose(rng.random(), 30, 60)} {' '.join(rng.sample(s.words_of(templates[around]), 5))} {' '.join(edited)} {prose(rng.random(), 30, 60)}")
    got = {r["doc_id"]: set(r["licenses"].split(",")) - {""} for r in s.scan(docs(spark, list(enumerate(texts))), templates).collect()}
    want, plain = 0, {n: s.words_of(t) for n, t in templates.items()}
    hits = wrong = 0
    for k, text in enumerate(texts):
        words = s.words_of(text)
        for n, t in plain.items():
            size = len(t)
            best = max(longest_common(t, words[at : at + 2 * size]) for at in range(0, max(1, len(words) - size), max(1, size // 4)))
            if best >= s.THRESHOLD * size:
                want, hits = want + 1, hits + (n in got[k])
            else:
                wrong += n in got[k] and longest_common(t, words) < s.THRESHOLD * size
    assert want >= 40 and hits >= 0.9 * want and wrong == 0, (want, hits, wrong)
