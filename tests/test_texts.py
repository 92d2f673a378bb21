"""Addresses, comments, chats, notes and request checks on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import checks
from loomline.functions import text as fn
from loomline.operators import comments, journal_report, notes, trees, usage
from loomline.operators.asof import asof
from loomline.sources import journal, transcripts


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://host/hm/register/x", None),
        ("https://host/hm/API/x", None),
        ("https://host/hm/static/x", ("static", ["x"], None, None, "https://host")),
        ("HM://u/a//b/?v=x%2Fy#b+[3:9]", ("u", ["a", "b"], "x/y", "b+"[:1], None)),
        ("  hm://u#c[1:2] ", ("u", [], None, "c", None)),
        ("hm://u?v=1&w=2&v=%zz", ("u", [], "%zz", None, None)),
        ("hm://u?v=#+", ("u", [], None, None, None)),
        ("hm:///x", None),
        ("mailto:u", None),
        ("https:///hm/u", None),
        ("http://h/hm/u/p", ("u", ["p"], None, None, "http://h")),
    ],
)
def test_addresses(spark, url, want):
    got = one(spark, fn.address(F.col("u")), u=url)
    assert (None if got is None else (got["uid"], got["path"], got["version"], got["block_ref"], got["origin"])) == want


def test_titles_and_nested_json(spark):
    assert [one(spark, fn.humanized(F.col("s")), s=s) for s in ("-a_b-", "__", "éa", "")] == ["A b", "__", "Éa", ""]
    import json

    held = {"a": ' {"b": "[1, 2]"} ', "c": "{no", "d": "[", "e": [' "x" ', "{}"]}
    assert json.loads(one(spark, fn.expand_json(F.col("j")), j=json.dumps(held))) == {"a": {"b": [1, 2]}, "c": "{no", "d": "[", "e": [' "x" ', {}]}
    assert one(spark, fn.expand_json(F.col("j")), j="plain") == "plain" and one(spark, fn.expand_json(F.col("j")), j=None) is None
    assert one(spark, fn.quoted(F.col("t"), 8), t='a"bcdefgh') == '"a\\"bc…"' and one(spark, fn.quoted(F.col("t"), 8), t="é") == '"é"'


def test_modified_utf8(spark):
    for text in ("", "a\0é", "😀x", "漢"):
        assert journal.java_text(journal.java_bytes(text)[2:]) == text
    assert journal.java_text(b"a\xffb\xc3") == "a�b�" and journal.java_text(b"\xed\xa0\xbd") == "�"


def test_a_page_of_comments(spark):
    schema = f"file string, id string, parent string, author string, created string, place int, target string, blocks {comments.BLOCKS}"
    para = lambda t: [(0, "Paragraph", t)]
    rows = [
        ("f", "2", "1", "Bo", "2024-01-02T00:00:00Z", 0, "doc", para("reply")),
        ("f", "1", None, "Ann", "2024-01-01T10:30:00Z", 1, "doc", [(0, "Paragraph", "intro"), (0, "Paragraph", "one"), (0, "Paragraph", "two"), (0, "Paragraph", "three")]),
        ("f", "3", "gone", "Cy", "", 2, "doc", [(0, "Heading", "H"), (1, "Paragraph", "item")]),
        ("f", "4", "5", "Di", "2024-01-04", 3, "doc", para("round")),
        ("f", "5", "4", "Ed", "2024-01-05", 4, "doc", para("and round")),
    ]
    (page,) = comments.markdown(spark.createDataFrame(rows, schema)).collect()
    assert page["text"].splitlines() == [
        *("# Comments: doc", "", "Target: `doc`", "", "5 comments in 2 threads. Replies are nested with `>` blockquotes.", "", "---", ""),
        *("## Thread 1", "", "**Cy** · unknown time", "", "**H**", "", "  - item", "", "---", ""),
        *("## Thread 2", "", "**Ann** · 2024-01-01 10:30 UTC", "", "intro", "", "- one", "- two", "- three", "", "> **Bo** · 2024-01-02 00:00 UTC", ">", "> reply", ">", "---", ""),
        *("## Unreachable", "", "**Di** · 2024-01-04 00:00 UTC", "", "round", "", "**Ed** · 2024-01-05 00:00 UTC", "", "and round", "", "---"),
    ]
    assert comments.markdown(spark.createDataFrame([], schema)).collect() == []


def test_deep_threads_and_cycles(spark):
    chain = [(str(k), str(k - 1) if k else None, str(k % 3)) for k in range(150)] + [("x", "y", "0"), ("y", "z", "0"), ("z", "x", "0"), ("below", "x", "0")]
    got = {r["id"]: r for r in trees.preorder(spark.createDataFrame(chain, "id string, parent string, sort string")).collect()}
    assert all((got[str(k)]["depth"], got[str(k)]["pos"], got[str(k)]["size"], got[str(k)]["root"]) == (k, k, 150 - k, "0") for k in range(150))
    assert {k for k, r in got.items() if r["root"] is None} == {"x", "y", "z", "below"}
    assert trees.preorder(spark.createDataFrame([], "id string, parent string, sort string")).collect() == []


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("clamp", [False, True])
def test_split_asof_is_the_same(spark, forward, clamp):
    rng = random.Random(3)
    left = spark.createDataFrame([(rng.choice([1, 2, None]), rng.randrange(60), k) for k in range(80)], "k int, t int, id int")
    right = spark.createDataFrame([(rng.choice([1, 2, None]), rng.randrange(10, 50), 1000 + k) for k in range(15)], "k int, t int, id int")
    plain, parts = (sorted(map(tuple, asof(left, right, ["k"], "t", {"id": "m"}, "id", forward, clamp, split).collect()), key=str) for split in (None, lambda t: F.floor(t / 7)))
    assert plain == parts


def test_chats_meet_their_turns(spark):
    turns = spark.createDataFrame([("f", 0, 10.0), ("f", 1, 10.0), ("f", 2, 20.0), ("f", 3, 20.0)], "file string, turn int, start_s double")
    at = lambda s: f"2024-01-01 00:00:{s:02}"
    chats = spark.createDataFrame([("f", k, at(s)) for k, s in enumerate([1, 10, 11, 20, 59, 15])] + [("g", 9, at(1))], "file string, message int, time string").withColumn("time", F.to_timestamp_ntz("time"))
    anchors = spark.createDataFrame([("f", "2024-01-01 00:00:00"), ("g", "2024-01-01 00:00:00")], "file string, m string").select("file", F.to_timestamp_ntz("m").alias("meeting_start"))
    got = {r["message"]: (r["turn"], r["place"]) for r in transcripts.attach_chats(turns, chats, anchors).collect()}
    assert got == {0: (0, 1), 1: (0, 2), 2: (1, 1), 5: (1, 2), 3: (3, 1), 4: (3, 2), 9: (None, 1)}


def test_notes_on_a_stack(spark):
    marks = "( ( ) ) ) ( ) ( (".split()
    rows = spark.createDataFrame([(1, k, m == "(") for k, m in enumerate(marks)], "p int, k int, o boolean")
    got = {r["a"]: r["b"] for r in notes.pair_stacked(rows, ["p"], ["k"], F.col("o"), "k", "a", "b").collect()}
    assert got == {0: 3, 1: 2, 5: 6, 7: None, 8: None}


def test_chords_of_repeated_and_empty_notes(spark):
    rows = spark.createDataFrame([("f", 0, 10, 60), ("f", 5, 15, 60), ("f", 5, 8, 64), ("f", 7, 7, 70)], "f string, a int, b int, p int")
    got = {r["at"]: r["pitches"] for r in notes.chords(rows, ["f"], "a", "b", "p").collect()}
    assert got == {0: [60], 5: [60, 64], 8: [60], 10: [60], 15: []}


def test_kinds_labels_and_glossary(spark):
    ops = spark.createDataFrame([("a", "s"), ("b", "c"), ("c", "s"), ("c", "d+")], "file string, kind string")
    names = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "content"), ("e", "d.x")], "file string, name string")
    assert {r["file"]: r["kind"] for r in journal_report.kinds(ops, ["file"], names).collect()} == {"a": "content", "b": "dimension", "c": "mixed", "d": "content", "e": "dimension"}
    cells = spark.createDataFrame([("1",), ("2",), ("3",)], "cell string")
    texts = spark.createDataFrame([("1", "t"), ("2", "")], "cell string, text string")
    assert [r["label"] for r in journal_report.labelled(cells, texts, "cell").orderBy("cell").collect()] == ['#1 "t"', "#2 (empty)", "#3 (empty)"]
    assert {r["label"] for r in journal_report.labelled(cells, None, "cell").collect()} == {"#1", "#2", "#3"}
    known = spark.createDataFrame([("d.1", "first")], "name string, meaning string")
    asked = spark.createDataFrame([("d.1",), ("p:q",), ("z",)], "name string")
    assert {r["name"]: r["meaning"] for r in journal_report.described(asked, "name", known, "a part", "unknown").collect()} == {"d.1": "first", "p:q": "a part", "z": "unknown"}


def test_bodies_and_purposes(spark):
    assert one(spark, checks.required_string(F.col("b"), "n")["value"], b='{"n": "x"}') == "x"
    assert not one(spark, checks.required_string(F.col("b"), "n")["ok"], b=None)
    assert one(spark, checks.optional_number(F.col("b"), "n"), b='{"n": 2}') == 2.0 and one(spark, checks.optional_number(F.col("b"), "n"), b='{"n": "2"}') is None
    assert one(spark, checks.optional_boolean(F.col("b"), "n"), b='{"n": false}') is False
    assert one(spark, checks.included(F.col("l")), l="#include 'a\"b' rest") == 'a"b' and one(spark, checks.included(F.col("l")), l='#include "a') is None
    with pytest.raises(ValueError):
        usage.for_purpose(spark.range(1), "spying", ("research",), ["id"], "id", 2)


def test_a_transcript_with_its_chats(spark):
    turns = spark.createDataFrame([("f", 0, 0.0, "hello"), ("f", 1, 3700.0, "late")], "file string, turn int, start_s double, text string")
    chats = spark.createDataFrame([("f", 0, 2, 9.0, "Bo", "second"), ("f", 0, 1, 5.0, "Al", "first"), ("f", None, 1, 1.0, "No", "turn")], "file string, turn long, place int, at_s double, sender string, text string")
    (page,) = transcripts.markdown(turns, chats).collect()
    assert page["text"] == "# Transcript\n\n- **[00:00]** hello\n    - \U0001f4ac [00:05] **Al:** first\n    - \U0001f4ac [00:09] **Bo:** second\n- **[1:01:40]** late\n"


def test_heads_with_stars_and_an_appendix(spark):
    from loomline.operators import facts, islands

    heads = [(0, 0, False, False), (1, 1, False, False), (2, 0, True, False), (3, 1, False, False), (4, 0, False, True), (5, 1, False, False), (6, 0, False, False)]
    rows = spark.createDataFrame([("f", *h) for h in heads], "f string, k int, level int, star boolean, app boolean")
    got = islands.number_heads(rows, ["f"], "k", "level", 2, starred=F.col("star"), appendix=F.col("app"))
    numbers = {r["k"]: r["number"] for r in got.collect()}
    assert numbers == {0: "1", 1: "1.1", 2: None, 3: "1.2", 4: "A", 5: "A.1", 6: "B"}
    told, missing = facts.label_refs(spark.createDataFrame([("x",), ("y",), ("y",)], "ref string"), spark.createDataFrame([("x", "1.2")], "label string, number string"), "ref")
    assert sorted(map(tuple, told.collect())) == [("x", "1.2"), ("y", "?"), ("y", "?")] and [tuple(r) for r in missing.collect()] == [("y", 2)]
