"""Formats on hand-made files."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as fn
from loomline.sources import documents as d
from loomline.sources import journal as j
from loomline.sources import transcripts as t
from loomline.storage import shared_path
from loomline.streaming import log


def files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "file string, text string")


def test_journals(spark, tmp_path):
    ops = [("c", "9", "10"), ("d+", "9", None), ("s", "1", "nul \0 face \U0001f600"), ("d-", "é", None)]
    whole = j.encode([(5, ops), (7, ops[:1])])
    for name, data in {"a": whole, "b": whole[:-3], "c": b"GZZ1" + whole[4:], "d": whole[:16], "e": whole + b"x", "f": b"GZ"}.items():
        (tmp_path / name).write_bytes(data)
    rows = j.read_journals(spark, str(tmp_path)).withColumn("file", F.substring_index("file", "/", -1)).orderBy("file", F.asc_nulls_last("block_idx"), F.asc_nulls_last("op_idx")).collect()
    by = {f: [r for r in rows if r["file"] == f] for f in "abcdef"}
    assert [(r["kind"], r["a"], r["b"]) for r in by["a"]] == [*ops, ops[0]] and {r["stamp"] for r in by["a"]} == {5, 7}
    assert [r["kind"] for r in by["b"]] == ["c", "d+", "s", "d-", None] and by["b"][-1]["error"]
    assert len(by["c"]) == 1 and by["c"][0]["error"] and by["d"] == [] and by["f"][0]["error"]
    assert len(by["e"]) == 6 and by["e"][-1]["error"]
    ordered = j.in_order(j.operations(spark.createDataFrame([("x", bytearray(whole))], "file string, content binary"))).orderBy("seq").collect()
    assert [r["kind"] for r in ordered] == ["d+", "d-", "c", "s", "c"]


def test_captions(spark):
    long = "N" * 61
    text = f"WEBVTT\r\n\r\n1\r\n00:00:01.500 --> 00:00:02.000\r\nAda: hello\r\nthere\r\n\r\n00:00:03.000 --> 00:00:04.000\nAda: again\n\n2\n01:00:00.000 --> 01:00:01.000\nDr. B: text\n\n00:00:09.000 --> 00:00:10.000\n{long}: x\n\nno time here\n\n00:00:11.000 --> 00:00:12.000\n"
    got = [tuple(r)[2:] for r in t.utterances(t.cues(files(spark, a=text))).orderBy("utterance").collect()]
    assert got == [("Ada", 1.5, 2, "hello there again"), ("Unknown Speaker", 3600.0, 2, f"Dr. B: text {long}: x")]


def test_chats(spark):
    text = "lost line\n00:01:40\tAda:\tfirst \nmore\n\nend\n1:30\tBo to Ada (Direct Message):\t\n\n  \nlate"
    got = [tuple(r)[1:] for r in t.chats(files(spark, a=text), 95.0).orderBy("message").collect()]
    assert got == [(1, 5.0, "Ada", False, "first\nmore\n\nend"), (2, 0.0, "Bo", True, "late")]
    wall = "2024-01-02 03:04:05 From Ada to Everyone:\n  hi \n\nyou\n2024-01-02 03:05:00 From Bo to Ada:\nsecret\n"
    assert [(r["sender"], r["text"]) for r in t.wall_chats(files(spark, a=wall)).collect()] == [("Ada", "hi you")]
    assert t.wall_chats(files(spark, a=wall), include_private=True).count() == 2


def test_spans(spark):
    text = "type = quote\nENDSET 1\nhttp://h/Doc.txt\nSTART=0\nLENGTH=3\nSTART=3\nLENGTH=2\nENDSET\nhttp://h/none.txt\nSTART=1\nLENGTH=1\nLENGTH=9\nENDSET 3\nhttp://h/doc.txt\nSTART=90\nLENGTH=1"
    sources = spark.createDataFrame([("doc.txt", bytearray("é a€b".encode("cp1252")))], "name string, content binary")
    got = t.extract_spans(t.spans(files(spark, x=text)), sources).select("*", fn.span_text("bytes").alias("t")).orderBy("endset", "span").collect()
    assert [(r["endset"], r["span"], r["t"], r["problem"]) for r in got] == [
        (1, 1, "é a", None), (1, 2, "€b", None), (2, 1, None, "source not found"), (2, 2, None, "LENGTH without START or ENDSET"), (3, 1, None, "span outside source")
    ]
    assert {r["link_type"] for r in got} == {"quote"}


def test_rolling_captions(spark):
    def tagged(*pairs):
        return "".join(f"<00:00:0{s}.000><c> {w}</c>" for w, s in pairs)

    text = f"00:00:01.000 --> x\nold\none{tagged(('two', 2), ('three', 3))}\n\n00:00:04.000 --> x\none two three\n\n00:00:05.000 --> x\ntwo three{tagged(('&gt;&gt;', 6), ('four', 7))}\n\nnoise"
    got = [(r["seq"], r["word"], r["ts"][6:8]) for r in t.word_timeline(files(spark, a=text, b="")).orderBy("seq").collect()]
    assert got == [(0, "one", "01"), (1, "two", "02"), (2, "three", "03"), (3, ">>", "06"), (4, "four", "07")]


def test_comments(spark):
    tree = [{"block": {"type": "Paragraph", "id": "b1", "text": "hi"}, "children": [{"block": {"type": "Paragraph", "id": "b2", "text": " "}, "children": [{"block": {"text": "deep"}}]}]}]
    export = {"comments": [{"id": "c1", "author": "a1", "content": tree, "createTime": "2024-01-01"}, {"id": "c2", "author": "abcdefghijklmnop", "replyParent": "c1"}], "authors": {"a1": {"metadata": {"name": "Ada"}}}}
    rows = d.comments(files(spark, good=json.dumps(export), bad="{nope"))
    got = {r["id"]: r for r in rows.collect()}
    assert set(got) == {"c1", "c2"} and (got["c1"]["author"], got["c2"]["author"]) == ("Ada", "abcdefghijkl") and got["c2"]["parent"] == "c1"
    flat = d.blocks(rows.select("id", "content"), F.col("content")).orderBy("seq").collect()
    assert [(r["seq"], r["depth"], r["text"]) for r in flat] == [(0, 0, "hi"), (2, 2, "deep")]


def test_snapshots(spark, tmp_path):
    snapshot = {"schemaVersion": 1, "ownerId": "o", "revision": 4, "cells": [{"id": "c", "kind": "plain", "ownerId": "o"}], "dimensions": [], "connections": [{"cellId": "c", "dimensionId": "d", "poswardId": "e"}, {"cellId": "e", "dimensionId": "d", "negwardId": "c"}, {"cellId": "f", "dimensionId": "d", "poswardId": "g"}]}
    (tmp_path / "s.json").write_text(json.dumps(snapshot, indent=1))
    parts = d.read_snapshots(spark, str(tmp_path))
    assert parts["cells"].count() == 1 and {tuple(r) for r in d.mirrored(parts["connections"]).collect()} == {("o", "d", "c", "e"), ("o", "d", "f", "g")}
    assert [(r["src"], r["dst"]) for r in d.half_links(parts["connections"]).collect()] == [("f", "g")]


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert [one(fn.hms(F.lit(x))) for x in (0.5, 1.5, 3661.0, -4.0)] == ["00:00:00", "00:00:02", "01:01:01", "00:00:00"]
    assert [one(fn.clock(F.lit(x))) for x in (59.9, 3599.9, 3600.0)] == ["00:59", "59:59", "1:00:00"]
    assert [one(fn.seconds_of(F.lit(x))) for x in ("01:02:03.5", "2:03", "7", "x", "1:2:3:4")] == [3723.5, 123.0, 7.0, None, None]
    assert one(fn.iso_minute(F.lit("2024-01-02T03:04:05Z"))) == "2024-01-02 03:04 UTC" and one(fn.iso_minute(F.lit("soon"))) == "soon"
    assert one(fn.quoted(F.lit('a"b' + "c" * 30), 12)).startswith('"a\\"b') and one(fn.humanized(F.lit("my-page_Name"))) == "My page Name"
    a = one(fn.address(F.lit("hm://uid/a/b?v=x1#blk[3:9]")))
    assert (a["uid"], a["path"], a["version"], a["block_ref"], a["origin"]) == ("uid", ["a", "b"], "x1", "blk", None)
    assert one(fn.address(F.lit("https://host/hm/uid/p#b+")))["origin"] == "https://host" and one(fn.address(F.lit("https://host/hm/api/x"))) is None and one(fn.address(F.lit("plain"))) is None
    assert json.loads(one(fn.expand_json(F.lit(json.dumps({"a": json.dumps({"b": "[1,2]"}), "c": "{no", "d": "["}))))) == {"a": {"b": [1, 2]}, "c": "{no", "d": "["}
    assert [one(fn.name_list(F.array(*map(F.lit, x)) if x else F.array().cast("array<string>"))) for x in ([], ["A"], ["A", "B"], list("ABCDE"))] == ["Unknown", "A", "A and B", "A, B, C, D and others"]
    assert one(fn.last_component(F.lit("a/b%20c+d"))) == "b c+d" and one(fn.word_count(F.lit("  a \n b "))) == 2 and one(fn.percent_decoded(F.lit("%41"))) == "A"


def test_streamed_logs(spark):
    base = shared_path(spark, "test-log")
    blocks = spark.createDataFrame([("l", "hello"), ("l", "world"), ("m", "é")], "log string, data string")
    blocks.coalesce(1).write.parquet(f"{base}/in")
    source = log.open_log(spark, "parquet", f"{base}/in", "log string, data string")
    for _ in range(2):  # the second run finds nothing new
        log.replicate(source, f"{base}/out", f"{base}/checkpoint")
    assert {tuple(r) for r in log.lengths(spark.read.parquet(f"{base}/out"), ["log"], "data").collect()} == {("l", 2, 10), ("m", 1, 2)}
    blocks.limit(1).write.mode("append").parquet(f"{base}/in")
    seen = []
    log.subscribe(log.open_log(spark, "parquet", f"{base}/in", "log string, data string"), lambda df, n: seen.extend(df.collect()), f"{base}/sub")
    assert len(seen) == 4
    with pytest.raises(ValueError):
        log.open_log(spark, "pigeon", base, "x int")


def test_snapshots_users_and_folders(spark, tmp_path):
    from loomline.sources import documents as d
    from loomline.sources import transcripts as t

    assert all(df.collect() == [] for df in d.read_snapshots(spark, str(tmp_path / "none.json")).values())
    told = spark.createDataFrame([("u", '{"schemaVersion": 1, "ownerId": "u", "revision": 3, "cells": [{"id": "k"}], "dimensions": [], "connections": []}')], "ownerId string, json string")
    d.write_snapshots(told, str(tmp_path / "out"))
    back = d.read_snapshots(spark, str(tmp_path / "out" / "owner=u" / "*"))["cells"].collect()
    assert [(r["owner"], r["revision"], r["id"]) for r in back] == [("u", 3, "k")]
    files = spark.createDataFrame([("a", '{"users": [{"id": "1", "handle": "x"}, {"id": "1", "handle": "y"}, {"id": "2"}]}'), ("b", '{"users": [{"id": "2", "handle": "z"}]}'), ("c", "no json")], "file string, text string")
    assert {r["id"]: r["handle"] for r in d.users(files).collect()} == {"1": "y", "2": "z"}
    spans = spark.createDataFrame([("f", "t", 1, "http://h/A.txt", 1, 0, 1, None), ("f", "t", 1, "b.txt", 2, 0, 1, None)], "file string, link_type string, endset int, source string, span int, start long, length long, error string")
    sources = spark.createDataFrame([("A.txt", bytearray(b"1"), 2), ("A.txt", bytearray(b"2"), 1), ("B.txt", bytearray(b"3"), 2)], "name string, content binary, priority int")
    assert {r["source"]: bytes(r["bytes"]) for r in t.extract_spans(spans, sources).collect()} == {"http://h/A.txt": b"2", "b.txt": b"3"}


def test_cues_from_100_hours_on(spark):
    cue = "{0} --> {1}\nold\n{2}<{0}><c> late</c>"
    text = "WEBVTT\n\n" + "\n\n".join(cue.format(a, b, w) for a, b, w in (("99:59:59.000", "100:00:00.000", "one"), ("100:00:00.000", "100:00:01.000", "two"), ("1000:00:00.000", "1000:00:01.000", "three")))
    got = [(r["word"], r["ts"]) for r in t.word_timeline(files(spark, a=text)).orderBy("seq").collect()]
    assert got == [(w, x) for w, x in zip("one late two late three late".split(), [x for x in ("99:59:59.000", "100:00:00.000", "1000:00:00.000") for _ in (0, 1)], strict=True)]


def test_overlaps_by_the_prefix_function():
    import random

    rng = random.Random(2)
    for _ in range(3000):
        said, new = ([rng.choice("ab") for _ in range(rng.randrange(9))] for _ in (0, 1))
        assert t._overlap(said, new) == max(k for k in range(min(len(said), len(new)) + 1) if said[len(said) - k :] == new[:k])


def test_exports_that_cannot_be_read_are_named(spark):
    from loomline.sources import documents

    def deep(n):
        node = {"block": {"text": "x"}}
        for _ in range(n):
            node = {"block": {"text": "x"}, "children": [node]}
        return json.dumps({"comments": [{"id": "1", "content": [node]}]})

    df = files(spark, ok=deep(3), deep=deep(600), text="plain", empty="", cut=deep(3)[:-5])
    assert {r["file"]: r["problem"] for r in documents.unreadable(df).collect()} == {"deep": "no comments, damaged, or nested too deep", "cut": "no comments, damaged, or nested too deep", "text": "no JSON object", "empty": "empty"}
    rows = documents.comments(df)
    assert [r["file"] for r in rows.collect()] == ["ok"]
    assert [r["depth"] for r in documents.blocks(rows, F.col("content")).orderBy("seq").collect()] == [0, 1, 2, 3]


GOLDEN = """1. WHAT THIS FILE IS
File        : d.one
Blocks      : 2  (stamps 5 to 9)
Operations  : connect=5, disconnect(+)=1, disconnect(-)=1, set-text=4
2. HISTORY (one block per timestamp, in file order)
Stamp 5  -  7 operation(s): 1 noop, 3 link, 3 text
   Unlink #7: it had no - neighbour, so nothing changed
   Link #1  →  #2
   Link #2  →  #10
   Link #9  →  #9
   Set text of #1 to "a"
   … and 2 more
Stamp 9  -  4 operation(s): 1 unlink, 1 link, 1 noop, 1 meta
   Unlink #1 from its + neighbour #2
   Link #3  →  #10   (#10's old - neighbour #2 was detached)
   Link #3  →  #10 (already linked, no change)
   Save time recorded: 2024-01-01 00:00:00 UTC
3. CURRENT STATE (after replaying every block)
Linked cells  : 3
Ranks         : 2  (1 linear, 1 circular)
Link records  : 2
Rank lengths  : 1 rank(s) of 1 cells
Rank lengths  : 1 rank(s) of 2 cells
Rank 1 (2 cells): #3  →  #10
Rank 2 (1 cells, circular): #9
1. WHAT THIS FILE IS
File        : e.empty
Blocks      : 0
2. HISTORY (one block per timestamp, in file order)
(no blocks: nothing was ever stored in this file)
3. CURRENT STATE (after replaying every block)
No cell is linked on this dimension."""


def test_reports_of_journals(spark, tmp_path):
    from loomline.operators import journal_text

    first = [("c", "1", "2"), ("s", "1", "a"), ("s", "1", "b"), ("c", "2", "10"), ("d-", "7", None), ("c", "9", "9"), ("s", "2", "")]
    second = [("c", "3", "10"), ("s", "savetime", "1704067200000"), ("d+", "1", None), ("c", "3", "10")]
    content = spark.createDataFrame([("d.one", j.encode([(5, first), (9, second)]))], "file string, content binary")
    lines = journal_text.report(j.operations(content), spark.createDataFrame([("e.empty",)], "file string"), most=5)
    path = str(tmp_path / "report")
    journal_text.write_lines(lines, path, files=3)
    got = [r["line"] for r in journal_text.read_lines(spark, path).orderBy("number").collect()]
    assert got == GOLDEN.split("\n")
    files = sorted((tmp_path / "report").glob("part*"))
    assert len(files) > 1 and "".join(f.read_text() for f in files) == GOLDEN + "\n"
