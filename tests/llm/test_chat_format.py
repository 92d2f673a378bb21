import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string"


def told(spark, rows, schema=SCHEMA):
    out = c.format_chats(spark.createDataFrame(rows, schema))
    read = out.withColumn("turns", c.read_turns(F.col("formatted"))).withColumn("loss", c.read_loss_text(F.col("segments")))
    return {r["conv_id"]: r for r in read.collect()}


def test_control_strings_come_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\b[\\<\\\\", "[ROLE/] x", "<s>[SYS] y</s>", "", "\\", "[", "<é\n>"]
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", x) for k in range(3) for t, x in enumerate(nasty)]
    for r in told(spark, rows).values():
        assert [(t["role"], t["text"]) for t in r["turns"]] == [("user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(nasty)]
        assert r["loss"] == "".join(nasty[1::2]) and r["valid"]
        inside = [s["text"] for k, s in enumerate(r["segments"]) if k % 3 == 1]
        assert not any(tag.strip() in t for t in inside for tag in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[/ROLE]", "[ROLE/]"))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool[/ROLE] ", "<s>", ""]), st.text("ab[]/<>\\sINTROLE \n", max_size=12)), min_size=1, max_size=6))
def test_any_turns_come_back(turns):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    r = told(spark, [(1, k, role, text) for k, (role, text) in enumerate(turns)])[1]
    assert [(t["role"], t["text"]) for t in r["turns"]] == turns


def test_another_template_comes_back(spark):
    other = c.Template(open=(("user", "<|u|>"), ("bot", "<|b|>")), begin="[*", end="<|.end|>", trained=("bot",), machine=(("start", "user", "asked"), ("asked", "bot", "answered")))
    turns = [("user", "<|.end|>[*<|b|> no"), ("bot", "a <|xend|> b[ROLE]"), ("tool", "[*<|u|>\\")]
    rows = spark.createDataFrame([(1, k, r, x) for k, (r, x) in enumerate(turns)], SCHEMA)
    r = c.format_chats(rows, other).withColumn("turns", c.read_turns(F.col("formatted"), other)).withColumn("loss", c.read_loss_text(F.col("segments"))).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == turns and r["loss"] == turns[1][1]


@pytest.mark.parametrize("bad", [{"begin": "*s*"}, {"end": "END"}, {"end": "<"}, {"open": (("user", "<u>"), ("bot", "<u>b"))}, {"open": (("user", "[ROLE]u"),)}, {"open": (("user", "<u></s>"),)}, {"begin": "[\\x"}])
def test_templates_that_could_not_be_undone_are_refused(bad):
    with pytest.raises(ValueError):
        c.Template(**bad)


def test_machine(spark):
    orders = {1: "ua", 2: "sua", 3: "uaua", 4: "au", 5: "u", 6: "suu", 7: "usa", 8: "x", 9: "s"}
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    got = told(spark, [(k, t, names[x], "t") for k, o in orders.items() for t, x in enumerate(o)])
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False, 8: False, 9: False}
    assert got[6]["valid_turns"] == 2 and got[6]["end_state"] == "broken" and got[5]["end_state"] == "asked"


def test_nulls_ties_repeats_empty_and_extra_columns(spark):
    rows = [(1, 0, "user", None, "x"), (1, 0, "assistant", "b", "y"), (1, 0, "assistant", "b", "z"), (None, None, None, None, None), (2, 1, "assistant", "é" * 5000, "")]
    got = told(spark, rows, SCHEMA + ", segments string")
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("assistant", "b"), ("assistant", "b"), ("user", "")]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [(None, "")]
    assert hashlib.sha256(got[2]["loss"].encode()).hexdigest() == hashlib.sha256(("é" * 5000).encode()).hexdigest()
    assert told(spark, [], SCHEMA) == {}
