import re

from pyspark.sql import functions as F

from loomline.llm import quality_rules as q
from tests.llm.helpers import SPACE_WORDS, docs, prose


def brute(text):
    text = text or ""
    words = SPACE_WORDS.findall(text)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), text.count("!"), len(lines))


TEXTS = [None, "", " \n\t", "a", "a b c a b c", "x x x x x", "é ü\x0bß#\n\né ü\x0bß#\n  \n ", "line\nline \nline\n", prose(1, 80), prose(2, 40) + "\n" + prose(2, 40), "# " * 99, "NO!! " * 70, prose(3, 20000)]


def test_measures_match_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "again")]
    got = q.measure(docs(spark, rows).withColumn("n_words", F.lit("clash"))).collect()
    assert sorted(map(tuple, got)) == sorted((k, *brute(t)) for k, t in rows)
    assert q.ledger(docs(spark, [])).collect() == []


def test_bits_policies_and_ablation(spark):
    rows = q.ledger(docs(spark, list(enumerate(TEXTS))))
    ledger = rows.collect()
    for r in ledger:
        for rule in q.RULES:
            assert bool(r["fail_bits"] >> rule.bit & 1) == bool(eval(rule.fails.replace("AND", "and"), {m: r[m] for m in q.MEASURES}))
    for policy in q.POLICIES.values():
        kept = {r["doc_id"] for r in q.apply_policy(rows, policy).filter("kept").collect()}
        assert kept == {r["doc_id"] for r in ledger if not r["fail_bits"] & policy.mask()}
        for a in q.ablation(rows, policy).collect():
            flag = next(1 << r.bit for r in q.RULES if r.name == a["rule"])
            bits = [r["fail_bits"] & policy.mask() for r in ledger]
            assert (a["n_failed"], a["n_failed_alone"], a["n_kept_without"]) == (sum(b & flag > 0 for b in bits), sum(b == flag for b in bits), sum(b & ~flag == 0 for b in bits))


def test_a_threshold_itself_passes(spark):
    words = [f"u{k}" for k in range(50)]
    text = " ".join(words)
    assert q.ledger(docs(spark, [(1, text), (2, " ".join(words[:49]))])).select("doc_id", (F.col("fail_bits") % 2).alias("b")).sort("doc_id").collect() == [(1, 0), (2, 1)]


def test_tables_stay_and_runs_of_symbols_go(spark):
    row = " | ".join(f"cell{k}" for k in range(60))
    rows = q.ledger(docs(spark, [(1, row), (2, "###$$$ word " * 60 + prose(1, 60))]))
    kept = {version: {r["doc_id"] for r in q.apply_policy(rows, policy).filter("kept").collect()} for version, policy in q.POLICIES.items()}
    assert kept["v3"] == {1} and kept["v2"] == set()
