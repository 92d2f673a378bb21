"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from loomline.llm import collocations as c
from tests.llm.helpers import docs, lower


def plain(rows, least, longest=4, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, words), a in f.items():
        if len(words) > 1 and a >= least:
            score, _, l, r = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
            found[lang, words] = (a, l, r, score)
    absorbed = {(lang, w[i : i + k]) for (lang, w), (m, *_) in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * m >= 80 * f[lang, w[i : i + k]]}
    out = []
    for lang in sorted({x for x, _ in found}):
        mine = [(-s, -a, " ".join(w).encode(), l, r) for (x, w), (a, l, r, s) in found.items() if x == lang and (x, w) not in absorbed]
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(mine)[:top], 1)]
    return out


def corpus(seed, n=60):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = [rng.choice(["the", "of", "a", "New York City Hall", "et", "été", "x\ty", "A", "b."]) if rng.random() < 0.6 else f"w{rng.randrange(30)}" for _ in range(rng.randrange(60))]
        out.append((rng.choice(["en", "fr", None, "und"]), rng.choice([" ", "  ", " "]).join(words) + rng.choice(["", ".", "\n", " !"])))
    return out


def run(spark, rows, **how):
    df = docs(spark, [(k, text, lang) for k, (lang, text) in enumerate(rows)])
    return sorted(tuple(r) for r in c.collocations(df, **how).collect())


@pytest.mark.parametrize("seed, limit", [(0, c.LIMIT), (1, 0), (2, c.LIMIT)])
def test_equals_plain_counts(spark, seed, limit):
    rows = corpus(seed) + [(None, None), ("en", ""), ("en", "a a a a a"), ("en", " ,,; ")]
    for least, top in ((3, 2000), (2, 7)):
        expected = plain(rows, least, top=top)
        assert len(expected) > 15
        assert run(spark, rows, least=least, top=top, limit=limit) == sorted(expected)


def test_pieces_case_and_repeated_rows(spark):
    rows = [("en", "Hello World, hello\x0bworld HELLO  world")] * 3 + [("de", "hello world")]
    assert run(spark, rows, least=6) == [("en", 1, "hello world", 6, 9, 9, 18, 666666)]


def test_scores_beyond_64_bits(spark):
    level = spark.createDataFrame([(1, "en", "a b", "b", 9 * 10**17, 2, 3, [10**18], [10**18])], c.LEVEL)
    assert c.scored(level, 2, None).collect()[0]["score"] == 900_000
    longer = spark.createDataFrame([(9, "en", "a b c", "c", 72 * 10**16, 1, 5, [1, 1], [1, 1])], c.LEVEL)
    assert c.scored(level, 2, longer).collect() == []


def test_nothing_frequent_and_empty_table(spark):
    assert run(spark, [("en", "some words only once")]) == []
    assert run(spark, []) == []
    assert run(spark, [("en", "a. b. a. b")] * 40) == []


def test_clashing_columns(spark):
    df = docs(spark, [(k, "x y z", "en") for k in range(30)]).selectExpr("*", "'q' AS phrase", "1 AS h", "2 AS n", "3 AS score", "4 AS rank")
    assert [r["phrase"] for r in c.collocations(df).collect()] == ["x y z"]
