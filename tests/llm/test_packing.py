import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import packing as p
from loomline.llm import token_counts
from loomline.llm.tokens import encoder
from tests.llm.helpers import docs, prose


@lru_cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_ids(texts):
    t = tokenizer()
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in texts]


TEXTS = [None, "", "a", "Hello  world\n\n two\tlines \n", "é" * 3000, prose(1, 900), prose(2, 5000), "x<|endoftext|>y", " lead", "trail ", "a\nb", "a \nb", "a\n b", "don't  stop\r\n", "a" * 500] + [prose(k, 40 + 7 * k) for k in range(60)]


def test_pieces_of_all_documents(spark):
    rows = list(enumerate(TEXTS)) + [(5, TEXTS[5])]
    got = p.pack(docs(spark, rows).repartition(3), with_ids=True).collect()
    ids = dict(enumerate(plain_ids(TEXTS)))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and bytes(r["ids"]) == own[r["start"] : r["start"] + r["length"]].tobytes()
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, own in ids.items():
        times = 2 if doc == 5 else 1
        assert Counter(k for s, n in pieces[doc] for k in range(s, s + n)) == Counter({k: times for k in range(len(own))})
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= p.CAPACITY
    assert p.pack(docs(spark, [])).collect() == []


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 9), max_size=12))
def test_plan_uses_everything_once(counts):
    used = Counter()
    for pattern, times in p.plan(counts, 64):
        assert sum(length * n for length, n in pattern) <= 64
        for length, n in pattern:
            used[length] += n * times
    assert used == Counter(counts)


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), min_size=1, max_size=6))
def test_fill_leaves_the_least_slack(counts):
    seed = max(counts)
    rest = [k for k, n in counts.items() for _ in range(n - (k == seed))]
    sums = {seed}
    for x in rest:
        sums |= {s + x for s in sums if s + x <= 64}
    total = sum(length * n for length, n in p.fill(counts, 64))
    assert p.padding(total, 64) == min(p.padding(s, 64) for s in sums) or total == max(sums)


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), min_size=1, max_size=6))
def test_fill_takes_the_greatest_sum(counts):
    seed = max(counts)
    sums = {seed}
    for x in [k for k, n in counts.items() for _ in range(n - (k == seed))]:
        sums |= {s + x for s in sums if s + x <= 64}
    assert sum(length * n for length, n in p.fill(counts, 64)) == max(sums)


def test_a_power_of_two_does_not_end_a_sequence():
    assert p.plan({512: 1, 500: 1}) == [(((512, 1), (500, 1)), 1)]


@pytest.mark.parametrize("text", TEXTS[:16])
def test_ids_are_the_tokenizers(text):
    assert encoder()(text or "") == plain_ids([text])[0][:-1].tobytes()


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" + " \t\n" * 400_000 + "b" + " " * 300_000, ("word " * 50 + " " * 30_000) * 20, "\u3000" * 400_000 + "x"])
def test_ids_of_long_runs_of_white_space(text):
    assert encoder()(text) == plain_ids([text])[0][:-1].tobytes()


def test_a_text_of_blanks_is_packed_and_counted(spark):
    rows = docs(spark, [(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "a b")])
    pieces = p.pack(rows).collect()
    want = {k: len(plain_ids([t])[0]) for k, t in ((1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "a b"))}
    assert {k: sum(r["length"] for r in pieces if r["doc_id"] == k) for k in want} == want
    counts = token_counts.count_tokens(rows).filter("tokenizer LIKE 'byte%'").collect()
    assert {r["doc_id"]: r["n_tokens"] + 1 for r in counts} == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\t'.é1", max_size=30))
def test_ids_of_any_text(text):
    assert encoder()(text) == plain_ids([text])[0][:-1].tobytes()
