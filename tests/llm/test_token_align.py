"""The alignment of two tokenizers against a plain version that encodes whole texts and compares offsets one by one."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomline.llm import token_align as t
from loomline.storage import materialise
from tests.llm.helpers import docs, prose

A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
UNICODE = {c: b for b, c in zip(list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256)), [chr(x) for x in list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))], strict=True)}
UNICODE |= {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in UNICODE.values())}


def tokens(text):
    a = [(i, bytes(UNICODE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()) for i in B.encode(text) for p in [B.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (a, b) if b"".join(p for _, p in a) == whole == b"".join(p for _, p in b) else ([], [])


def spans(side):
    at, out = 0, []
    for i, part in side:
        out.append((i, at, at := at + len(part)))
    return out


def plain(texts):
    told, total = [], Counter()
    for text in texts:
        a, b = map(spans, tokens(text) if text else ([], []))
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [(s, e) for s, e in zip([0, *common], common, strict=False)]
        lists = ";".join("|".join(",".join(str(i) for i, lo, hi in side if s <= lo and hi <= e) for side in (a, b)) for s, e in groups)
        links = Counter((i, j) for i, _, e in a for j, _, f in b if e == f)
        overlaps = sum(lo < f and k < e for _, lo, e in a for _, k, f in b)
        total += links
        told.append((len(a), len(b), len(groups), overlaps, lists, links))
    most = Counter()
    for (_, j), n in total.items():
        most[j] = max(most[j], n)
    return [
        (n_a, n_b, g, o, hashlib.sha256(lists.encode()).hexdigest() if n_a else "", links.total(), sum(n for p, n in links.items() if total[p] == most[p[1]]), sum(n * total[p] for p, n in links.items()))
        for n_a, n_b, g, o, lists, links in told
    ]


TEXTS = [
    "Hello world, this is a test of two tokenizers.", "Hello world, this is a test of two tokenizers.", None, "", " ", "  two  spaces  ", "tab\tand\nline\n\nfeeds \n here", "a <|endoftext|> b </s> <s> <unk>",
    "U+2581 ▁ is lost", "good words before ▁ and after it", "é ü ñ café naïve Größe über", "日本語のテキスト と 漢字", "emoji 🙂🙃 and ﬁ ligature ｆｕｌｌ", "no-break space em", "x", "1234567 89,000.00 $5",
    "don't can't we'll I'd", "\x00 nul \x1f control \x7f", "é combining", "|;, | ; ,", "a" * 3000, " leading", "trailing ", "́", "﻿bom", "mixed​zero width",
]


def run(spark, rows, limit=t.PAIRS):
    aligned = materialise(t.align(docs(spark, rows)), "aligned")
    return t.score_links(aligned, materialise(t.pair_counts(aligned), "counts"), limit)


@pytest.mark.parametrize("limit", [t.PAIRS, 0])
def test_equals_whole_texts_compared(spark, limit):
    texts = TEXTS + [prose(k, 40) for k in range(6)]
    got = {r["doc_id"]: r for r in run(spark, list(enumerate(texts)), limit).collect()}
    for k, expected in enumerate(plain(texts)):
        r = got[k]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_overlaps"], r["groups_sha256"], r["n_links"], r["n_best"], r["count_sum"]) == expected, texts[k]


def test_real_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(k, text[:3000]) for k, text in rows]
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_overlaps"], r["groups_sha256"], r["n_links"], r["n_best"], r["count_sum"]) for r in run(spark, rows).collect()}
    assert [got[k] for k, _ in rows] == plain([text for _, text in rows])


def test_groups_text_null_ids_and_empty_table(spark):
    out = t.align(docs(spark, [(None, "Hello world"), (5, "Hello world"), (5, "Hello world")]), with_groups=True).collect()
    assert len(out) == 3 and len({r["groups"] for r in out}) == 1 and {r["doc_id"] for r in out} == {None, 5}
    assert out[0]["groups_sha256"] == hashlib.sha256(out[0]["groups"].encode()).hexdigest()
    assert run(spark, []).collect() == []
    clashing = docs(spark, [(1, "a b")]).selectExpr("*", "1 AS row", "'x' AS pairs", "2 AS n_a", "3 AS count")
    assert t.align(clashing).collect()[0]["n_a"] == 2
