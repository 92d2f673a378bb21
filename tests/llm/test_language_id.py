import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import language_id as l
from tests.llm.helpers import docs


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9])
def test_codewords_are_apart(n):
    code = l.codewords(n)
    assert min(int((code[a] != code[b]).sum()) for a in range(n) for b in range(a)) >= max(1, code.shape[1] // 4)


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = l.predict(rows, l.train(rows), carry=("doc_id", "lang")).withColumn("held", l.held_out(F.col("doc_id"))).collect()
    assert {r["doc_id"]: r["held"] for r in got} == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got}
    held = [r for r in got if r["held"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_lang_of_held_out_documents_is_never_used(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lied = rows.withColumn("lang", F.when(l.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a, b = l.train(rows), l.train(lied)
    assert a.languages == b.languages and (a.weights == b.weights).all() and (a.trust == b.trust).all()


def test_defined_cases(spark):
    train = docs(spark, [(k, text * 20, lang) for k in range(60) for text, lang in (("the wind and that ", "en"), ("der wind und das ", "de"))])
    odd = docs(spark, [(1, None), (2, ""), (3, "12 !? --"), (4, "THE WIND and that"), (5, "ünd der das und " * 30000), (4, "THE WIND and that"), (None, "und das der")])
    model = l.train(train)
    got = l.predict(odd.withColumn("score", F.lit("clash")), model).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == 7 and [by[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert by[4][0] == "en" and by[5][0] == "de" and by[None][0] == "de"
    assert l.predict(docs(spark, []), model).collect() == []
    none = l.train(docs(spark, [(1, "text", None), (2, None, "en")]))
    assert none.languages == () and l.predict(docs(spark, [(1, "text")]), none).first()["lang_pred"] == "und"
    one = l.train(docs(spark, [(k, "some text", "en") for k in range(9)]))
    assert one.languages == ("en",) and l.predict(docs(spark, [(1, "text")]), one).first()["lang_pred"] == "en"


def test_ties_are_ambiguous():
    model = l.Model(("a", "b"), l.codewords(2), np.zeros((l.BUCKETS + 1, 1), np.int64), np.ones((2, 1)))
    assert model.decide(np.zeros(5, np.int64)) == ("a", 0.5, True)


def test_decoding_is_the_plain_one(spark):
    """Every trigram, bit and distance on plain lists, for documents of all languages and lengths."""
    import math

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = l.train(rows)
    texts = [r["text"] for r in rows.select("text").orderBy("doc_id").limit(40).collect()] + ["A b", "é", "Zz9", "xyz" * 400]

    def plain(text):
        data = text.lower().encode()
        fold = [b if b > 127 or 97 <= b <= 122 else 32 for b in data] + [32, 32]
        totals, n = [0] * model.code.shape[1], 0
        for i in range(len(data) - 2):
            bucket = ((fold[i] << 16 | fold[i + 1] << 8 | fold[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16
            n += 1
            for bit in range(len(totals)):
                totals[bit] += int(model.weights[bucket, bit])
        outs = [math.tanh(2 * t / (l.SCALE * max(n, 1))) for t in totals]
        d = [sum(model.trust[k, b] * math.exp(-model.code[k, b] * o) for b, o in enumerate(outs)) for k in range(len(model.languages))]
        best = min(range(len(d)), key=lambda k: (d[k], k))
        second = min(x for k, x in enumerate(d) if k != best)
        return model.languages[best], 1 / sum(math.exp(-model.sharpness * (x - d[best])) for x in d), second - d[best] < model.margin

    got = {r["doc_id"]: r for r in l.predict(docs(spark, list(enumerate(texts))), model).collect()}
    for k, text in enumerate(texts):
        lang, score, ambiguous = plain(text)
        assert (got[k]["lang_pred"], got[k]["ambiguous"]) == (lang, ambiguous) and abs(got[k]["score"] - score) < 1e-9


def test_every_language_is_learnt(spark):
    """200 languages, most of them rare: none is left out, however frequent another one is."""
    def text(k, n):
        return " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + (k * 7 + i) % 26)}" for i in range(n))

    rows = [(1000 * k + i, text(k, 30 + i), f"x{k:03}") for k in range(200) for i in range(9 if k else 300)]
    train = docs(spark, rows)
    model = l.train(train, docs_per_language=20)
    assert len(model.languages) == 200
    got = l.predict(train.filter("lang <> 'x000'"), model, carry=("doc_id", "lang")).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9
    assert len({r["lang_pred"] for r in got}) > 190
