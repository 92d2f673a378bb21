from collections import Counter

from loomline.llm import token_counts as t
from loomline.storage import shared_path
from tests.llm.helpers import docs, prose
from tests.llm.test_packing import plain_ids

KEYED = "doc_id long, source string, lang string, tokenizer string, n_tokens long, old_tokens long"


def test_counts_are_the_tokenizers(spark):
    texts = [None, "", "one two\tthree", prose(1, 500), "é" * 99]
    got = {(r["doc_id"], r["tokenizer"]): r["n_tokens"] for r in t.count_tokens(docs(spark, list(enumerate(texts)))).collect()}
    for k, ids in enumerate(plain_ids(texts)):
        assert got[k, "byte_bpe_50k@1"] == len(ids) - 1 and got[k, "words@1"] == len((texts[k] or "").split())
    assert t.count_tokens(docs(spark, [])).collect() == []


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


def test_batches_apply_once(spark):
    roll = t.Rollup(spark, shared_path(spark, "test-rollup"))
    assert totals(roll) == {}
    rows = spark.createDataFrame([(1, "a", "en", "v", 10, 4), (2, "a", None, "v", None, 1), (3, None, "en", "v", 7, 7), (1, "a", "en", "v", 10, 4)], KEYED)
    assert roll.commit("1", t.inserts(rows)) and not roll.commit("1", t.inserts(rows))
    assert totals(roll) == {("a", "en", "v"): (2, 20), ("a", None, "v"): (1, 0), (None, "en", "v"): (1, 7)}
    assert roll.commit("2", t.revisions(rows))
    roll.compact()
    roll.compact()
    assert not roll.commit("2", t.revisions(rows))
    assert roll.commit("3", t.deletes(rows.filter("source IS NULL"))) and roll.commit("4", t.inserts(rows.limit(0)))
    assert totals(roll) == {("a", "en", "v"): (2, 32), ("a", None, "v"): (1, -1)}


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    roll = t.Rollup(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a", "en", "v", 10, 4)], KEYED)
    roll.commit("1", t.inserts(rows))
    (tmp_path / "batches/1/_SUCCESS").unlink()
    assert totals(roll) == {} and roll.commit("1", t.inserts(rows)) and totals(roll) == {("a", "en", "v"): (1, 10)}


def test_query_equals_a_recount(spark):
    from loomline.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] == 1}
    want_docs, want_tokens = Counter(), Counter()
    for r, ids in zip(rows, plain_ids([r["text"] for r in rows]), strict=True):
        if r["doc_id"] not in toxic:
            for name, n in (("byte_bpe_50k@1", len(ids) - 1), ("words@1", len(r["text"].split()))):
                want_docs[r["source"], r["lang"], name] += 1
                want_tokens[r["source"], r["lang"], name] += n
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in queries.op9_token_counts(spark, sf).collect()}
    assert got == {k: (n, want_tokens[k]) for k, n in want_docs.items()}


def test_vacuumed_batches_stay_known(spark, tmp_path):
    roll = t.Rollup(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a", "en", "v", 10, 4)], KEYED)
    for name in "12":
        roll.commit(name, t.inserts(rows))
    roll.compact()
    roll.vacuum()
    assert roll.batches() == [] and totals(roll) == {("a", "en", "v"): (2, 20)}
    assert not roll.commit("1", t.inserts(rows)) and roll.commit("3", t.inserts(rows))
    roll.compact()
    roll.vacuum()
    assert totals(roll) == {("a", "en", "v"): (3, 30)} and not roll.commit("3", t.inserts(rows)) and not roll.commit("2", t.inserts(rows))
    assert len(list((tmp_path / "snapshots").iterdir())) == 1 and list((tmp_path / "pending").iterdir()) == []


def test_carried_columns(spark):
    rows = docs(spark, [(1, "a b")]).withColumn("tokenizer_x", t.F.lit(7))
    assert {r["tokenizer_x"] for r in t.count_tokens(rows, carry=("tokenizer_x",)).collect()} == {7}
