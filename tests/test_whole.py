"""Queries that run over all rows of their tables."""

from loomline.plans import bindings as b

SF = "/root/testdata/sf0.001"


def test_every_order_has_heads(spark):
    got = b.QUERIES["section_numbers"](spark, SF)
    assert got.count() == b.table(spark, SF, "lineitem").count()
    assert {r[0] for r in got.selectExpr("l_orderkey % 10").distinct().collect()} == set(range(10))


def test_references_meet_all_customers_and_miss(spark):
    got = b.QUERIES["ref_coalesce"](spark, SF)
    kinds = {r["kind"] for r in got.select("kind").distinct().collect()}
    odd = got.filter("kind = 'customer' AND ref % 2 = 1").count()
    assert got.count() == b.table(spark, SF, "orders").count() and kinds == {"customer", "supplier", None} and odd > 0


def test_spans_are_of_bytes(spark):
    texts = {r["doc_id"]: r["text"].encode() for r in b.table(spark, SF, "documents").select("doc_id", "text").collect()}
    assert any(len(t) != len(t.decode()) for t in texts.values()) and any(len(t) < 60 for t in texts.values())
    spans = {r["doc_id"]: r["span"] for r in b.QUERIES["byte_span"](spark, SF).collect()}
    assert spans == {k: t[100:150].hex().upper() for k, t in texts.items()}
    quotes = {(r["file"], r["endset"]): (r["quoted"], r["problem"]) for r in b.QUERIES["span_quotes"](spark, SF).collect()}

    def want(k, t, e):
        if e == 2 and k % 5 == 0:
            return None, "source not found"
        return (None, "span outside source") if 10 * e + 40 > len(t) else (t[10 * e : 10 * e + 40].hex().upper(), None)

    assert quotes == {(f"link-{k}", e): want(k, t, e) for k, t in texts.items() for e in (1, 2)}


def test_kinds_are_of_all_days(spark):
    got = b.QUERIES["kind_flags"](spark, SF)
    rows = b.table(spark, SF, "events")
    assert got.select("day").distinct().count() == rows.selectExpr("CAST(ts AS DATE)").distinct().count() > 1
    assert got.select("user_id").distinct().count() == rows.select("user_id").distinct().count()
    assert {r["kind"] for r in got.collect()} == {"mixed", "content", "dimension"}
