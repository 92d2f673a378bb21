"""Chunks that read back, and logs compared by ranges."""

import random

from pyspark.sql import functions as F

from loomline.operators import chunks as c
from loomline.operators import clocks


def test_cuts_are_bounded_and_follow_the_bytes():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    ends = c.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and all(c.LEAST <= s <= c.MOST for s in sizes[:-1]) and 20 < len(sizes) < 120
    shifted = c.cuts(b"inserted at the front" + data)
    assert len({e + 21 for e in ends} - set(shifted)) < 4  # all but the first cuts are found again
    assert c.cuts(b"") == [0] and c.cuts(b"x" * 300) == [300] and c.cuts(bytes(20_000))[0] in (c.LEAST, c.MOST)


def test_versions_share_chunks_and_read_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("text IS NOT NULL")
    edited = docs.select("doc_id", F.lit(2).alias("v"), F.concat(F.lit("before. "), "text", F.lit(" after.")).alias("text"))
    rows = docs.select("doc_id", F.lit(1).alias("v"), "text").union(edited).union(docs.limit(1).selectExpr("-1L", "1", "''")).union(docs.limit(1).selectExpr("-2L", "1", "CAST(NULL AS STRING)"))
    pieces = c.split(rows, ["doc_id", "v"], "text")
    listed, held = c.manifest(pieces, ["doc_id", "v"]), c.store(pieces)
    back = c.read(listed, held, ["doc_id", "v"]).join(rows, ["doc_id", "v"])
    assert back.filter("state <> 'whole' OR CAST(content AS STRING) <> text").count() == 0 and back.count() == rows.filter("text IS NOT NULL").count()
    sums = {r["v"]: r for r in c.saving(listed, ["v"]).collect()}
    assert sums[2]["n_new_bytes"] < 0.6 * sums[2]["n_bytes"] and sums[1]["n_new_bytes"] <= sums[1]["n_bytes"]
    assert c.store(pieces, held).count() == 0
    lost = held.filter("length > 0").limit(1)
    states = c.read(listed, held.join(lost.select("digest"), "digest", "left_anti"), ["doc_id", "v"])
    assert states.filter("state = 'damaged' AND content IS NULL").count() > 0
    bad = held.withColumn("chunk", F.when(F.col("length") > 500, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("chunk")))
    assert c.read(listed, bad, ["doc_id", "v"]).filter("state = 'damaged'").count() > 0
    assert c.read(c.manifest(c.split(rows.limit(0), ["doc_id", "v"], "text"), ["doc_id", "v"]), held, ["doc_id", "v"]).collect() == []


def test_only_differing_ranges_are_exchanged(spark):
    mine = spark.range(50_000)
    theirs = spark.range(50_000).filter("id NOT IN (7, 40000)").union(spark.createDataFrame([(-5,), (-5,), (None,)], "id long"))
    found, sent = clocks.missing_by_ranges(mine, theirs, "id")
    assert sorted(map(tuple, found.collect())) == [(-5, "mine"), (7, "theirs"), (40000, "theirs")]
    assert sent.count() < 20  # of 100,000: three ranges of 65,536
    same, none = clocks.missing_by_ranges(mine, mine.union(mine), "id")
    assert same.collect() == [] and none.collect() == []
    empty, all_ = clocks.missing_by_ranges(mine.limit(0), spark.range(3), "id")
    assert empty.count() == 3 and all_.count() == 3
