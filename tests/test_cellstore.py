"""Cell stores, whole and cut into blocks that several tasks read."""

from pyspark.sql import functions as F

from loomline.sources import cellstore as c
from loomline.sources import documents


def test_records_links_and_problems(spark, tmp_path):
    text = "KEY=2|Test Slice\r\nVAL=slab\r\n\r\nKEY=3|Test Slice\r\nVAL=\r\nKEY=2|Test Slice+d.text\r\nVAL=3|Test Slice\r\nKEY=3|Test Slice-d.text\r\nVAL=2|Test Slice\r\nKEY=2|Test Slice-d.clone\r\nVAL=241|0.db\r\nVAL=lost\r\nKEY=alone\r\nKEY=9|s\r\nVAL=one^ntwo \x97 caf\xe9\r\nwhat\r\nKEY=2|Test Slice\r\nVAL=again\r\nKEY=end"
    (tmp_path / "a.zzz").write_bytes(text.encode("latin-1"))
    (tmp_path / "empty.zzz").write_bytes(b"")
    rows = c.read_records(spark, str(tmp_path), "*.zzz")
    assert sorted((r["key"], r["problem"]) for r in rows.filter("problem IS NOT NULL").collect() if r["key"]) == [("alone", "a key without value"), ("end", "a key without value")]
    assert sorted(r["problem"] for r in rows.filter("problem IS NOT NULL AND key IS NULL").collect()) == ["a value without key", "no such line"]
    now = c.current(rows)
    assert sorted((r["cell"], r["number"], r["slice"], r["text"]) for r in c.cells(now).collect()) == [("2|Test Slice", 2, "Test Slice", "again"), ("3|Test Slice", 3, "Test Slice", ""), ("9|s", 9, "s", "one\ntwo — café")]
    halves = c.connections(now)
    assert sorted((r["dim"], r["src"], r["dst"]) for r in documents.mirrored(halves).collect()) == [("d.clone", "241|0.db", "2|Test Slice"), ("d.text", "2|Test Slice", "3|Test Slice")]
    assert [(r["dimensionId"], r["src"]) for r in documents.half_links(halves).collect()] == [("d.clone", "241|0.db")]


def test_a_file_over_several_tasks(spark, tmp_path):
    n = 30_000
    lines = "".join(f"KEY={k}|s\r\nVAL=text {k}\r\n" + (f"KEY={k}|s+d.1\r\nVAL={k + 1}|s\r\n" if k % 3 else "") for k in range(n))
    (tmp_path / "big.zzz").write_bytes(lines.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        raw = spark.read.text(str(tmp_path))
        assert raw.rdd.getNumPartitions() > 5
        rows = c.read_records(spark, str(tmp_path)).filter("problem IS NOT NULL OR value IS NULL")
        assert rows.count() == 0
        now = c.current(c.read_records(spark, str(tmp_path)))
        assert c.cells(now).filter(F.col("text") != F.concat(F.lit("text "), F.col("number"))).count() == 0 and c.cells(now).count() == n
        assert c.connections(now).filter(F.col("poswardId") != F.concat(F.substring_index("cellId", "|", 1).cast("int") + 1, F.lit("|s"))).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_of_a_store_hold_whole_records(spark, tmp_path):
    """The end of a file parts no key from its value."""
    from loomline.operators import journal_text

    n, per = 40, 400
    lines = spark.range(n).select("id", F.posexplode(F.array_repeat(F.lit("x"), per)).alias("k", "x")).select("id", "k", F.when(F.col("k") % 2 == 0, F.concat(F.lit("KEY="), "id", F.lit("|"), "k")).otherwise(F.concat(F.lit("VAL="), "k")).alias("line"))
    journal_text.write_lines(lines.repartition(7), str(tmp_path / "s"), ["id", "k"], files=9, whole=1)
    ends = [(f.read_text().splitlines()[0][:4], f.read_text().splitlines()[-1][:4]) for f in (tmp_path / "s").glob("part-*")]
    assert len(ends) > 5 and set(ends) == {("KEY=", "VAL=")}
    rows = c.read_records(spark, str(tmp_path / "s"))
    assert rows.filter("problem IS NOT NULL").count() == 0 and rows.select("key").distinct().count() == n * per // 2


def test_cell_store_over_many_files(spark, monkeypatch):
    """The query deals its lines over nine files, and all records are read back."""
    from loomline.operators import journal_text
    from loomline.plans import bindings as b

    write = journal_text.write_lines
    monkeypatch.setattr(journal_text, "write_lines", lambda lines, path, order, **kept: write(lines, path, order, files=9, **kept))
    sf = "/root/testdata/sf0.001"
    orders = b.table(spark, sf, "orders")
    linked = orders.count() - orders.select("o_custkey").distinct().count()
    got = b.QUERIES["cell_store"](spark, sf)
    assert (got.filter("text IS NOT NULL").count(), got.filter("dst IS NOT NULL").count()) == (orders.count(), linked)
