"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from loomline.plans import bindings as b

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(b.ORACLES))
def test_sql_agrees(spark, duck, name):
    rel = duck.execute(b.ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(map(plain, r)) for r in rel.fetchall()), key=str)
    got = b.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=str) == want


def test_plans(spark):
    """As-of joins are windows over one union, filters reach the scan, and nothing is a cross join."""
    import contextlib
    import io

    for name in ("asof_backward", "asof_backward_clamped", "asof_forward", "link_replay", "trust_score", "mvr_survivors"):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            b.QUERIES[name](spark, SF).explain("formatted")
        assert "CartesianProduct" not in plan.getvalue() and "BroadcastNestedLoopJoin" not in plan.getvalue()
        if name.startswith("asof"):
            assert "Join" not in plan.getvalue() and "EqualTo(event_type" in plan.getvalue()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["event_id", "user_id", "click_id"] and set(e.oracle_sql()) <= set(e.queries())
