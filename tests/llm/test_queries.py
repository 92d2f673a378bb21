"""Every registered SQL against its query, and the queries' columns."""

import duckdb
import pytest

from loomline.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(q.ORACLES[name])
    names = [d[0] for d in rel.description]
    got = q.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_native_queries_run_no_python(spark):
    import contextlib
    import io

    for name in ("op1_chat_format", "op7_decontamination", "op8_url_filter", "op13_sharding"):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            q.QUERIES[name](spark, SF).explain("formatted")
        assert "Python" not in plan.getvalue() and "Arrow" not in plan.getvalue() and "Pandas" not in plan.getvalue()
