import os

import pytest

from ledgerline.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    assert set(registry.oracle_sql()) == {"op2_substring_dedup", "op7_exact_dedup", "op9_line_dedup"}
    for name, sql in registry.oracle_sql().items():
        a, b = registry.queries()[name](spark, DATA).toPandas(), con.execute(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
        assert a.equals(b), name
