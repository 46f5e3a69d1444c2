"""The registered queries of the later modules against their SQL."""

import duckdb
import pytest

from quillstrata import coverage_queries, mechanism_queries
from quillstrata import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in Q.SQL if any(getattr(m, n, None) is not None and getattr(m, n).__module__ == m.__name__ for m in (coverage_queries, mechanism_queries)))


def test_all_are_registered():
    assert len(NAMES) >= 35 and set(NAMES) <= set(Q.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.sql(Q.SQL[name])
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    want = sorted(tuple(map(str, (r[rel.columns.index(c)] for c in cols))) for r in rel.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want
