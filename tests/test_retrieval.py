import duckdb
import pytest
from pyspark.sql import functions as F

from quillstrata import queries as Q
from quillstrata.functions import matrices as M
from quillstrata.functions import text as X
from quillstrata.operators import metrics, records, retrieval

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.sql(Q.SQL[name])
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    want = sorted((tuple(map(str, (r[rel.columns.index(c)] for c in cols))) for r in rel.fetchall()))
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want


def test_fusion_order_and_window_before_limit(spark):
    dense = spark.createDataFrame([(1, 10, 1.0, 1), (1, 20, 0.9, 2)], "query_id long, doc_id long, score double, rank int")
    bm25 = spark.createDataFrame([(1, 20, 3.0, 1), (1, 30, 2.0, 2)], "query_id long, doc_id long, score double, rank int")
    assert [r.doc_id for r in retrieval.rrf(dense, bm25).orderBy("rank").collect()] == [20, 10, 30]
    assert [r.doc_id for r in retrieval.rrf(dense, bm25, 1).collect()] == [20]


def test_metrics(spark):
    hits = spark.createDataFrame([("m", 1, "miss", 1), ("m", 1, "hit", 2), ("m", 1, "hit", 3)], "method string, query_id long, target string, rank int")
    qrels = spark.createDataFrame([(1, "hit"), (1, "other")], "query_id long, target string")
    row = metrics.ranking_metrics(hits, qrels).first()
    assert (row.first_relevant_rank, row.hit_at_1, row.hit_at_3, row.recall_at_3, row.reciprocal_rank_at_10) == (2, 0, 1, 0.5, 0.5)


def test_tokens_and_items(spark):
    row = spark.range(1).select(X.financial_tokens(F.lit("LCR 14.6% of 1,234.5 a-b café")).alias("t"), X.sec_item(F.lit("**Item 7A.** Risk")).alias("i"), X.section_title(F.lit("**Credit risk.** text")).alias("s")).first()
    assert (row.t, row.i, row.s) == (["lcr", "14.6%", "of", "1234.5", "a-b"], "7A", "Credit risk")


def test_tables(spark):
    text = "**Loans**\n\nIn millions\n\n| Portfolio | 2025 | 2024 |\n|---|---|---|\n| Commercial | 125 | 110 |\n| Consumer | 80 | 75 |"
    row = spark.createDataFrame([(text,)], "t string").select(M.markdown_matrices(F.col("t")).alias("m"), "t").select("m", M.table_class(F.col("t"), F.col("m")).alias("c"), M.table_description(F.col("t"), F.col("m")).alias("d")).first()
    assert row.m[0][-1] == ["Consumer", "80", "75"] and row.c == "data_table"
    assert "Columns/periods: Portfolio; 2025; 2024" in row.d and "Significant rows: Commercial; Consumer" in row.d and "125" not in row.d


def test_splitter_keeps_overlap():
    units = [f"w{i} x" for i in range(10)]
    got = records.split_tokens(" ".join(units), units, records.word_tokens, target=4, most=6, overlap=2)
    assert got[0] == "w0 x\n\nw1 x" and got[1].startswith("w1 x\n\nw2 x")
