"""What a review found at odd inputs and larger tables."""

import tracemalloc
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstrata import mechanism_queries as M
from quillstrata import queries as Q
from quillstrata.functions.text import token_text
from quillstrata.operators import postings, qrels, records, retrieval
from quillstrata.sources import xbrl


def same_as_sql(spark, name, folder, **tables):
    """The query over these tables (name: rows, schema) gives the rows of its SQL."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    rel = con.sql(Q.oracle_sql()[name])
    df = Q.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    want = sorted(tuple(map(str, (r[rel.columns.index(c)] for c in cols))) for r in rel.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want and want


@pytest.mark.parametrize("text", ["cut off in and&amp", "a &quot;b&quot; &#x27;c&#x27;", "&amp;lt; &lt;x&gt; &nbsp; &#39; &copy &", "plain", "a &amp;amp; b &amp;quot; c &ampx; d"])
def test_page_headings_knows_the_references_of_its_sql(spark, tmp_path, text):
    page = f'<html><head><title>{text}</title></head><body><h1>{text}</h1><ul><li><a href="/x?a=1&amp;b=&quot;">{text}</a></li></ul></body></html>'
    same_as_sql(spark, "page_headings", tmp_path, pages=([(1, "u", page)], "page_id long, url string, html string"))


# Searches


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def _texts(spark, n=400):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("rate"), F.concat(F.lit("w"), F.col("id") % 7), F.repeat(F.concat(F.lit(" v"), F.col("id") % 11), (F.col("id") % 5).cast("int"))).alias("text"), (F.col("id") % 3 == 0).alias("third"))
    asked = spark.range(40).select(F.concat(F.lit("q"), "id").alias("query_id"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 9), F.concat(F.lit("v"), F.col("id") % 13), F.concat(F.lit("v"), F.col("id") % 13), F.lit("rate unheard")).alias("text"))
    return docs.unionByName(spark.createDataFrame([(9_000, None, True), (9_001, "", True)], "doc_id long, text string, third boolean")), asked


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_bm25_of_texts_is_scored_in_its_tasks(spark, monkeypatch, most):
    """No row a posting and query: texts are scored where they are, in groups of queries, with the scores of the join."""
    docs, asked = _texts(spark)
    monkeypatch.setattr(retrieval, "MOST_WEIGHTS", most)
    for where in (None, F.col("third")):
        scores = retrieval.bm25_scores(docs, asked)
        kept = scores if where is None else scores.join(docs.where(where).select("doc_id"), "doc_id", "left_semi")
        got = retrieval.bm25_topk(docs, asked, 7, where)
        assert "Join" not in _plan(got)
        want = retrieval.ranked(kept, 7, "bm25").select(got.columns).collect()
        assert sorted(got.collect()) == sorted(want) and len(want) == 280
    nothing = spark.createDataFrame([("q", "unheard")], "query_id string, text string")
    assert retrieval.bm25_topk(docs, nothing).count() == 0 == retrieval.bm25_topk(docs, nothing.where("false")).count()


def test_dense_task_holds_slices_of_its_scores():
    """20,000 queries over 8,192 rows: what a task holds does not grow with rows times queries."""
    rng = np.random.default_rng(3)
    rows, asked = rng.normal(size=(8_192, 8)), rng.normal(size=(20_000, 8))
    vectors = lambda x: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * 8, x.ravel())
    ran = {}
    pool = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), mapInArrow=lambda run, schema: ran.update(run=run))
    retrieval._scored(pool, pa.table({"query_id": np.arange(20_000), "vector": vectors(asked)}), 8, 5, None)
    batches = [pa.record_batch({"doc_id": pa.array(np.arange(8_192)), "embedding": vectors(rows)})]
    tracemalloc.start()
    out = pa.Table.from_batches(list(ran["run"](iter(batches))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6, peak
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    got = out.to_pandas().groupby("query_id").doc_id.apply(sorted)
    for q in range(0, 20_000, 997):
        assert got[q] == sorted(np.lexsort((np.arange(8_192), -np.round(unit(rows) @ unit(asked[q : q + 1]).T, 6)[:, 0]))[:5])


def test_rows_of_few_hits_are_not_shuffled(spark):
    docs, _ = _texts(spark)
    hits = spark.createDataFrame([("q", 3), ("p", 3), ("p", 500), ("p", None)], "query_id string, doc_id long")
    held = retrieval.of_hits(docs, hits)
    assert [r.doc_id for r in held.collect()] == [3]
    assert "BroadcastHashJoin" in _plan(held) and "SortMergeJoin" not in _plan(held)


def test_texts_that_hold_needles_are_not_shuffled(spark):
    docs, _ = _texts(spark)
    needles = spark.createDataFrame([(1, "rate w3 v3 v3"), (2, "one two three four five six"), (3, "rate w1  v1  v1  v1"), (4, "w6  v")], "k long, needle string")
    found = qrels.containing(docs, "doc_id", "text", needles, "k", "needle")
    assert "SortMergeJoin" not in _plan(found)
    want = sorted((n.k, d.doc_id) for n in needles.collect() for d in docs.collect() if d.text is not None and n.needle in d.text)
    assert sorted((r.k, r.doc_id) for r in found.collect()) == want and want


# Chunks


def test_chunks_of_a_batch_are_made_a_few_documents_at_a_time(monkeypatch):
    """A batch of 10,000 long documents: their chunks leave in pieces, and texts become Python objects in pieces."""
    n, text = 2_000, "word " * 1_500
    units = pa.ListArray.from_arrays(np.arange(0, 2 * n + 1, 2, dtype=np.int32), pa.array([text[:3_750].strip()] * (2 * n)))
    batch = pa.record_batch({"doc_id": pa.array(np.arange(n)), "text": pa.array([text] * n), "units": units})
    ran = {}
    rows = SimpleNamespace(where=lambda _: rows, select=lambda *_: rows, mapInArrow=lambda run, schema: ran.update(run=run), mapInPandas=lambda run, schema: ran.update(run=run))
    monkeypatch.setattr(records, "sentence_units", lambda _: SimpleNamespace(alias=lambda _: None))
    monkeypatch.setattr(records.F, "col", lambda _: None)
    records.token_chunks(rows)
    most = total = 0
    for out in ran["run"](iter([batch])):
        most, total = max(most, len(out)), total + len(out)
    assert total == 2 * n and most <= 256


# Facts


def test_contexts_meet_in_one_aggregate(spark):
    """Nodes are not joined to the values of typed members; those come from the same aggregate."""
    none, dim = {}, {"dimension": "b:Axis"}
    node = lambda n, parent, depth, space, name, above, attributes, text: ("p", n, parent, 1, depth, "x", space, name, above, attributes, text)
    rows = [
        node(1, 0, 1, xbrl.INSTANCE, "context", "xbrl", {"id": "c1"}, ""), node(2, 1, 3, xbrl.DIMENSIONS, "typedMember", "segment", dim, ""), node(3, 2, 4, "urn:b", "val", "typedMember", none, "seven"),
        node(4, 1, 3, xbrl.DIMENSIONS, "explicitMember", "segment", {"dimension": "a:Axis"}, "m"), node(5, 1, 3, xbrl.INSTANCE, "instant", "period", none, "2025-01-02"), node(6, 1, 3, xbrl.DIMENSIONS, "typedMember", "segment", {"dimension": "c:Axis"}, "own"),
    ]
    made = xbrl.contexts(spark.createDataFrame(rows, xbrl.NODES))
    assert "Join" not in _plan(made)
    (row,) = made.collect()
    assert (row.context, str(row.instant), [tuple(d) for d in row.dimensions]) == ("c1", "2025-01-02", [("a:Axis", "m"), ("b:Axis", "seven"), ("c:Axis", "own")])


# Postings


def _odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(["Rate, rate: (rate) 1,234.5% a_b c%d x.e-", "naïve café-x Über.e x² — z", None, "", " \n.,", "a-b\ta.b_ é1 1é 5%é 5%", "word " * 90])]
    more = spark.range(300).select((F.col("id") + 100).alias("doc_id"), F.concat_ws(" ", F.lit("rate"), F.concat(F.lit("w"), F.col("id") % 7), F.repeat(F.lit("v "), (F.col("id") % 5).cast("int"))).alias("text"))
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(more)


def _plain_postings(docs):
    return sorted(map(tuple, retrieval._postings(retrieval.tokenized(docs)).select("token", "doc_id", "tf", "dl").collect()))


@pytest.mark.parametrize("most", [12_000_000, 200])
def test_a_stored_index_is_built_where_its_parts_are(spark, tmp_path, monkeypatch, most):
    """No token is written on its own; pieces of a part hold every posting once, whatever is cut, and all lengths."""
    docs, place = _odd_texts(spark), str(tmp_path / "index")
    monkeypatch.setattr(postings, "PIECE_BYTES", most)
    retrieval.store_index(docs, place, buckets=4)
    assert not (tmp_path / "index" / "tokens").exists()
    index = retrieval.stored_index(spark, place)
    assert sorted(map(tuple, index.postings.select("token", "doc_id", "tf", "dl").collect())) == _plain_postings(docs)
    assert {r.doc_id: r.dl for r in index.doc_len.collect()} == {r.doc_id: r.dl for r in retrieval.lexical_index(docs).doc_len.collect()}
    assert (index.blocks.groupBy("token", "part").count().where("count > 1").count(), index.n) == (0, 307)
    assert index.blocks.select("part").distinct().count() == 1 if most > 200 else index.blocks.select("part").distinct().count() > 1
    asked = spark.createDataFrame([(1, "rate w3 café-x"), (2, "v a-b 1234.5%"), (3, "unheard")], "query_id long, text string")
    want = sorted(map(tuple, retrieval.bm25_topk(docs, asked, 7).collect()))
    assert sorted(map(tuple, retrieval.bm25_topk(index, asked, 7).collect())) == want and want


@pytest.mark.parametrize("most", [12_000_000, 200])
def test_blocks_are_merged_from_pieces(spark, monkeypatch, most):
    """No row a posting: blocks come from pieces counted in the tasks, one a token and part, by doc_id."""
    docs = _odd_texts(spark)
    monkeypatch.setattr(postings, "PIECE_BYTES", most)
    texts = docs.select("doc_id", token_text(F.col("text")).alias("text"))
    made = postings.blocks(texts, lambda tf, dl: tf / (tf + 1), 3)
    assert "Generate" not in _plan(made)
    rows = made.collect()
    assert len({(r.token, r.part) for r in rows}) == len(rows) and {r.part for r in rows} == {0, 1, 2}
    assert all(r.docs == sorted(r.docs) and r.top == max(r.impacts) and r.impacts == [x / (x + 1) for x in r.tfs] for r in rows)
    assert sorted(map(tuple, postings.flat(made).collect())) == _plain_postings(docs)
    assert "Generate" not in _plan(M.posting_blocks(lambda name: docs))
