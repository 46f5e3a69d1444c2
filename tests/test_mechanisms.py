import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstrata.operators import digests, postings, qrels, quantiles, retrieval


def test_short_needles_against_plain_python(spark):
    texts = [(1, "the loan book, the loans"), (2, "LOAN of a loan"), (3, None), (4, "cash ratio of 10%"), (5, ""), (6, "aaaa")]
    needles = [("n1", "loan"), ("n2", "the loan"), ("n3", "of a"), ("n4", "a"), ("n5", "aa"), ("n6", "nowhere"), ("n7", ""), ("n8", None), ("n9", "loan"), ("n10", "ratio of 10"), ("n11", "loan book, the loans")]
    got = qrels.containing(spark.createDataFrame(texts, "doc_id int, text string"), "doc_id", "text", spark.createDataFrame(needles, "k string, w string"), "k", "w")
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert sorted((r.k, r.doc_id) for r in got.collect()) == sorted((k, d) for k, w in needles for d, t in texts if w is not None and t is not None and w in t)


def test_digests_tell_order(spark):
    rows = spark.range(5000).select(F.col("id").alias("pos"), (F.col("id") * 7 % 13).alias("v"), F.when(F.col("id") % 3 > 0, "x").alias("s"))
    assert digests.same_order(rows, rows.repartition(7), "pos", "v", "s")
    swapped = rows.withColumn("pos", F.when(F.col("pos") == 10, 4000).when(F.col("pos") == 4000, 10).otherwise(F.col("pos")))
    assert not digests.same_order(rows, swapped, "pos", "v", "s")
    assert {(r.block, r.n_left, r.n_right) for r in digests.differing_blocks(rows, swapped.where("pos < 4990"), "pos", "v", "s", block=1000).collect()} == {(0, 1000, 1000), (4, 1000, 990)}
    nulls = rows.withColumn("s", F.coalesce("s", F.lit("null")))
    assert not digests.same_order(rows, nulls, "pos", "s")
    assert digests.order_digest(rows.limit(0), "pos", "v").first().n == 0
    one = digests.order_digest(rows.where("pos < 3"), "pos", "v").first().digest
    whole = [int(x, 16) for x in one.split("-")]
    values = [r[0] for r in rows.where("pos < 3").orderBy("pos").select(F.to_json(F.struct("v"))).collect()]
    hashes = lambda b: [r[0] % digests.PRIME for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string").orderBy("i").select(F.xxhash64(F.lit(b), "x")).collect()]
    assert whole == [sum(h * pow(b, p, digests.PRIME) for p, h in enumerate(hashes(b))) % digests.PRIME for b in digests.BASES]


def test_quantiles_of_hot_groups(spark):
    rng = random.Random(5)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 3.0, 1e9, -1e9])) for _ in range(3000)] + [("same", 2.0)] * 300 + [("one", 1.0), (None, 5.0), (None, 7.0), ("none", None)]
    table = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r.share): r.quantile for r in quantiles.quantiles(table, "g", "x", [0.0, 0.25, 0.5, 0.95, 1.0], bins=16, few=10).collect()}
    for g in ("hot", "same", "one", None):
        own = np.array([x for k, x in rows if k == g])
        for share in (0.0, 0.25, 0.5, 0.95, 1.0):
            assert got[g, share] == pytest.approx(np.quantile(own, share), rel=1e-12)
    assert len(got) == 20
    asked = spark.createDataFrame([("hot", 7), ("hot", 3000), ("none", 0)], "g string, rank long")
    (r,) = quantiles.rank_values(table, "g", "x", asked, bins=16, few=10).collect()
    assert (r.g, r["rank"], r.x) == ("hot", 7, sorted(x for k, x in rows if k == "hot")[7])


def test_parts_leave_out_only_what_cannot_be_best():
    rng = np.random.default_rng(2)
    for _ in range(200):
        tokens = [f"t{i}" for i in range(rng.integers(1, 9))]
        rows, total = [], np.zeros(60)
        terms = [(t, float(rng.exponential())) for t in tokens]
        for t, w in terms:
            docs = np.flatnonzero(rng.random(60) < rng.random())
            impacts = rng.random(len(docs)) * rng.random()
            if len(docs):
                rows.append((t, docs, impacts, float(impacts.max())))
                total[docs] += w * impacts
        if not rows:
            continue
        part = postings.Part(rows)
        bar = float(np.sort(total)[-5])
        places, scores, read = part.above([*terms, ("unknown", 1.0)], bar)
        got = dict(zip(part.docs[places].tolist(), scores.tolist(), strict=True))
        assert all(np.isclose(got[d], total[d]) for d in got) and all(d in got for d in np.flatnonzero(total >= bar) if total[d] > 0)
        assert read <= sum(len(d) for _, d, _, _ in rows)
        assert len(part.above(terms, 1e9)[0]) == 0


def test_bounds_save_postings(spark, tmp_path):
    """Frequent words meet a rare one: the search reads less than all postings and finds the same."""
    words = [(i, " ".join(["the", "of"] + (["of"] if i % 2 else []) + ([f"rare{i % 7}"] * 3 if i % 50 == 0 else []) + [f"w{i}"])) for i in range(4000)]
    docs = spark.createDataFrame(words, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the of rare0"), (2, "rare3 the"), (3, "unknown"), (4, "the")], "query_id long, text string")
    place = str(tmp_path / "index")
    retrieval.store_index(docs, place, buckets=4)
    index = retrieval.stored_index(spark, place)
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(retrieval.bm25_topk(index, asked, 5)) == plain(retrieval.bm25_topk(docs, asked, 5))
    read = {r.query_id: r for r in retrieval.bm25_pruning(index, asked, 5).collect()}
    assert read[1].read < read[1].postings / 2 and read[3].postings == 0


def test_dense_best_is_carried_over_batches(spark):
    rng = np.random.default_rng(8)
    rows = [(f"d{i:04d}", (rng.normal(size=4) if i % 3 else np.array([1.0, 1.0, 0.0, 0.0])).tolist()) for i in range(700)]
    vectors = spark.createDataFrame(rows, "doc_id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0, 0.5])], "query_id int, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = retrieval.dense_topk(vectors, asked, 9).collect()
        kept = retrieval._scored(vectors, asked.toArrow(), 4, 9, retrieval.T.StructType.fromDDL("query_id int, doc_id string, raw double")).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q, v in ((1, [1.0, 1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0, 0.5])):
        cos = sorted((-round(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 6), d) for d, x in rows)[:9]
        assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(d, -s) for s, d in cos]
    assert kept <= 3 * 2 * 9
