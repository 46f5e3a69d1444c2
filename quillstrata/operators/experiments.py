"""Comparisons of corpora by the same questions: judgements by anchors with their audit, runs of all methods, gates.

records: record_id, target_chunk_id, record_type, document, text (what is searched), ticker, report_date, page_start,
page_end, parent_id; queries: query_id, query, status, question_type, ticker, expected_period; judged: query_id, target.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.functions.text import is_page_furniture, normalize_space
from quillstrata.operators import metrics, qrels, reports, retrieval, vectors

METHODS = ("dense", "bm25", "hybrid", "reranked")
POOL = 30


def anchored_queries(specs: DataFrame, records: DataFrame, variant: str) -> tuple[DataFrame, DataFrame]:
    """(queries with judgements, audit). specs: query_id, query, status, anchors and more; records as above.

    Unsupported questions have no judgements, whatever matches; an answerable one without a match fails the query.
    The audit says which records matched, with their pages and a preview.
    """
    asked = specs.where("status <> 'unsupported'").select("query_id", "anchors")
    hits = qrels.anchored_judgements(records.select(F.col("target_chunk_id").alias("target"), "document"), asked)
    shown = hits.join(records.withColumnRenamed("target_chunk_id", "target"), "target")
    match = F.struct(F.length("document").alias("n"), "target", "is_primary", "record_type", "page_start", "page_end", reports.preview(F.col("document"), 900).alias("preview"))
    lists = shown.groupBy("query_id").agg(F.sort_array(F.collect_list(match)).alias("matches"))
    rows = specs.join(lists, "query_id", "left")
    ids = F.coalesce(F.transform("matches", lambda x: x["target"]), F.array().cast("array<string>"))
    sure = F.when((F.col("status") == "answerable") & (F.size(ids) == 0), F.raise_error(F.concat(F.lit("no evidence for "), "query_id")).cast("array<string>")).otherwise(ids)
    first = F.get("matches", F.lit(0))["target"]
    made = rows.select(*(c for c in specs.columns if c != "anchors"), F.lit(variant).alias("source_variant"), sure.alias("relevant_target_chunk_ids"), first.alias("primary_target_chunk_id"))
    audit = rows.select("query_id", F.lit(variant).alias("variant"), "status", "anchors", F.size(ids).alias("matched_count"), first.alias("primary_target_chunk_id"), F.transform("matches", lambda x: x.dropFields("n", "is_primary")).alias("matches"))
    return made, audit


def remapped_queries(queries: DataFrame, mapping: DataFrame, plan: DataFrame) -> DataFrame:
    """queries with new judgements. mapping: query_id, targets array<string>; plan: query_id, entity, from_query, place.

    A query of the plan takes the targets of the queries named, as evidence groups in the order of place; others take their
    own, which go for answerable ones only. Questions and all else stay.
    """
    parts = plan.join(mapping.select(F.col("query_id").alias("from_query"), "targets"), "from_query")
    grouped = parts.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "entity", F.col("targets").alias("target_chunk_ids")))).alias("g"))
    groups = F.transform("g", lambda x: F.struct(x["entity"].alias("entity"), x["target_chunk_ids"].alias("target_chunk_ids")))
    rows = queries.drop("relevant_target_chunk_ids", "primary_target_chunk_id", "required_evidence_groups").join(mapping, "query_id", "left").join(grouped, "query_id", "left")
    none = F.array().cast("array<string>")
    own = F.when(F.col("status") == "answerable", F.coalesce("targets", none)).otherwise(none)
    ids = F.when(F.col("g").isNotNull(), F.flatten("g.target_chunk_ids")).otherwise(own)
    made = rows.withColumns({"relevant_target_chunk_ids": ids, "required_evidence_groups": groups})
    return made.withColumn("primary_target_chunk_id", F.get("relevant_target_chunk_ids", F.lit(0))).drop("targets", "g")


def mapping_violations(queries: DataFrame, mapping: DataFrame, plan: DataFrame, records: DataFrame) -> DataFrame:
    """Rows (rule, key): answerable queries without a mapping, mappings of others, unknown targets, locators without a place.

    records: target_chunk_id, record_type, parent_id, located (whether it has cell coordinates or is a table's schema).
    """
    wanted = queries.where("status = 'answerable'").select("query_id")
    given = mapping.join(plan.select(F.col("from_query").alias("query_id")).distinct(), "query_id", "left_anti").select("query_id").union(mapping.join(queries, "query_id", "left_semi").select("query_id")).union(plan.select("query_id")).distinct()
    rule = lambda df, name, key: df.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))
    cited = mapping.select(F.explode("targets").alias("target_chunk_id")).distinct()
    found = cited.join(records, "target_chunk_id", "left")
    bare = found.where("record_type = 'table_locator'").where(F.col("parent_id").isNull() | ~F.coalesce(F.col("located"), F.lit(False)))
    return rule(wanted.join(given, "query_id", "left_anti"), "no mapping", "query_id").unionByName(rule(given.join(wanted, "query_id", "left_anti"), "mapping of no answerable query", "query_id")).unionByName(rule(found.where("record_type is null"), "unknown target", "target_chunk_id")).unionByName(rule(bare, "locator without a place", "target_chunk_id"))


def same_questions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (rule, key) where two query sets differ in ids or texts."""
    pairs = left.select("query_id", F.col("query").alias("a")).join(right.select("query_id", F.col("query").alias("b")), "query_id", "full_outer")
    return pairs.where(~F.col("a").eqNullSafe(F.col("b"))).select(F.lit("questions differ").alias("rule"), F.col("query_id").cast("string").alias("key"))


def question_violations(queries: DataFrame, targets: DataFrame, answerable: DataFrame | None = None) -> DataFrame:
    """qrel_violations, questions without a type, and answerable ones that are not those expected (query_id)."""
    untyped = queries.where(F.coalesce(F.trim("question_type") == "", F.lit(True))).select(F.lit("no question type").alias("rule"), F.col("query_id").alias("key"))
    found = qrels.qrel_violations(queries, targets).unionByName(untyped)
    if answerable is None:
        return found
    have = queries.where("status = 'answerable'").select("query_id", F.lit(1).alias("a"))
    odd = have.join(answerable.select("query_id", F.lit(1).alias("b")), "query_id", "full_outer").where("a is null or b is null")
    return found.unionByName(odd.select(F.lit("not the expected questions").alias("rule"), F.col("query_id").alias("key")))


@dataclass
class Run:
    """hits: method, query_id, target, rank, parent, ticker and the record's columns; pool: the reranker's candidates, alike.

    seconds: by method, of the whole query set; retrieved and reranked apart.
    """

    hits: DataFrame
    pool: DataFrame
    seconds: dict[str, float]


def retrieved(records: DataFrame, stored: DataFrame, queries: DataFrame, make_scorer: Callable | None = None, limit: int = 10, candidates: int = 30, rrf_k: int = retrieval.RRF_K, batch: int = 4) -> Run:
    """All methods over all queries. stored: doc_id (record_id), embedding; queries: query_id, query, vector.

    Each list is kept, so that later ones build on it and its time is its own. Without a scorer nothing is reranked.
    """
    searched = records.select(F.col("record_id").alias("doc_id"), "text")
    seconds: dict[str, float] = {}

    def kept(name: str, df: DataFrame) -> DataFrame:
        began = time.perf_counter()
        df = df.persist()
        df.count()
        seconds[name] = time.perf_counter() - began
        return df

    dense = kept("dense", retrieval.dense_topk(stored, queries.select("query_id", "vector"), max(limit, candidates)))
    bm25 = kept("bm25", retrieval.bm25_topk(searched, queries.select("query_id", F.col("query").alias("text")), max(limit, candidates)))
    lists = {"dense": dense.where(F.col("rank") <= limit), "bm25": bm25.where(F.col("rank") <= limit), "hybrid": kept("hybrid", retrieval.rrf(dense.where(F.col("rank") <= candidates), bm25.where(F.col("rank") <= candidates), limit, rrf_k))}
    pool = kept("candidates", retrieval.candidate_pool(dense.where(F.col("rank") <= candidates), bm25.where(F.col("rank") <= candidates), most=POOL, k=rrf_k))
    if make_scorer is not None:
        pairs = pool.join(searched, "doc_id").join(queries.select("query_id", "query"), "query_id")
        lists["reranked"] = kept("reranked", retrieval.model_reranked(pairs, make_scorer, limit, batch).drop("rank", "query", "text").withColumnRenamed("new_rank", "rank"))
    hits = None
    for name, df in lists.items():
        one = df.select(F.lit(name).alias("method"), "query_id", "doc_id", "rank")
        hits = one if hits is None else hits.unionByName(one)
    about = records.drop("text").withColumn("target", F.col("target_chunk_id"))
    full = lambda df: df.withColumnRenamed("doc_id", "record_id").join(about, "record_id")
    return Run(full(hits), full(pool), seconds)


def per_query(run: Run, queries: DataFrame, judged: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a method and answerable query with all that run_summary sums up, and family."""
    hits = run.hits.withColumn("parent", F.col("parent_id"))
    n = max(1, queries.count())
    of = {m: run.seconds.get(m, 0.0) / n for m in METHODS}
    took = lambda names: F.coalesce(*(F.when(F.col("method") == m, F.lit(of[m])) for m in names), F.lit(0.0))
    pool = run.pool.withColumn("method", F.lit("reranked"))
    wanted = judged.select("query_id", "target").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("relevant"))
    in_pool = pool.join(wanted, ["query_id", "target"]).groupBy("query_id").agg(F.count_distinct("target").alias("found"))
    parents = reports_parents(pool.where("parent_id is not null").withColumn("parent", F.col("parent_id")), POOL)
    candidate = sizes.join(in_pool, "query_id", "left").join(parents, "query_id", "left").select(F.lit("reranked").alias("method"), "query_id", F.when(F.col("found") > 0, 1).otherwise(0).alias("candidate_hit"), (F.coalesce("found", F.lit(0)) / F.col("relevant")).alias("candidate_recall"), F.coalesce("unique_parents", F.lit(0)).alias("candidate_parents"), F.coalesce("max_siblings", F.lit(0)).alias("candidate_siblings"))
    asked = queries.select("query_id", reports.question_family(F.col("question_type")).alias("family"))
    rows = metrics.ranking_metrics(hits, judged).join(asked, "query_id")
    both = ["method", "query_id"]
    rows = rows.join(metrics.group_metrics(hits, groups), both, "left").join(reports.ticker_accuracy(hits, queries), both, "left").join(metrics.parent_diversity(hits.where("parent is not null")), both, "left").join(candidate, both, "left")
    retrieved_in = F.when(F.col("method") == "reranked", F.lit(run.seconds.get("candidates", 0.0) / n)).otherwise(took(METHODS[:3]))
    return rows.withColumns({"unique_parents": F.coalesce("unique_parents", F.lit(0)), "max_siblings": F.coalesce("max_siblings", F.lit(0)), "retrieval_seconds": retrieved_in, "reranking_seconds": took(METHODS[3:])})


def reports_parents(rows: DataFrame, top: int) -> DataFrame:
    """query_id, unique_parents, max_siblings among the first top rows."""
    return metrics.parent_diversity(rows, top).drop("method")


def minimum_ranks(hits: DataFrame, judged: DataFrame) -> DataFrame:
    """method, query_id, minimum_relevant_rank."""
    return hits.join(judged.select("query_id", "target").distinct(), ["query_id", "target"]).groupBy("method", "query_id").agg(F.min("rank").alias("minimum_relevant_rank"))


def self_contained(records: DataFrame, judged: DataFrame, anchors: DataFrame) -> DataFrame:
    """query_id, self_contained: whether a judged record holds all anchors (in any case) and has pages. anchors: query_id, anchors."""
    plain = lambda x: F.lower(normalize_space(x))
    rows = judged.join(records.select(F.col("target_chunk_id").alias("target"), "document", "page_start", "page_end"), "target").join(anchors, "query_id")
    good = F.forall("anchors", lambda a: F.contains(plain(F.col("document")), plain(a))) & F.coalesce((F.col("page_start") > 0) & (F.col("page_end") > 0), F.lit(False))
    return anchors.select("query_id").join(rows.groupBy("query_id").agg(F.max(good).alias("self_contained")), "query_id", "left").withColumn("self_contained", F.coalesce("self_contained", F.lit(False)))


def variant_rows(run: Run, queries: DataFrame, judged: DataFrame, footer: str | None = None) -> DataFrame:
    """One row a query: status, candidate_count, page_furniture_candidate_count, candidate_hit_at_30 and
    matching_report_period_count_at_10 (the reranked hits of the expected period; null for answerable ones)."""
    found = judged.select("query_id", "target").distinct().withColumn("hit", F.lit(1))
    pool = run.pool.join(found, ["query_id", "target"], "left").groupBy("query_id").agg(F.count("*").alias("candidate_count"), F.count_if(is_page_furniture(F.col("document"), footer)).alias("page_furniture_candidate_count"), F.coalesce(F.max("hit"), F.lit(0)).alias("hit"))
    same = run.hits.where("method = 'reranked'").join(queries.select("query_id", "expected_period"), "query_id").groupBy("query_id").agg(F.count_if(F.col("report_date") == F.col("expected_period")).alias("same"))
    rows = queries.select("query_id", "status").join(pool, "query_id", "left").join(same, "query_id", "left").na.fill(0, ["candidate_count", "page_furniture_candidate_count", "hit", "same"])
    answerable = F.col("status") == "answerable"
    return rows.select("query_id", "status", "candidate_count", "page_furniture_candidate_count", F.when(answerable, F.col("hit")).alias("candidate_hit_at_30"), F.when(~answerable, F.col("same")).alias("matching_report_period_count_at_10"))


def bakeoff_gates(rows: DataFrame, run: Run, judged: DataFrame, records: DataFrame, anchors: DataFrame, most_ranks: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """One row of gates and pass. rows: variant_rows(); most_ranks: query_id -> (method, worst rank that passes)."""
    answerable = F.col("status") == "answerable"
    own = reports.gates(rows, candidate_pool_is_full=~answerable | (F.col("candidate_count") == POOL), all_proofs_enter_the_pool=~answerable | (F.col("candidate_hit_at_30") == 1), unsupported_has_no_matching_period=(F.col("status") != "unsupported") | (F.col("matching_report_period_count_at_10") == 0), no_page_furniture_in_pools=F.col("page_furniture_candidate_count") == 0)
    placed = judged.join(records.select(F.col("target_chunk_id").alias("target"), "page_start", "page_end"), "target", "left")
    more = [own, reports.gates(placed, all_judged_have_pages=(F.col("page_start") > 0) & (F.col("page_end") > 0)), reports.gates(self_contained(records, judged, anchors), judged_are_self_contained=F.col("self_contained"))]
    if most_ranks:
        spark = rows.sparkSession
        bars = spark.createDataFrame([(q, m, r) for q, (m, r) in most_ranks.items()], "query_id string, method string, most int")
        ranks = bars.join(minimum_ranks(run.hits, judged).withColumn("query_id", F.col("query_id").cast("string")), ["query_id", "method"], "left")
        more.append(reports.gates(ranks, ranks_are_not_worse=F.col("minimum_relevant_rank") <= F.col("most")))
    passed: Column = F.lit(True)
    out = None
    for i, g in enumerate(more):
        passed = passed & F.col(f"__qs_{i}")
        one = g.withColumnRenamed("pass", f"__qs_{i}")
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.withColumn("pass", passed).drop(*(f"__qs_{i}" for i in range(len(more))))


def evaluated(records: DataFrame, stored: DataFrame, queries: DataFrame, judged: DataFrame, groups: DataFrame, model: vectors.Model, make_scorer: Callable | None = None, by_family: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(rows a method and query, summary a method, or a method and family) of the answerable questions."""
    posed = queries.where("status = 'answerable'")
    coded = vectors.encoded(posed, "query_id", "query", model.make).withColumnRenamed("embedding", "vector")
    run = retrieved(records, stored, posed.join(coded, "query_id"), make_scorer, **options)
    rows = per_query(run, posed, judged, groups)
    return rows, reports.run_summary(rows, *(("method", "family") if by_family else ("method",)))
