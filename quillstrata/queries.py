"""Queries over the provided tables for the retrieval and document operators, each with the SQL that gives the same rows.

Records are documents (id doc_id, ticker source, type lang), queries are benchmark passages, vectors are embeddings,
element streams are conversations, feeds are events, and rendered tables come from nation and region.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.functions import matrices as M
from quillstrata.functions import text as X
from quillstrata.operators import corpus, folds, ingest, locators, metrics, qrels, records, reports, retrieval, vectors
from quillstrata.sources import lineage
from quillstrata.sources.files import page_elements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The token rule without lookaround, which DuckDB's regular expressions lack.
_NORM = r"regexp_replace(regexp_replace(translate({0}, '–—', '--'), '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g')"
_TOKENS = (
    r"regexp_extract_all(regexp_replace(regexp_replace(lower(" + _NORM + r"), '[\p{{L}}\p{{N}}_]*(?:[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{N}}])[\p{{L}}\p{{N}}_]*', ' | ', 'g'), '%([a-z0-9_])', ' \1', 'g'), '[a-z0-9]+(?:[._-][a-z0-9]+)*%?')"
)
_BM25 = f"""
d AS (SELECT doc_id, source, {_TOKENS.format("text")} AS t FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM d),
post AS (SELECT doc_id, token, len(any_value(t)) AS dl, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS token FROM d) GROUP BY doc_id, token),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
q AS (SELECT item_id AS query_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS token FROM benchmark) GROUP BY ALL),
bm25_scores AS (
    SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (1.5 * (1 - 0.75 + 0.75 * dl / avgdl) + tf)), 6) AS score
    FROM q JOIN post USING (token) JOIN df USING (token), stats GROUP BY ALL
)"""
_DENSE = """
dense_scores AS (
    SELECT b.item_id AS query_id, e.vec_id AS doc_id, round(list_dot_product(e.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS score
    FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id, embeddings e
)"""


def _top(scores: str, limit: int, where: str = "TRUE") -> str:
    return f"SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {scores} WHERE {where}) WHERE rank <= {limit}"


_HYBRID = f"""{_BM25}, {_DENSE},
b30 AS ({_top("bm25_scores", 30)}), d30 AS ({_top("dense_scores", 30)}),
fused AS (
    SELECT query_id, doc_id, d30.rank AS dense_rank, b30.rank AS bm25_rank,
        round(coalesce(1.0::DOUBLE / (60 + d30.rank), 0) + coalesce(1.0::DOUBLE / (60 + b30.rank), 0), 9) AS rrf_score
    FROM d30 FULL JOIN b30 USING (query_id, doc_id)
),
hybrid AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, least(dense_rank, bm25_rank), doc_id::VARCHAR)::INT AS rank FROM fused) WHERE rank <= 10
)"""
_QRELS = "qrels AS (SELECT item_id AS query_id, doc_id AS target FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_HITS = "hits AS (SELECT 'bm25' AS method, query_id, doc_id AS target, rank FROM b30 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM d30 UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM hybrid)"
_METRICS = f"""{_HYBRID}, {_QRELS}, {_HITS},
sizes AS (SELECT query_id, count(DISTINCT target) AS relevant_count FROM qrels GROUP BY ALL),
asked AS (SELECT DISTINCT method, query_id FROM hits),
found AS (SELECT method, query_id, rank FROM hits JOIN qrels USING (query_id, target)),
best AS (SELECT method, query_id, min(rank) AS first_relevant_rank, {", ".join(f"count(*) FILTER (rank <= {k}) AS n{k}" for k in metrics.CUTS)} FROM found GROUP BY ALL),
measured AS (
    SELECT method, query_id, relevant_count, first_relevant_rank, {", ".join(f"(coalesce(n{k}, 0) > 0)::INT AS hit_at_{k}, coalesce(n{k}, 0) / relevant_count AS recall_at_{k}" for k in metrics.CUTS)},
        CASE WHEN first_relevant_rank <= 10 THEN 1.0::DOUBLE / first_relevant_rank ELSE 0.0 END AS reciprocal_rank_at_10
    FROM asked JOIN sizes USING (query_id) LEFT JOIN best USING (method, query_id)
)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _asked(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _asked_vectors(t) -> DataFrame:
    return _asked(t).join(_vectors(t).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


def _plain(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "doc_id", "score", "rank")


@query(f"WITH {_BM25} {_top('bm25_scores', 10)}")
def bm25_topk(t):
    return _plain(retrieval.bm25_topk(t("documents"), _asked(t)))


@query(f"WITH {_BM25}, s AS (SELECT bm25_scores.* FROM bm25_scores JOIN documents USING (doc_id) WHERE lang = 'en') {_top('s', 10)}")
def bm25_filtered_global_stats(t):
    return _plain(retrieval.bm25_topk(t("documents"), _asked(t), where=F.col("lang") == "en"))


@query(f"WITH {_DENSE} {_top('dense_scores', 10)}")
def dense_topk(t):
    return _plain(retrieval.dense_topk(_vectors(t), _asked_vectors(t).select("query_id", "vector")))


@query(f"WITH {_DENSE}, s AS (SELECT dense_scores.* FROM dense_scores JOIN embeddings ON vec_id = doc_id WHERE label = 3) {_top('s', 10)}")
def dense_filtered(t):
    return _plain(retrieval.dense_topk(_vectors(t), _asked_vectors(t).select("query_id", "vector"), where=F.col("label") == 3))


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, dense_rank, bm25_rank, rrf_score, rank FROM hybrid")
def hybrid_topk(t):
    return retrieval.hybrid_topk(t("documents"), _vectors(t), _asked_vectors(t)).select("query_id", "doc_id", "dense_rank", "bm25_rank", "rrf_score", "rank")


@query(f"WITH {_BM25}, h AS ({_top('bm25_scores', 10)}) SELECT query_id, doc_id, rank, sha256(CASE WHEN quality = 1 THEN 'full ' || text ELSE text END) AS evidence_sha256 FROM h JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)")
def hydrate_results(t):
    docs = t("documents")
    found = lineage.cut(retrieval.bm25_topk(docs, _asked(t)))
    own = lineage.cut(retrieval.of_hits(docs, found).select("doc_id", F.col("text").alias("document")))
    full = own.join(retrieval.of_hits(t("labels").where("quality = 1"), found), "doc_id").select("doc_id", F.concat(F.lit("full "), F.col("document")).alias("document"))
    hits = found.join(own, "doc_id")
    return retrieval.hydrate(hits, full).select("query_id", "doc_id", "rank", F.sha2("evidence", 256).alias("evidence_sha256"))


@query(f"WITH {_BM25}, h AS ({_top('bm25_scores', 30)}) SELECT query_id, doc_id, new_rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, rank)::INT AS new_rank FROM h JOIN documents USING (doc_id)) WHERE new_rank <= 10")
def reranked_topk(t):
    found = lineage.cut(retrieval.bm25_topk(t("documents"), _asked(t), 30))
    hits = found.join(retrieval.of_hits(t("documents").select("doc_id", "n_chars"), found), "doc_id")
    return retrieval.rerank(hits, F.col("n_chars")).select("query_id", "doc_id", "new_rank")


@query(f"SELECT doc_id, len({_TOKENS.format('text')})::BIGINT AS dl FROM documents")
def doc_len(t):
    return retrieval.lexical_index(t("documents")).doc_len


@query(f"SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY token")
def term_df(t):
    return retrieval.lexical_index(t("documents")).term_df


@query(f"SELECT count(*) AS n, round(avg(len({_TOKENS.format('text')})), 6) AS avgdl FROM documents")
def token_stats(t):
    return retrieval.lexical_index(t("documents")).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT doc_id, sha256({_NORM.format('text')}) AS normal_sha256 FROM documents")
def lexical_normalize(t):
    return t("documents").select("doc_id", F.sha2(X.normalize_lexical(F.col("text")), 256).alias("normal_sha256"))


@query(f"SELECT doc_id, sha256(array_to_string({_TOKENS.format('text')}, ' ')) AS tokens_sha256 FROM documents")
def financial_tokens(t):
    return t("documents").select("doc_id", F.sha2(F.array_join(X.financial_tokens(F.col("text")), " "), 256).alias("tokens_sha256"))


@query("SELECT doc_id, sha256('Bank: ' || source || chr(10) || 'Entity: ' || source || chr(10) || 'Report: 2025 10-K' || chr(10) || 'Evidence type: ' || lang || chr(10) || 'Internal pages: 1-2' || chr(10) || 'Section: ' || lang || chr(10) || chr(10) || text) AS embedding_sha256 FROM documents")
def embedding_text(t):
    made = X.embedding_text(F.col("source"), F.lit(None).cast("string"), F.lit("2025-12-31"), F.col("lang"), F.lit(1), F.lit(2), F.col("text"), F.col("lang"))
    return t("documents").select("doc_id", F.sha2(made, 256).alias("embedding_sha256"))


@query("SELECT doc_id, sha256(concat_ws(chr(0), source, 'structure_aware', 'narrative:0:0', lang || ',' || source, text)) AS chunk_id FROM documents")
def chunk_ids(t):
    return t("documents").select("doc_id", X.chunk_id(F.col("source"), "structure_aware", F.lit("narrative:0:0"), F.array("lang", "source"), F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good ' || doc_id END, lang) AS retrieval_text FROM documents LEFT JOIN labels USING (doc_id)")
def retrieval_text_coalesce(t):
    rows = t("documents").join(t("labels"), "doc_id", "left")
    return rows.select("doc_id", X.first_text(F.when(F.col("quality") == 1, F.concat(F.lit(" good "), F.col("doc_id"))), F.lit("  "), F.col("lang")).alias("retrieval_text"))


@query(
    r"""WITH made AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' ' || (doc_id % 10000) || chr(10) WHEN 1 THEN 'Table  of Contents ' || text WHEN 2 THEN '**Form 10-K Index** ' || text WHEN 3 THEN '  ' ELSE text END AS text FROM documents),
    n AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM made)
    SELECT doc_id, x = '' OR starts_with(lower(x), 'table of contents') OR starts_with(lower(x), '**table of contents**') OR starts_with(lower(x), 'form 10-k index') OR starts_with(lower(x), '**form 10-k index**') AS navigation, x = '' OR regexp_full_match(x, '\d{1,4}') AS furniture FROM n"""
)
def navigation_furniture_flags(t):
    """Whole texts; two in three of them begin as navigation or are nothing but a page number or blank."""
    k = F.col("doc_id") % 6
    made = F.when(k == 0, F.concat(F.lit(" "), F.col("doc_id") % 10000, F.lit("\n"))).when(k == 1, F.concat(F.lit("Table  of Contents "), "text")).when(k == 2, F.concat(F.lit("**Form 10-K Index** "), "text")).when(k == 3, "  ").otherwise(F.col("text"))
    return t("documents").select("doc_id", X.is_navigation(made).alias("navigation"), X.is_page_furniture(made).alias("furniture"))


@query(r"SELECT conv_id, turn, nullif(upper(regexp_extract('Item ' || turn || 'a. ' || text, '^(?:\*\*|__)?\s*item\s+(\d{1,2}[a-c]?)\s*[.:]', 1, 'i')), '') AS item, regexp_replace('Head ' || role, '[.:]+$', '') AS title FROM conversations")
def sec_item_and_title(t):
    rows = t("conversations").select("conv_id", "turn", F.concat(F.lit("Item "), F.col("turn"), F.lit("a. "), F.col("text")).alias("a"), F.concat(F.lit("**Head "), F.col("role"), F.lit(".**\n\n"), F.col("text")).alias("b"))
    return rows.select("conv_id", "turn", X.sec_item(F.col("a")).alias("item"), X.section_title(F.col("b")).alias("title"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def section_forward_fill(t):
    rows = t("conversations")
    return rows.select("conv_id", "turn", records.forward_filled(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn"))).alias("section"))


@query("SELECT conv_id, island, min(turn) AS first, max(turn) AS last FROM (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (SELECT *, (lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role)::INT AS c FROM conversations)) GROUP BY ALL")
def text_run_islands(t):
    return records.islands(t("conversations"), "conv_id", "turn", "role").groupBy("conv_id", "island").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text)) AS text_sha256 FROM conversations GROUP BY conv_id")
def ordered_concat(t):
    rows = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return rows.select("conv_id", F.sha2(F.array_join("x.text", "\n\n"), 256).alias("text_sha256"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def latest_per_key(t):
    return records.latest_per_key(t("events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT c_custkey, 'new' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey % 3 <> 0")
def upsert_last_writer(t):
    c = t("customer").select("c_custkey")
    return records.upsert(c.withColumn("origin", F.lit("old")), c.where("c_custkey % 3 = 0").withColumn("origin", F.lit("new")), "c_custkey")


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS place, event_id, event_type FROM events")
def parallel_arrays_to_rows(t):
    feed = t("events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("x")).select("user_id", F.col("x.event_id").alias("event_id"), F.col("x.event_type").alias("event_type"))
    return records.rows_of_arrays(feed, "event_id", "event_type")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def first_occurrence_dedup(t):
    return t("documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("text")


@query("SELECT sha256(text) AS text_sha256, count(*) AS count FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_ids(t):
    return records.duplicate_keys(t("documents").select(F.sha2("text", 256).alias("text_sha256")), "text_sha256")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def missing_fk(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT rule, count(*) AS n FROM (SELECT 'not one description' AS rule FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL UNION ALL SELECT 'too many tokens' FROM labels l JOIN documents d USING (doc_id) WHERE n_chars > 2048) GROUP BY ALL")
def corpus_checks(t):
    docs, labels = t("documents"), t("labels")
    chunk = labels.join(docs, "doc_id").select(F.col("doc_id").alias("record_id"), F.lit("table").alias("record_type"), F.col("text").alias("document"), F.col("doc_id").alias("table_id"), F.col("n_chars").alias("tokens"))
    return records.corpus_violations(chunk, docs.select(F.col("doc_id").alias("table_id"), F.lit(True).alias("eligible"))).groupBy("rule").agg(F.count("*").alias("n"))


def _qrels(t) -> DataFrame:
    return qrels.passage_judgements(t("documents"), t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")))


@query(f"WITH {_QRELS} SELECT query_id, target FROM qrels")
def qrels_build(t):
    return _qrels(t)


def _hits(t) -> DataFrame:
    docs, asked, vectors = t("documents"), _asked_vectors(t), _vectors(t)
    # The lists are read for themselves and for their fusion.
    dense, bm25 = (lineage.cut(x) for x in (retrieval.dense_topk(vectors, asked.select("query_id", "vector"), 30), retrieval.bm25_topk(docs, asked.select("query_id", "text"), 30)))
    name = lambda df, m: df.select(F.lit(m).alias("method"), "query_id", F.col("doc_id").alias("target"), "rank")
    return name(bm25, "bm25").union(name(dense, "dense")).union(name(retrieval.rrf(dense, bm25), "hybrid"))


@query(f"WITH {_METRICS} SELECT * FROM measured")
def ranking_metrics(t):
    return metrics.ranking_metrics(_hits(t), _qrels(t))


@query(f"WITH {_METRICS} SELECT method, count(*) AS query_count, {', '.join(f'round(avg(hit_at_{k}), 9) AS hit_at_{k}, round(avg(recall_at_{k}), 9) AS recall_at_{k}' for k in metrics.CUTS)}, round(avg(reciprocal_rank_at_10), 9) AS mrr_at_10 FROM measured GROUP BY method")
def method_summary(t):
    return metrics.summary(metrics.ranking_metrics(_hits(t), _qrels(t)))


@query(f"WITH {_METRICS} SELECT method, query_id % 3 AS family, count(*) AS query_count, round(avg(hit_at_10), 9) AS hit_at_10, round(avg(reciprocal_rank_at_10), 9) AS mrr_at_10 FROM measured GROUP BY GROUPING SETS ((method), (method, query_id % 3))")
def report_grouping_sets(t):
    return metrics.grouped_report(metrics.ranking_metrics(_hits(t), _qrels(t)).withColumn("family", F.col("query_id") % 3), "family")


_GROUPED = f"""{_HYBRID}, {_QRELS}, {_HITS}, g AS (SELECT DISTINCT query_id, source AS entity, target FROM qrels JOIN documents ON doc_id = target),
b AS (SELECT method, query_id, entity, min(rank) AS rank FROM hits JOIN g USING (query_id, target) GROUP BY ALL),
r AS (SELECT * FROM (SELECT DISTINCT method, query_id FROM hits) JOIN (SELECT DISTINCT query_id, entity FROM g) USING (query_id) LEFT JOIN b USING (method, query_id, entity))"""


@query(f"WITH {_GROUPED} SELECT method, query_id, {', '.join(f'round(avg(coalesce((rank <= {k})::INT, 0)), 9) AS group_recall_at_{k}, min(coalesce((rank <= {k})::INT, 0)) AS complete_group_hit_at_{k}' for k in metrics.CUTS)} FROM r GROUP BY ALL")
def group_metrics(t):
    found = lineage.cut(_qrels(t))
    groups = found.join(retrieval.of_hits(t("documents").select(F.col("doc_id").alias("target"), F.col("source").alias("entity")), found, "target"), "target")
    out = metrics.group_metrics(_hits(t), groups)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.startswith("group_recall")})


@query(f"WITH {_BM25}, h AS ({_top('bm25_scores', 10)}), c AS (SELECT query_id, source, count(*) AS n FROM h JOIN documents USING (doc_id) GROUP BY ALL) SELECT 'bm25' AS method, query_id, count(*) AS unique_parents, max(n) AS max_siblings FROM c GROUP BY query_id")
def parent_diversity(t):
    found = lineage.cut(retrieval.bm25_topk(t("documents"), _asked(t)))
    hits = found.join(retrieval.of_hits(t("documents").select("doc_id", F.col("source").alias("parent")), found), "doc_id")
    return metrics.parent_diversity(hits)


@query("SELECT source, count(*) AS total, count(*) FILTER (lang = 'en') AS english, max(n_chars) AS longest FROM documents GROUP BY source")
def corpus_summary(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("english"), F.max("n_chars").alias("longest"))


@query("SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source")
def type_crosstab(t):
    return reports.crosstab(t("documents"), "source", "lang", ["de", "en", "es", "fr"])


@query("WITH n AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY source) AS c FROM documents), p AS (SELECT source, n_chars AS tokens_p95 FROM n WHERE i = greatest(0, floor(0.95 * c)::INT - 1) + 1) SELECT source, count(*) AS chunks, min(n_chars) AS tokens_min, round(avg(n_chars), 9) AS tokens_mean, max(n_chars) AS tokens_max, any_value(tokens_p95) AS tokens_p95 FROM documents JOIN p USING (source) GROUP BY source")
def token_p95(t):
    return reports.token_stats(t("documents"), "source", "n_chars")


@query("SELECT count(*) AS n, count(vec_id) - count(DISTINCT vec_id) AS repeated, count(DISTINCT len(embedding)) AS widths, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS not_finite, count(*) FILTER (abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-5) AS not_unit FROM embeddings")
def archive_integrity(t):
    return records.archive_report(t("embeddings"))


@query("SELECT doc_id, CASE WHEN vec_id IS NULL THEN 0 ELSE len(embedding) END::INT AS width FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def vector_reuse(t):
    empty = lambda missing: missing.select("doc_id", F.array().cast("array<float>").alias("embedding"))
    return records.reuse_vectors(t("documents").select("doc_id"), _vectors(t).drop("label"), empty).select("doc_id", F.size("embedding").alias("width"))


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')")
def ticker_filter_multi(t):
    return ingest.chosen(t("documents").withColumn("ticker", F.col("source")), "SRC1,src2").select("doc_id")


@query("SELECT o_custkey AS c_custkey, 'order' AS origin FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL (SELECT c_custkey, 'idle' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))")
def set_difference_union(t):
    ordered = t("orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return ordered.withColumn("origin", F.lit("order")).unionByName(t("customer").join(ordered, "c_custkey", "left_anti").select("c_custkey", F.lit("idle").alias("origin")))


def _rendered(t) -> DataFrame:
    """One markdown table a region."""
    row = F.concat(F.lit("| "), F.col("n_name"), F.lit(" | "), (F.col("n_nationkey") + 100).cast("string"), F.lit(" |"))
    body = t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("body"))
    return body.select("n_regionkey", F.concat(F.lit("**Balances**\n\nIn millions\n\n| Nation | 2025 |\n|---|---|\n"), F.col("body")).alias("text"))


@query("SELECT n_regionkey, 'data_table' AS class, 'Introduction: Balances In millions' || chr(10) || 'Columns/periods: Nation; 2025' || chr(10) || 'Units: millions' || chr(10) || 'Significant rows: ' || string_agg(n_name, '; ' ORDER BY '| ' || n_name || ' | ' || (n_nationkey + 100)) AS description, count(*) + 1 AS matrix_rows FROM nation GROUP BY n_regionkey")
def table_description(t):
    rows = _rendered(t).withColumn("m", M.markdown_matrices(F.col("text")))
    return rows.select("n_regionkey", M.table_class(F.col("text"), F.col("m")).alias("class"), M.table_description(F.col("text"), F.col("m")).alias("description"), F.size(F.col("m")[0]).cast("long").alias("matrix_rows"))


@query(
    r"""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS p FROM documents),
    s AS (SELECT doc_id, len(list_filter(string_split(regexp_replace(p, '([.!?])\s+([A-Z0-9*(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '')) AS n FROM p)
    SELECT doc_id, coalesce(sum(n), 0)::INT AS units FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id"""
)
def sentence_units(t):
    return t("documents").select("doc_id", F.size(X.sentence_units(F.col("text"))).alias("units"))


@query()
def token_limit_chunks(t):
    return records.token_chunks(t("documents"))


def _fold_sql(text: str, is_table: str, after: str) -> str:
    """Narrative runs of conversations by recursion: a row a turn; after: what ends a run behind the turn."""
    return rf"""e AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, trim({text}) AS content, {is_table} AS is_table, {after} AS ends FROM conversations),
    w AS (SELECT *, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS w, regexp_matches(content, '^\s*(?:\*\*|__)[^*\n]{{1,160}}(?:\*\*|__)') AND length(string_split(content, chr(10) || chr(10))[1]) <= 180 AS head FROM e),
    f AS (
        SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS o, 0::BIGINT AS next, NULL::BIGINT AS run FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT f.conv_id, w.i,
            CASE WHEN w.is_table OR w.ends THEN 0 WHEN (CASE WHEN f.o > 0 AND (w.head OR f.o + w.w > 1024) THEN 0 ELSE f.o END) + w.w >= 512 THEN 0 ELSE (CASE WHEN f.o > 0 AND (w.head OR f.o + w.w > 1024) THEN 0 ELSE f.o END) + w.w END,
            CASE WHEN w.is_table THEN f.next + (f.o > 0)::INT ELSE f.next + (f.o > 0 AND (w.head OR f.o + w.w > 1024))::INT + (w.ends OR (CASE WHEN f.o > 0 AND (w.head OR f.o + w.w > 1024) THEN 0 ELSE f.o END) + w.w >= 512)::INT END,
            CASE WHEN NOT w.is_table THEN f.next + (f.o > 0 AND (w.head OR f.o + w.w > 1024))::INT END
        FROM f JOIN w ON w.conv_id = f.conv_id AND w.i = f.i + 1
    )"""


_HEADED = "CASE WHEN turn % 4 = 3 THEN '**Head**' || chr(10) || chr(10) ELSE '' END || text"


@query(f"WITH RECURSIVE {_fold_sql(_HEADED, 'role = ' + chr(39) + 'system' + chr(39), 'false')} SELECT conv_id AS doc, run::INT AS narrative, min(turn) AS first, max(turn) AS last, sha256(string_agg(content, chr(10) || chr(10) ORDER BY turn)) AS content_sha256 FROM f JOIN w USING (conv_id, i) WHERE run IS NOT NULL GROUP BY conv_id, run")
def narrative_fold(t):
    text = F.concat(F.when(F.col("turn") % 4 == 3, "**Head**\n\n").otherwise(""), "text")
    made = folds.narrative_fold(t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("place"), F.when(F.col("role") == "system", "table").otherwise("text").alias("kind"), text.alias("content")))
    return made.select("doc", "narrative", "first", "last", F.sha2("content", 256).alias("content_sha256"))


@query()
def page_elements_query(t):
    return page_elements(t("pages"))


@query(
    f"""WITH {_QRELS}, r AS (SELECT query_id, list(target::VARCHAR) AS ids FROM qrels GROUP BY query_id),
    q AS (SELECT item_id, coalesce(ids, []) AS ids FROM benchmark LEFT JOIN r ON query_id = item_id)
    SELECT 'answerable without judgements' AS rule, item_id::VARCHAR AS key FROM q WHERE len(ids) = 0 AND item_id % 5 <> 0
    UNION ALL SELECT 'primary target outside judgements', item_id::VARCHAR FROM q WHERE item_id % 7 = 0
    UNION ALL SELECT DISTINCT 'unknown target', '-1' FROM q WHERE item_id % 5 = 0
    UNION ALL SELECT 'group outside judgements', item_id::VARCHAR FROM q WHERE item_id % 3 = 0"""
)
def qrel_checks(t):
    found = _qrels(t).groupBy("query_id").agg(F.collect_list(F.col("target").cast("string")).alias("ids"))
    asked, ids = _asked(t).join(found, "query_id", "left"), F.coalesce("ids", F.array().cast("array<string>"))
    group = F.array(F.struct(F.lit("e").alias("entity"), F.array(F.lit("0")).alias("target_chunk_ids")))
    rows = asked.select(
        F.col("query_id").cast("string").alias("query_id"), F.lit("words").alias("query"), F.lit("answerable").alias("status"), F.when(F.col("query_id") % 5 == 0, F.array_append(ids, F.lit("-1"))).otherwise(ids).alias("relevant_target_chunk_ids"),
        F.when(F.col("query_id") % 7 == 0, "-2").alias("primary_target_chunk_id"), F.when(F.col("query_id") % 3 == 0, group).alias("required_evidence_groups"),
    )
    # 0 stands for a document that no passage is judged for.
    known = t("documents").select(F.col("doc_id").cast("string").alias("target_chunk_id")).union(t("documents").sparkSession.sql("SELECT '0'"))
    return qrels.qrel_violations(rows, known)


@query(
    rf"""WITH e AS (SELECT conv_id, turn, role, trim(regexp_replace(CASE WHEN turn % 2 = 0 THEN 'The following ' ELSE '' END || text, '\s+', ' ', 'g')) AS x FROM conversations),
    l AS (SELECT *, {", ".join(f"lag(role, {i}) OVER w AS r{i}, lag(x, {i}) OVER w AS x{i}" for i in (1, 2, 3))} FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    s AS (SELECT *, {", ".join(f"coalesce(r{i} = 'user' AND len(x{i}) <= 400 AND regexp_matches(x{i}, '{locators.TABLE_INTRO[4:]}', 'i'), false) AS s{i}" for i in (1, 2, 3))} FROM l WHERE role = 'assistant')
    SELECT conv_id AS doc, turn AS place, CASE WHEN r1 = 'assistant' THEN NULL WHEN s1 THEN x1 WHEN r2 = 'assistant' THEN NULL WHEN s2 THEN x2 WHEN r3 = 'assistant' THEN NULL WHEN s3 THEN x3 END AS introduction FROM s"""
)
def intro_lookup(t):
    kind = F.when(F.col("role") == "assistant", "table").when(F.col("role") == "user", "paragraph").otherwise("heading")
    text = F.concat(F.when(F.col("turn") % 2 == 0, "The following ").otherwise(""), "text")
    return locators.introductions(t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("place"), kind.alias("kind"), text.alias("text"), F.lit("1").alias("item"), F.lit("s").alias("section"), F.lit(False).alias("navigation")))


@query("SELECT doc_id, 'lead ' || lang || '|**A' || doc_id || '** def ' || source || '|**B:** end' AS parts FROM documents")
def glossary_entries(t):
    made = F.concat(F.lit("**Glossary of Terms and Acronyms** lead "), F.col("lang"), F.lit(" **A"), F.col("doc_id"), F.lit("** def "), F.col("source"), F.lit(" **B:** end"))
    return t("documents").select("doc_id", F.array_join(corpus.glossary_parts(made), "|").alias("parts"))


_LINES = "SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY '| ' || n_name || ' | ' || (n_nationkey + 100) || ' |')::INT AS row FROM nation"


@query(f"SELECT n_regionkey::VARCHAR AS table_id, row, 0 AS part, 'row' AS scope, concat_ws(chr(10), 'Bank: B', 'Entity: Bank', 'Report date: 2025', 'Table: Balances', 'Unit: millions', 'Measure or row: Nation > ' || n_name, 'Column context: 2025: ' || (n_nationkey + 100)) AS document FROM ({_LINES})")
def data_locators(t):
    rows = _rendered(t).withColumn("cell_matrices", M.markdown_matrices(F.col("text")))
    head = locators.locator_head(F.lit("B"), F.lit("Bank"), F.lit("2025"), F.lit(None).cast("string"), F.lit("Balances"), X.table_unit(F.col("text")))
    return locators.table_locators(rows.select(F.col("n_regionkey").cast("string").alias("table_id"), M.table_class(F.col("text"), F.col("cell_matrices")).alias("table_type"), "cell_matrices", head.alias("head"))).select("table_id", "row", "part", "scope", "document")


@query(f"SELECT n_regionkey, 'Bank: B' || chr(10) || 'Report: 2025 10-K' || chr(10) || 'Columns: Nation; 2025' || chr(10) || 'Rows: ' || string_agg(n_name, '; ' ORDER BY row) || chr(10) || 'Units: in millions' AS proxy FROM ({_LINES}) GROUP BY n_regionkey")
def table_proxies(t):
    body, header = F.regexp_replace("text", r"(?s)^.*?\n\|---\|---\|\n", ""), F.lit("| Nation | 2025 |")
    none = F.lit(None).cast("string")
    made = locators.proxy_text(F.lit("B"), F.lit("2025-12-31"), none, none, none, locators.proxy_columns(header), locators.proxy_rows(body, header), locators.proxy_units(F.col("text")))
    return _rendered(t).select("n_regionkey", made.alias("proxy"))


@query(f"SELECT n_regionkey, 'Nation; 2025' AS columns, string_agg(n_name, '; ' ORDER BY row) AS rows FROM ({_LINES}) GROUP BY n_regionkey")
def column_paths_row_labels(t):
    m = M.markdown_matrices(F.col("text"))
    return _rendered(t).select("n_regionkey", F.array_join(M.column_labels(m), "; ").alias("columns"), F.array_join(M.row_labels(m), "; ").alias("rows"))


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey) AS i FROM orders WHERE o_orderstatus = 'F')
    SELECT o_custkey::VARCHAR AS cik, o_orderkey::VARCHAR AS accession_number, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || o_orderkey || '/d.htm' AS source_url FROM n WHERE i = 1"""
)
def latest_filings(t):
    entry = F.struct("o_orderkey", F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-K/A").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    lists = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(entry)).alias("x"), F.max(F.col("o_orderstatus") == "F").alias("has")).where("has")
    recent = F.struct(F.col("x.form").alias("form"), F.transform("x.o_orderkey", lambda k: k.cast("string")).alias("accessionNumber"), F.col("x.day").alias("filingDate"), F.col("x.day").alias("reportDate"), F.transform("x", lambda _: F.lit("d.htm")).alias("primaryDocument"))
    feeds = lists.select(F.col("o_custkey").cast("string").alias("cik"), F.lit("t").alias("ticker"), F.lit("n").alias("legal_name"), F.array(F.lit("T")).alias("tickers"), recent.alias("recent"))
    return ingest.latest_filings(feeds).select("cik", "accession_number", "source_url")


@query("SELECT doc_id, 3 AS width, true AS of_length_one FROM documents")
def encoded_vectors(t):
    def make():
        import numpy as np

        return lambda texts: np.array([[len(x), x.count(" "), 1.0] for x in texts])

    made = vectors.encoded(t("documents"), "doc_id", "text", make, most=10**9)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return made.select("doc_id", F.size("embedding").alias("width"), (F.abs(norm - 1) < 1e-5).alias("of_length_one"))


def _corpus(t) -> tuple[DataFrame, DataFrame]:
    """Conversations as filings: a page a turn, with what is said, and a small table after each system turn."""
    element = lambda name, kind, content: F.struct(name.alias("id"), F.lit(kind).alias("kind"), content.alias("content"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), F.array(F.col("role")).alias("tags"))
    said, table = element(F.concat(F.lit("e"), F.col("turn")), "text", F.col("text")), element(F.concat(F.lit("t"), F.col("turn")), "table", F.concat(F.lit("In millions\n\n| Item | 2025 |\n|---|---|\n| Turn | "), F.col("turn") + 10, F.lit(" |")))
    pages = t("conversations").select(F.concat(F.lit("a-"), F.col("conv_id")).alias("accession_number"), F.col("turn").cast("int").alias("number"), F.lit(None).cast("int").alias("display_page"), F.col("text").alias("content"), F.when(F.col("role") == "system", F.array(said, table)).otherwise(F.array(said)).alias("elements"))
    blank = [F.lit("x").alias(c) for c in (*corpus.FILING, "legal_name") if c != "accession_number"]
    return corpus.build_corpus(pages.select("accession_number").distinct().select("accession_number", *blank), pages)


@query(
    f"""WITH RECURSIVE {_fold_sql('text', 'false', "role = 'system'")},
    r AS (SELECT 'a-' || conv_id AS a, run, min(turn)::INT AS page_start, max(turn)::INT AS page_end, string_agg('e' || turn, ',' ORDER BY turn) AS ids, string_agg(content, chr(10) || chr(10) ORDER BY turn) AS document FROM f JOIN w USING (conv_id, i) GROUP BY ALL),
    t AS (SELECT 'a-' || conv_id AS a, turn::INT AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 + count(*) FILTER (role = 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS place, role, 'In millions' || chr(10) || chr(10) || '| Item | 2025 |' || chr(10) || '|---|---|' || chr(10) || '| Turn | ' || (turn + 10) || ' |' AS content FROM conversations)
    SELECT 'structure_aware::' || sha256(concat_ws(chr(0), a, 'structure_aware', 'narrative:' || run || ':0', ids, document)) AS record_id, 'text' AS record_type, document, page_start, page_end FROM r
    UNION ALL SELECT 'structure_aware::table::' || sha256(concat_ws(chr(0), a, 'structure_aware_parent', 'table-parent:' || place, 't' || page, content)), 'table', 'Introduction: In millions' || chr(10) || 'Columns/periods: Item; 2025' || chr(10) || 'Units: millions' || chr(10) || 'Significant rows: Turn', page, page FROM t WHERE role = 'system'"""
)
def corpus_chunks(t):
    return _corpus(t)[0].select("record_id", "record_type", "document", "metadata.page_start", "metadata.page_end")


@query("SELECT 'a-' || conv_id AS accession_number, count(*) FILTER (role = 'system') AS table_count, count(*) FILTER (role = 'system') AS table_chunk_count FROM conversations GROUP BY conv_id UNION ALL SELECT NULL, count(*) FILTER (role = 'system'), count(*) FILTER (role = 'system') FROM conversations")
def corpus_manifest(t):
    return corpus.manifest(*_corpus(t)).select("accession_number", "table_count", "table_chunk_count")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quillstrata import archive_queries, coverage_queries, mechanism_queries  # register their own

    assert archive_queries and coverage_queries and mechanism_queries
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
