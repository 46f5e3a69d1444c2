"""More queries over the provided tables: archives, reports, proxies, chunkers and experiments, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.functions import matrices as M
from quillstrata.functions import text as X
from quillstrata.operators import archive, chunker, experiments, ingest, locators, proxies, reports, retrieval, structure
from quillstrata.queries import _asked_vectors, _vectors, query

_SPACE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _many(spark, rows: str) -> DataFrame:
    """A small fixed table, as SQL says it."""
    return spark.sql(f"SELECT * FROM VALUES {rows}")


# Vectors and archives

_SCALED = "CASE WHEN vec_id % 3 = 0 THEN 0.25 WHEN vec_id % 3 = 1 THEN 8.0 ELSE 1.0 END"


@query(
    f"""WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: (x * {_SCALED})::FLOAT::DOUBLE) AS v FROM embeddings),
    c AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_dot_product(e.v, q.v) / sqrt(list_dot_product(e.v, e.v)) / sqrt(list_dot_product(q.v, q.v)), 6) AS score FROM s q, s e WHERE q.vec_id % 10 = 0)
    SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c) WHERE rank <= 5"""
)
def dense_unnormalised(t):
    scale = F.when(F.col("vec_id") % 3 == 0, 0.25).when(F.col("vec_id") % 3 == 1, 8.0).otherwise(1.0)
    rows = t("embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") * scale).cast("float")).alias("v"))
    asked = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("vector"))
    return retrieval.dense_topk(rows.select(F.col("vec_id").alias("doc_id"), F.col("v").alias("embedding")), asked, 5).select("query_id", "doc_id", "score", "rank")


@query("SELECT CASE vec_id % 5 WHEN 0 THEN 'empty vector' WHEN 1 THEN 'not finite' WHEN 2 THEN 'another width' ELSE 'zero vector' END AS rule, vec_id::VARCHAR AS key FROM embeddings WHERE vec_id % 5 < 4")
def dense_rejects(t):
    kind = F.col("vec_id") % 5
    e = F.col("embedding")
    v = F.when(kind == 0, F.lit(None)).when(kind == 1, F.transform(e, lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x))).when(kind == 2, F.slice(e, 1, 5)).when(kind == 3, F.transform(e, lambda x: x * 0)).otherwise(e)
    return retrieval.vector_faults(t("embeddings").select("vec_id", v.alias("v")), "vec_id", "v", 64)


@query(
    """SELECT 'repeated id' AS rule, count(*) - count(DISTINCT vec_id // 2) AS n FROM embeddings WHERE vec_id < 100
    UNION ALL SELECT 'not of length one', count(*) FILTER (vec_id % 4 = 0) FROM embeddings WHERE vec_id < 100
    UNION ALL SELECT 'blank id', count(*) FILTER (vec_id % 10 = 9 AND vec_id > 100) + 1 FROM embeddings WHERE vec_id = 9
    UNION ALL SELECT 'ids differ from the records''', count(*) FILTER (vec_id >= 50) + 1 FROM (SELECT DISTINCT vec_id // 2 + 1 AS vec_id FROM embeddings WHERE vec_id < 100)
    UNION ALL SELECT 'ids in another order', count(*) FILTER (vec_id BETWEEN 1 AND 49) FROM (SELECT DISTINCT vec_id // 2 AS vec_id FROM embeddings WHERE vec_id < 100) UNION ALL SELECT 'provenance is not one row', 1 UNION ALL SELECT 'blank model_name', 1 UNION ALL SELECT 'bad input_sha256', 1"""
)
def archive_checks(t):
    """Every second id repeats, the last is blank, a quarter of the vectors is too long, and the records begin one later."""
    rows = t("embeddings").where("vec_id < 100")
    scale = F.when(F.col("vec_id") % 4 == 0, 2.0).otherwise(1.0)
    named = F.floor(F.col("vec_id") / 2).cast("string")
    made = rows.select(F.floor(F.col("vec_id") / 2).alias("pos"), named.alias("record_id"), F.transform("embedding", lambda x: (x * scale).cast("float")).alias("embedding"))
    spark = rows.sparkSession
    blank = made.where("pos = 49").limit(1).select("pos", F.lit(" ").alias("record_id"), "embedding").withColumn("embedding", F.transform("embedding", lambda x: x))
    unit = lambda df: df
    origin = _many(spark, "('m', 'r', repeat('a', 64)), (' ', 'r', 'A') AS t(model_name, model_revision, input_sha256)")
    expected = spark.range(1, 50).select(F.col("id").cast("string").alias("record_id"), (F.col("id") + 1).alias("pos"))
    return _archive_counts(made, unit(blank), origin, expected)


def _archive_counts(made: DataFrame, blank: DataFrame, origin: DataFrame, expected: DataFrame) -> DataFrame:
    """The rules found, where a repeated id counts once for each repeat, and an order fault once for each row."""
    once = made.dropDuplicates(["record_id"])
    from_vectors = archive.violations(made.unionByName(blank), origin).where("rule <> 'blank model_revision'")
    order = archive.order_violations(once.unionByName(blank), expected)
    return from_vectors.unionByName(order)


@query("SELECT count(*) AS count, max(len(embedding))::INT AS dimension, round(min(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS minimum_norm, round(max(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS maximum_norm FROM embeddings")
def norm_range(t):
    return archive.norm_range(t("embeddings")).withColumns({"minimum_norm": F.round("minimum_norm", 5), "maximum_norm": F.round("maximum_norm", 5)})


# Reports


@query("SELECT event_type, count(*) AS query_count, round(avg(value), 9) AS mean_seconds, median(value) AS median_seconds, min(value) AS min_seconds, max(value) AS max_seconds FROM events GROUP BY event_type")
def latency_report(t):
    return reports.latencies(t("events").select("event_type", F.col("value").alias("seconds")), "event_type").withColumn("mean_seconds", F.round("mean_seconds", 9))


@query(
    """SELECT event_type AS method, count(*) AS query_count, sum((user_id % 2 = 0)::INT)::BIGINT AS hits_at_1, round(avg((user_id % 2 = 0)::INT), 9) AS hit_rate_at_1, round(avg(1 / (1 + user_id % 4)), 9) AS mean_recall_at_1,
    round(avg(1 / (1 + user_id % 3)), 9) AS mrr_at_10, round(avg(value), 9) AS mean_retrieval_seconds, round(avg(user_id % 5), 9) AS mean_unique_parents_at_10, max(user_id % 7) AS max_siblings_at_10,
    round(avg(CASE WHEN event_id % 2 = 0 THEN (user_id % 3) / 2 END), 9) AS ticker_filter_accuracy, sum(CASE WHEN event_id % 3 = 0 THEN user_id % 2 END)::BIGINT AS candidate_hits_at_30, round(avg(CASE WHEN event_id % 3 = 0 THEN user_id % 2 END), 9) AS candidate_hit_rate_at_30,
    count(CASE WHEN event_id % 5 = 0 THEN 1 END) AS grouped_query_count, round(avg(CASE WHEN event_id % 5 = 0 THEN (user_id % 4) / 4 END), 9) AS mean_group_recall_at_1 FROM events GROUP BY event_type"""
)
def run_summary(t):
    u, e = F.col("user_id"), F.col("event_id")
    rows = t("events").select(
        F.col("event_type").alias("method"), (u % 2 == 0).cast("int").alias("hit_at_1"), (F.lit(1) / (1 + u % 4)).alias("recall_at_1"), (F.lit(1) / (1 + u % 3)).alias("reciprocal_rank_at_10"), F.col("value").alias("retrieval_seconds"), (u % 5).alias("unique_parents"), (u % 7).alias("max_siblings"),
        F.when(e % 2 == 0, (u % 3) / 2).alias("ticker_filter_accuracy"), F.when(e % 3 == 0, u % 2).alias("candidate_hit"), F.when(e % 5 == 0, (u % 4) / 4).alias("group_recall_at_1"),
    )
    return reports.run_summary(rows).drop("n")


@query("SELECT bool_and(doc_id >= 0) AS ids_are_natural, bool_and(lang = 'en') AS all_english, bool_and(coalesce(n_chars > 0, false)) AS none_empty, bool_and(doc_id >= 0) AND bool_and(lang = 'en') AND bool_and(coalesce(n_chars > 0, false)) AS pass FROM documents")
def report_gates(t):
    return reports.gates(t("documents"), ids_are_natural=F.col("doc_id") >= 0, all_english=F.col("lang") == "en", none_empty=F.col("n_chars") > 0)


@query("SELECT source, count(*) AS elements, round(avg((quality IS NOT NULL)::INT), 9) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def item_coverage(t):
    return reports.coverage(t("documents").join(t("labels"), "doc_id", "left"), "source", "quality").withColumn("coverage", F.round("coverage", 9))


@query(
    """SELECT lang, count(*) AS all_records, count(*) FILTER (doc_id % 4 > 0) AS eligible_records, count(*) FILTER (doc_id % 4 = 0) AS ineligible_records, coalesce(max(n_chars) FILTER (doc_id % 4 > 0), 0) AS maximum_tokens,
    count(*) FILTER (doc_id % 4 > 0 AND n_chars > 2000) AS over_limit, count(*) FILTER (doc_id % 4 > 0 AND (doc_id % 5 = 0 OR doc_id % 7 = 0)) AS missing_page_provenance FROM documents GROUP BY lang"""
)
def variant_summary(t):
    d = F.col("doc_id")
    rows = t("documents").select("lang", (d % 4 > 0).alias("eligible"), F.col("n_chars").alias("tokens"), F.when(d % 5 > 0, d % 5).alias("page_start"), (d % 7).alias("page_end"))
    return reports.variant_summary(rows, "lang", F.lit(2000))


_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query(f"SELECT role, count(*) AS records, {', '.join(f'count(*) FILTER ({_WORDS} <= {k}) AS at_most_{k}' for k in (5, 10, 25, 50))} FROM conversations GROUP BY role")
def word_thresholds(t):
    return reports.word_thresholds(t("conversations"), "role", "text")


@query(f"WITH c AS (SELECT role, 'c' || conv_id % 9 AS section, count(*) AS count FROM conversations WHERE {_WORDS} <= 60 GROUP BY ALL) SELECT role, section, count, row_number() OVER (PARTITION BY role ORDER BY count DESC, section)::INT AS rank FROM c QUALIFY rank <= 4")
def short_sections(t):
    return reports.short_sections(t("conversations").withColumn("section", F.concat(F.lit("c"), F.col("conv_id") % 9)), "role", "section", "text", 60, 4)


def _tables(t) -> DataFrame:
    """Tables of many looks: of nations, one line, bullets, sentences and titles."""
    nation = t("nation").select("n_nationkey", "n_regionkey", "n_name")
    n = F.col("n_nationkey")
    row = lambda name, value: F.concat_ws(" | ", name, value)
    text = (
        F.when(n % 5 == 0, F.concat(F.lit("Name | 2025\n"), row(F.col("n_name"), (n + 100).cast("string"))))
        .when(n % 5 == 1, F.concat(F.lit("• "), F.col("n_name"), F.lit(" grows\n• and falls")))
        .when(n % 5 == 2, F.concat(F.col("n_name"), F.lit(" is a place of which much is said. "), F.repeat(F.lit("It has rivers and hills. "), 6)))
        .when(n % 5 == 3, F.concat(F.lit("About "), F.initcap("n_name")))
        .otherwise(F.concat(F.lit("a | b | c\n"), F.col("n_name"), F.lit(" |  | 7\nd | 1.")))
    )
    return nation.withColumn("text", text)


_TABLES = """tables AS (SELECT n_nationkey, n_regionkey, CASE n_nationkey % 5 WHEN 0 THEN 'Name | 2025' || chr(10) || n_name || ' | ' || (n_nationkey + 100) WHEN 1 THEN '• ' || n_name || ' grows' || chr(10) || '• and falls'
    WHEN 2 THEN n_name || ' is a place of which much is said. ' || repeat('It has rivers and hills. ', 6) WHEN 3 THEN 'About ' || array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
    ELSE 'a | b | c' || chr(10) || n_name || ' |  | 7' || chr(10) || 'd | 1.' END AS text FROM nation),
    lined AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM tables),
    sized AS (SELECT *, len(lines)::INT AS row_count, coalesce(list_max(list_transform(lines, lambda r: len(list_filter(string_split(r, ' | '), lambda c: trim(c) <> '')))), 0)::INT AS content_columns, length(plain)::INT AS char_count, len(regexp_extract_all(plain, '[\\p{L}\\p{N}_''-]+'))::INT AS word_count FROM lined)"""


@query(f"WITH {_TABLES} SELECT n_nationkey, row_count, content_columns, char_count, word_count, row_count <= 2 AND content_columns <= 1 AND char_count <= 120 AND word_count <= 15 AND NOT regexp_matches(plain, '[0-9]') AND NOT regexp_matches(plain, '[.!?;]$') AS title_like, content_columns <= 1 AND char_count > 120 AND regexp_matches(plain, '[.!?](\\s|$)') AS paragraph_like, regexp_matches(text, '(^|\\n)\\s*[•▪◦‣-]\\s+') AS bullet_like FROM sized")
def table_features(t):
    return reports.table_features(_tables(t)).select("n_nationkey", "row_count", "content_columns", "char_count", "word_count", "title_like", "paragraph_like", "bullet_like")


@query(f"WITH {_TABLES} SELECT n_regionkey, count(*) AS tables, count(*) FILTER (row_count = 1) AS one_row, count(*) FILTER (content_columns <= 1) AS one_content_column, count(*) FILTER (char_count <= 120) AS very_short, count(*) FILTER (NOT regexp_matches(plain, '[0-9]')) AS no_numeric_values FROM sized GROUP BY n_regionkey")
def table_feature_counts(t):
    return reports.table_feature_counts(reports.table_features(_tables(t)), "n_regionkey").select("n_regionkey", "tables", "one_row", "one_content_column", "very_short", "no_numeric_values")


@query("SELECT lang, source, count(*) AS count FROM documents GROUP BY ALL")
def type_histogram(t):
    return reports.histogram(t("documents"), "lang", "source")


@query("SELECT page_id, octet_length(encode(html)) AS size_bytes, len(regexp_extract_all(html, '(?i)<table[\\s>/]')) AS tables, len(regexp_extract_all(html, '(?i)<h[1-6][\\s>/]')) AS html_headings FROM pages")
def filing_profile(t):
    none = t("pages").sparkSession.sql("SELECT 0L AS page_id, '' AS text WHERE false")
    return reports.filing_profile(none, t("pages"), "page_id").select("page_id", F.col("size_bytes").cast("long"), F.col("tables").cast("long"), F.col("html_headings").cast("long"))


@query("SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role <> 'system') WHERE role IS DISTINCT FROM before")
def item_transitions(t):
    return reports.item_transitions(t("conversations").withColumn("role", F.when(F.col("role") != "system", F.col("role"))), "conv_id", "turn", "role")


@query(
    """WITH s AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS span FROM conversations),
    g AS (SELECT conv_id, span, min(turn) AS turn, arg_min(text, turn) AS heading, count(*) - 1 AS content_elements, sum(CASE WHEN role <> 'user' THEN len(regexp_extract_all(text, '[\\p{L}\\p{N}_''-]+')) ELSE 0 END)::BIGINT AS content_words FROM s WHERE span > 0 GROUP BY ALL)
    SELECT conv_id, turn, sha256(heading) AS heading_sha256, content_elements, content_elements <= 2 OR content_words < 40 AS is_short FROM g"""
)
def heading_spans(t):
    return reports.heading_spans(t("conversations"), "conv_id", "turn", F.col("role") == "user", "text").select("conv_id", "turn", F.sha2("heading", 256).alias("heading_sha256"), "content_elements", "is_short")


@query("SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) WHERE i = n // 2")
def median_representatives(t):
    return reports.median_representatives(t("documents"), ["source", "lang"], F.col("n_chars"), "doc_id").select("source", "lang", "doc_id")


@query("SELECT source, doc_id, row_number() OVER (ORDER BY turn, source)::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM documents) QUALIFY place <= 11")
def round_robin_examples(t):
    return reports.round_robin(t("documents"), "source", F.col("n_chars"), "doc_id", 11).select("source", "doc_id", "place")


@query(
    rf"""WITH n AS (SELECT doc_id, {_SPACE.format("text")} AS x FROM documents), f AS (SELECT *, regexp_extract(x, '[0-9]+[.][0-9]+', 0) AS hit FROM n WHERE regexp_matches(x, '[0-9]+[.][0-9]+') AND contains(lower(x), 'the')),
    p AS (SELECT *, instr(x, hit) AS place FROM f) SELECT doc_id, sha256(substr(x, greatest(1, place - 30), (place - greatest(1, place - 30) + length(hit) + 30)::INT)) AS snippet_sha256 FROM p"""
)
def answer_snippets(t):
    return reports.answer_snippets(t("documents"), "text", r"[0-9]+[.][0-9]+", ("the",), 30).select("doc_id", F.sha2("snippet", 256).alias("snippet_sha256"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'narrative' WHEN 'click' THEN 'cross_bank' ELSE 'table' END AS family FROM events")
def question_families(t):
    kind = F.when(F.col("event_type") == "view", "narrative_risk").when(F.col("event_type") == "click", "cross_bank_coverage").otherwise(F.col("event_type"))
    return t("events").select("event_id", reports.question_family(kind).alias("family"))


@query(f"SELECT doc_id, n_chars::DOUBLE AS score, sha256(substr({_SPACE.format('text')}, 1, 500)) AS preview_sha256 FROM documents")
def result_previews(t):
    rows = reports.with_previews(t("documents").select("doc_id", F.col("text").alias("document"), F.col("n_chars").alias("score"), F.lit(None).cast("double").alias("rrf_score")))
    return reports.compact(rows).select("doc_id", "score", F.sha2("preview", 256).alias("preview_sha256"))


@query("SELECT q.event_type AS method, q.user_id AS query_id, avg((q.value > 50)::INT) AS ticker_filter_accuracy FROM events q WHERE user_id % 2 = 0 GROUP BY ALL")
def ticker_accuracy(t):
    hits = t("events").select(F.col("event_type").alias("method"), F.col("user_id").alias("query_id"), F.when(F.col("value") > 50, "bk").otherwise("c").alias("ticker"))
    asked = t("events").select(F.col("user_id").alias("query_id")).distinct().withColumn("ticker", F.when(F.col("query_id") % 2 == 0, "BK"))
    return reports.ticker_accuracy(hits, asked)


@query(
    """SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'data_table' WHEN 1 THEN 'index' WHEN 2 THEN 'glossary' WHEN 3 THEN 'layout' WHEN 4 THEN 'narrative_table' ELSE 'layout' END AS class,
    CASE n_nationkey % 6 WHEN 0 THEN 'Introduction: Loans of ' || replace(n_name, '_', '') || chr(10) || 'Columns/periods: Name > Loans > 2025; 2025 > Total; 2024 > Total' || chr(10) || 'Units: billions' || chr(10) || 'Significant rows: ' || n_name || '; Cash' END AS description FROM nation"""
)
def table_classes(t):
    """Tables of all five classes, with ragged rows, period groups and two header rows."""
    n, name = F.col("n_nationkey") % 6, F.col("n_name")
    said = F.concat(name, F.lit(" is a place of which much is said and of whose rivers more is told than one would think"))
    text = (
        F.when(n == 0, F.concat(F.lit("Loans of "), name, F.lit(":\n\n| Name | 2025 | 2024 |\n|---|---|---|\n| | Total | Total |\n| Loans |\n| 2025 |\n| "), name, F.lit(" | 5 | 1 |\n| Cash | (7) | 8% |\nin billions")))
        .when(n == 1, F.concat(F.lit("| Item 1. "), name, F.lit(" | Page |\n|---|---|\n| Item 2. | 4 |")))
        .when(n == 2, F.concat(F.lit("Glossary of terms\n\n| Term | Meaning |\n|---|---|\n| "), name, F.lit(" | a place |")))
        .when(n == 3, F.concat(F.lit("| Commission file number | "), name, F.lit(" |\n|---|---|\n| x | y |")))
        .when(n == 4, F.concat(F.lit("| "), said, F.lit(" |\n|---|\n| "), said, F.lit(" |")))
        .otherwise(F.concat(F.lit("| "), name, F.lit(" |\n|---|\n| short |")))
    )
    rows = t("nation").select("n_nationkey", text.alias("text")).withColumn("m", M.markdown_matrices(F.col("text")))
    kind = M.table_class(F.col("text"), F.col("m"))
    return rows.select("n_nationkey", kind.alias("class"), F.when(kind == "data_table", M.table_description(F.col("text"), F.col("m"))).alias("description"))


# Proxies, records and chunks


def _parts(t) -> DataFrame:
    """Table parts and texts of regions, as chunks."""
    n = t("nation")
    row = F.concat_ws(" | ", "n_name", (F.col("n_nationkey") + 100).cast("string"))
    tables = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("body"))
    table = tables.select(F.concat(F.lit("t"), F.col("n_regionkey")).alias("chunk_id"), F.lit("table").alias("element_type"), F.concat(F.lit("Nation | 2025\n"), F.col("body")).alias("text"), F.concat(F.lit("T"), F.col("n_regionkey")).alias("table_id"), F.lit(0).alias("table_part_index"), F.lit(1).alias("table_part_count"), F.lit("Nation | 2025").alias("table_header"), F.lit("Section: S\nDescription: Balances of banks\nUnit: in millions").alias("table_context"))
    none = lambda c, k="string": F.lit(None).cast(k).alias(c)
    text = t("region").select(F.concat(F.lit("x"), F.col("r_regionkey")).alias("chunk_id"), F.lit("text").alias("element_type"), F.concat(F.lit(" About "), F.col("r_name")).alias("text"), none("table_id"), none("table_part_index", "int"), none("table_part_count", "int"), none("table_header"), none("table_context"))
    both = table.unionByName(text)
    return both.select("*", F.lit("BK").alias("ticker"), F.lit("2025-12-31").alias("report_date"), F.when(F.col("element_type") == "text", "Item 1A").alias("sec_item"), F.when(F.col("element_type") == "text", "Risk").otherwise("").alias("section_title"))


_PARTS = "lines AS (SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name || ' | ' || (n_nationkey + 100)) AS names FROM nation GROUP BY n_regionkey), made AS (SELECT 't' || n_regionkey AS target_chunk_id, sha256('deterministic-v1' || chr(0) || 't' || n_regionkey) AS proxy_id, concat_ws(chr(10), 'Bank: BK', 'Report: 2025 10-K', 'Context: Balances of banks', 'Columns: Nation; 2025', 'Rows: ' || names, 'Units: in millions') AS proxy_text FROM lines)"


@query(f"WITH {_PARTS} SELECT target_chunk_id, proxy_id, proxy_text FROM made")
def proxy_records(t):
    return proxies.table_proxies(_parts(t)).select("target_chunk_id", "proxy_id", "proxy_text")


@query("SELECT 'another version' AS rule, 't0' AS key UNION ALL SELECT 'empty proxy text', 't1' UNION ALL SELECT 'id does not follow from the target', 't2' UNION ALL SELECT 'table_id differs', 't3' UNION ALL SELECT 'table without a proxy', 't4' UNION ALL SELECT 'proxy without a table', 'tx' UNION ALL SELECT 'label None in the text', 'tx'")
def proxy_checks(t):
    made = proxies.table_proxies(_parts(t))
    at = lambda k: F.col("target_chunk_id") == k
    broken = made.where("target_chunk_id <> 't4'").withColumns({"proxy_version": F.when(at("t0"), "v0").otherwise(F.col("proxy_version")), "proxy_text": F.when(at("t1"), " ").otherwise(F.col("proxy_text")), "proxy_id": F.when(at("t2"), "odd").otherwise(F.col("proxy_id")), "table_id": F.when(at("t3"), "T9").otherwise(F.col("table_id"))})
    extra = made.where(at("t0")).withColumn("target_chunk_id", F.lit("tx")).withColumns({"proxy_id": proxies.proxy_id(F.lit("tx")), "proxy_text": F.lit("Section: None")})
    return proxies.proxy_violations(_parts(t), broken.unionByName(extra))


@query(
    f"""WITH {_PARTS} SELECT 'table::' || proxy_id AS record_id, proxy_text AS embedding_text, target_chunk_id, json('{{"ticker":"BK","report_date":"2025-12-31","element_type":"table","table_id":"T' || target_chunk_id[2] || '","table_part_index":0,"table_part_count":1,"proxy_id":"' || proxy_id || '","proxy_version":"deterministic-v1"}}')::VARCHAR AS metadata FROM made
    UNION ALL SELECT 'text::x' || r_regionkey, concat_ws(chr(10), 'Bank: BK', 'Report: 2025 10-K', 'SEC item: Item 1A', 'Section: Risk', '', 'About ' || r_name), 'x' || r_regionkey, '{{"ticker":"BK","report_date":"2025-12-31","sec_item":"Item 1A","section_title":"Risk","element_type":"text"}}' FROM region"""
)
def embedding_records(t):
    return proxies.embedding_records(_parts(t), proxies.table_proxies(_parts(t))).select("record_id", "embedding_text", "target_chunk_id", "metadata")


@query("SELECT 'unknown type' AS rule, 'x0' AS key UNION ALL SELECT 'blank ticker', 'x1' UNION ALL SELECT 'repeated chunk id', 'x2' UNION ALL SELECT 'proxy with a blank proxy_text', 't0'")
def record_checks(t):
    parts = _parts(t)
    at = lambda k: F.col("chunk_id") == k
    broken = parts.withColumns({"element_type": F.when(at("x0"), "mixed").otherwise(F.col("element_type")), "ticker": F.when(at("x1"), "  ").otherwise(F.col("ticker"))})
    made = proxies.table_proxies(parts)
    return proxies.record_violations(broken.unionByName(broken.where(at("x2"))), made.withColumn("proxy_text", F.when(F.col("target_chunk_id") == "t0", "").otherwise(F.col("proxy_text"))))


@query("SELECT conv_id, turn, sha256('a-' || conv_id || chr(0) || turn || chr(0) || text) AS chunk_id, sha256('a-' || conv_id || chr(0) || 'u' || chr(0) || turn) AS table_id, sha256(conv_id || chr(0) || 'm' || chr(0) || 'table_proxy_v1') AS model_proxy_id FROM conversations")
def builtin_ids(t):
    a = F.concat(F.lit("a-"), F.col("conv_id"))
    return t("conversations").select("conv_id", "turn", proxies.builtin_chunk_id(a, F.col("turn"), F.col("text")).alias("chunk_id"), proxies.builtin_table_id(a, F.lit("u"), F.col("turn")).alias("table_id"), proxies.model_proxy_id(F.col("conv_id").cast("string"), "m").alias("model_proxy_id"))


@query(
    """WITH RECURSIVE e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, role, trim(text) AS text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS w FROM conversations),
    f AS (
        SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS w, -1::BIGINT AS chunk, -1::BIGINT AS part FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT f.conv_id, e.i, CASE WHEN e.role = 'system' THEN 0 WHEN f.w > 0 AND f.w < 600 AND f.w + e.w <= 700 THEN f.w + e.w ELSE e.w END,
            CASE WHEN e.role = 'system' OR NOT (f.w > 0 AND f.w < 600 AND f.w + e.w <= 700) THEN f.chunk + 1 ELSE f.chunk END, 0
        FROM f JOIN e ON e.conv_id = f.conv_id AND e.i = f.i + 1
    ),
    c AS (SELECT conv_id, chunk, max(role = 'system') AS is_table, min(turn) AS order_start, max(turn) AS order_end, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, sum(e.w)::BIGINT AS w FROM f JOIN e USING (conv_id, i) GROUP BY ALL),
    m AS (SELECT *, w < 80 AND NOT is_table AND lag(NOT is_table AND w + 0 <= 700, 1, false) OVER o AND w + lag(w, 1, 0) OVER o <= 700 AS joins FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY chunk)),
    g AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY conv_id ORDER BY chunk ROWS UNBOUNDED PRECEDING) - 1 AS chunk_index FROM m)
    SELECT 'a-' || conv_id AS accession_number, chunk_index::INT AS chunk_index, CASE WHEN bool_or(is_table) THEN 'table' ELSE 'text' END AS element_type, min(order_start) AS order_start, max(order_end) AS order_end, sha256(string_agg(text, chr(10) || chr(10) ORDER BY chunk)) AS text_sha256 FROM g GROUP BY conv_id, chunk_index"""
)
def element_chunks(t):
    """Conversations as filings: a turn is a paragraph, a system turn a table of one line."""
    about = [F.lit("x").alias(c) for c in ("ticker", "cik", "filing_date", "report_date", "source_url")]
    rows = t("conversations").select(F.concat(F.lit("a-"), F.col("conv_id")).alias("accession_number"), *about, F.col("turn").alias("order_index"), F.when(F.col("role") == "system", "table").otherwise("paragraph").alias("element_type"), "text", F.lit(False).alias("is_navigation"), F.lit("Item 1").alias("sec_item"), F.lit("s").alias("section_title"))
    made = chunker.chunk_elements(rows)
    return made.select("accession_number", "chunk_index", "element_type", "order_start", "order_end", F.sha2("text", 256).alias("text_sha256"))


# The structure-aware corpus and experiments


@query("SELECT n_regionkey, 'x ' || n_regionkey || chr(10) || chr(10) || 'In millions' AS context, count(*) + 2 AS lines FROM nation GROUP BY n_regionkey UNION ALL SELECT n_regionkey, 'x ' || n_regionkey || chr(10) || chr(10) || 'In millions' || chr(10) || chr(10) || 'Second', 1 FROM nation GROUP BY n_regionkey")
def table_blocks(t):
    row = F.concat(F.lit("| "), F.col("n_name"), F.lit(" |  "))
    body = t("nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(row), "\n").alias("b"))
    text = F.concat(F.lit("x "), F.col("n_regionkey"), F.lit("\n\n  In millions\n| a |\n|---|\n"), F.col("b"), F.lit("\nSecond\n  | z |"))
    return body.select("n_regionkey", F.explode(structure.table_blocks(text)).alias("x")).select("n_regionkey", "x.context", F.size("x.lines").cast("long").alias("lines"))


@query("SELECT r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN 'Balances of ' || r_name || ' — Year 2025' WHEN 1 THEN 'Balances of ' || r_name ELSE 'Year 2025' END AS title, CASE WHEN r_regionkey % 3 = 2 THEN 'Year 2025' ELSE 'Balances of ' || r_name END AS plain_title FROM region")
def structure_titles(t):
    k = F.col("r_regionkey") % 3
    text = F.concat(F.when(k < 2, F.concat(F.lit("Intro.\n**Balances of "), F.col("r_name"), F.lit("**:\n\n"))).otherwise(""), F.when(k == 1, "| Name | 2025 |\n").otherwise("|  Year  2025 | x |\n"), F.lit("|---|---|\n| a | 1 |"))
    return t("region").select("r_regionkey", structure.table_title(text, F.lit(True)).alias("title"), structure.table_title(text, F.lit(False)).alias("plain_title"))


@query("""SELECT n_name AS variant, sha256('{"chunker_version":"chunker-' || n_regionkey || '","data_locator_max_tokens":512,"parser_name":"sec2md","parser_version":"0.1.23","table_text_locator_max_tokens":1024,"text_max_tokens":1024,"text_overlap_tokens":64,"text_target_tokens":512,"variant":"' || n_name || '"}') AS hash FROM nation""")
def config_hashes(t):
    return t("nation").select(F.col("n_name").alias("variant"), structure.config_hashes(F.col("n_name"), F.concat(F.lit("chunker-"), F.col("n_regionkey"))).alias("hash"))


def _adapted(t) -> DataFrame:
    turns = t("conversations")
    element = F.struct(F.concat(F.lit("e"), F.col("turn")).alias("id"), F.when(F.col("turn") % 2 == 0, "table").otherwise("text").alias("kind"), F.array("role").alias("tags"))
    chunks = turns.select(F.concat(F.lit("a-"), F.col("conv_id")).alias("accession_number"), F.col("turn").alias("index"), F.when(F.col("turn") % 5 == 4, "Table of Contents").otherwise(F.col("text")).alias("content"), (F.col("turn") % 3 == 0).alias("has_table"), (F.col("turn") + 1).cast("int").alias("start_page"), F.lit(None).cast("int").alias("end_page"), F.lit(None).cast("int").alias("start_display_page"), F.lit(None).cast("int").alias("end_display_page"), F.array(element).alias("elements"))
    filings = chunks.select("accession_number").distinct().select("accession_number", *(F.lit("x").alias(c) for c in ("ticker", "cik", "filing_date", "report_date", "source_url", "raw_sha256", "legal_name")))
    return structure.adapted_chunks(chunks, filings)


@query(
    """SELECT 'sec2md_builtin::' || sha256(concat_ws(chr(0), 'a-' || conv_id, 'sec2md_builtin', turn::VARCHAR, 'e' || turn, trim(CASE WHEN turn % 5 = 4 THEN 'Table of Contents' ELSE text END))) AS record_id,
    CASE WHEN turn % 3 = 0 AND turn % 2 = 1 THEN 'mixed' WHEN turn % 3 = 0 THEN 'table' ELSE 'text' END AS record_type, turn % 5 <> 4 AS retrieval_eligible, (turn + 1)::INT AS page_end FROM conversations"""
)
def adapted_chunks(t):
    return _adapted(t).select("record_id", "record_type", "metadata.retrieval_eligible", "metadata.page_end")


@query("SELECT 'no page' AS rule, count(*) FILTER (conv_id % 7 = 0) AS n FROM conversations WHERE turn = 1 UNION ALL SELECT 'too many tokens', count(*) FILTER (turn % 5 <> 4) FROM conversations UNION ALL SELECT 'repeated record id', count(*) FROM conversations WHERE turn = 0 UNION ALL SELECT 'repeated target', count(*) FROM conversations WHERE turn = 0")
def structure_checks(t):
    rows = _adapted(t)
    rows = rows.withColumn("metadata", F.col("metadata").withField("page_start", F.when((F.col("metadata.page_start") == 2) & (F.regexp_extract("metadata.accession_number", r"(\d+)", 1).cast("int") % 7 == 0), 0).otherwise(F.col("metadata.page_start"))).withField("table_type", F.lit("x")).withField("locator_scope", F.lit("x")))
    again = rows.where("metadata.page_end = 1").withColumn("metadata", F.col("metadata").withField("retrieval_eligible", F.lit(False)))
    return structure.record_violations(rows.unionByName(again), lambda text: 9_999).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    """WITH d AS MATERIALIZED (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS x FROM documents), b AS MATERIALIZED (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS x FROM benchmark),
    h AS (SELECT item_id, doc_id, length(d.x) AS n FROM b JOIN d ON contains(d.x, b.x)),
    p AS (SELECT item_id, arg_min(doc_id::VARCHAR, (n, doc_id::VARCHAR)) AS first, count(*) AS matched FROM h GROUP BY item_id)
    SELECT item_id::VARCHAR AS query_id, CASE WHEN item_id % 4 = 0 THEN 'unsupported' ELSE 'ambiguous' END AS status, CASE WHEN item_id % 4 = 0 THEN 0 ELSE coalesce(matched, 0) END::INT AS matched_count, CASE WHEN item_id % 4 > 0 THEN first END AS primary_target_chunk_id FROM benchmark LEFT JOIN p USING (item_id)"""
)
def anchored_queries(t):
    specs = t("benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.lit("q").alias("query"), F.when(F.col("item_id") % 4 == 0, "unsupported").otherwise("ambiguous").alias("status"), F.array("text").alias("anchors"))
    records = t("documents").select(F.col("doc_id").cast("string").alias("target_chunk_id"), F.col("text").alias("document"), F.lit("text").alias("record_type"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    return experiments.anchored_queries(specs, records, "v")[1].select("query_id", "status", "matched_count", "primary_target_chunk_id")


def _mapped(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = F.col("n_nationkey")
    queries = t("nation").select(F.concat(F.lit("q"), n).alias("query_id"), F.col("n_name").alias("query"), F.when(n % 5 == 4, "unsupported").otherwise("answerable").alias("status"), F.lit("old").alias("primary_target_chunk_id"))
    mapping = t("nation").where(n % 3 > 0).select(F.concat(F.lit("q"), n).alias("query_id"), F.array(F.concat(F.lit("t"), n), F.concat(F.lit("u"), n)).alias("targets"))
    plan = t("nation").where(n % 6 == 0).select(F.concat(F.lit("q"), n).alias("query_id"), F.explode(F.array(F.struct(F.lit("a").alias("entity"), F.concat(F.lit("q"), n + 1).alias("from_query"), F.lit(0).alias("place")), F.struct(F.lit("b").alias("entity"), F.lit("q2").alias("from_query"), F.lit(1).alias("place")))).alias("x")).select("query_id", "x.*")
    return queries, mapping, plan


@query(
    """SELECT 'q' || n_nationkey AS query_id, CASE WHEN n_nationkey % 6 = 0 AND n_nationkey < 24 THEN concat_ws(',', 't' || n_nationkey + 1, 'u' || n_nationkey + 1, 't2', 'u2') WHEN n_nationkey = 24 THEN 't2,u2' WHEN n_nationkey % 3 > 0 AND n_nationkey % 5 <> 4 THEN concat_ws(',', 't' || n_nationkey, 'u' || n_nationkey) ELSE '' END AS targets,
    CASE WHEN n_nationkey % 6 = 0 AND n_nationkey < 24 THEN 't' || n_nationkey + 1 WHEN n_nationkey = 24 THEN 't2' WHEN n_nationkey % 3 > 0 AND n_nationkey % 5 <> 4 THEN 't' || n_nationkey END AS primary_target_chunk_id, CASE WHEN n_nationkey = 24 THEN 1 WHEN n_nationkey % 6 = 0 THEN 2 END::INT AS groups FROM nation"""
)
def remapped_queries(t):
    made = experiments.remapped_queries(*_mapped(t))
    return made.select("query_id", F.array_join("relevant_target_chunk_ids", ",").alias("targets"), "primary_target_chunk_id", F.when(F.col("required_evidence_groups").isNotNull(), F.size("required_evidence_groups")).alias("groups"))


@query(
    """SELECT 'no mapping' AS rule, count(*) AS n FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 3 = 0 AND n_nationkey % 6 <> 0
    UNION ALL SELECT 'mapping of no answerable query', count(*) FROM nation WHERE n_nationkey % 5 = 4 AND (n_nationkey % 3 > 0 AND n_nationkey <> 2 AND n_nationkey % 6 <> 1 OR n_nationkey % 6 = 0 OR n_nationkey % 3 > 0)
    UNION ALL SELECT 'unknown target', count(*) FROM nation WHERE n_nationkey % 3 > 0 UNION ALL SELECT 'locator without a place', count(*) FROM nation WHERE n_nationkey % 3 > 0 AND n_nationkey % 2 = 0"""
)
def mapping_checks(t):
    queries, mapping, plan = _mapped(t)
    n = F.col("n_nationkey")
    records = t("nation").select(F.concat(F.lit("t"), n).alias("target_chunk_id"), F.lit("table_locator").alias("record_type"), F.lit("p").alias("parent_id"), (n % 2 == 1).alias("located"))
    return experiments.mapping_violations(queries, mapping, plan, records).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT 'questions differ' AS rule, doc_id::VARCHAR AS key FROM documents WHERE doc_id % 10 = 3 OR doc_id % 10 = 7")
def same_questions(t):
    left = t("documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("query"))
    right = left.where("query_id % 10 <> 7").withColumn("query", F.when(F.col("query_id") % 10 == 3, "other").otherwise(F.col("query")))
    return experiments.same_questions(left, right)


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2')")
def ticker_exclusion(t):
    return ingest.excluded(t("documents").withColumn("ticker", F.col("source")), "SRC1,src2").select("doc_id")


@query("SELECT DISTINCT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND length(source) > 0")
def exact_phrases(t):
    """Judgements whose passages are short: a word alone is tried on all."""
    rows = t("documents").join(t("labels").where("quality = 1"), "doc_id").select("doc_id", "quality", "source")
    from quillstrata.operators import qrels

    hits = qrels.passage_judgements(rows.select("doc_id", F.col("source").alias("text")), rows.select(F.col("source").alias("query_id"), F.col("source").alias("passage")).distinct())
    return rows.join(hits.select(F.col("target").alias("doc_id")).distinct(), "doc_id").select("doc_id", "quality")


@query(f"SELECT doc_id, {_SPACE.format('text')} = '' AS blank, sha256({_SPACE.format('text')}) AS plain_sha256 FROM documents")
def normalized_space(t):
    plain = X.normalize_space(F.col("text"))
    return t("documents").select("doc_id", (plain == "").alias("blank"), F.sha2(plain, 256).alias("plain_sha256"))


@query("SELECT r_regionkey, 'Balances of banks' AS context, 'a; B' AS labels FROM region")
def proxy_context(t):
    said = F.lit("Section: S\n  unit: x\nDescription: Balances of  banks\nCONTEXT: balances of banks\n\n")
    return t("region").select("r_regionkey", proxies.plain_context(said).alias("context"), F.array_join(locators.unique_labels(F.array(F.lit(" a"), F.lit("A |"), F.lit("B"), F.lit(""))), "; ").alias("labels"))


@query("WITH q AS (SELECT b.item_id AS query_id FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id) SELECT count(*) AS asked, count(DISTINCT query_id) AS queries FROM q")
def asked_vectors(t):
    return _asked_vectors(t).join(_vectors(t).select("doc_id"), F.col("query_id") == F.col("doc_id")).agg(F.count("*").alias("asked"), F.count_distinct("query_id").alias("queries"))
