"""Queries of sources, sinks, element functions, corpus records, search modes and judgements over the provided tables, with SQL.

Queries that write do so below the shared checkpoint folder and read back what they wrote.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.functions import elements as E
from quillstrata.functions import matrices as M
from quillstrata.functions import text as X
from quillstrata.operators import archive, corpus, ingest, locators, qrels, records, retrieval, vectors
from quillstrata.operators.folds import counted
from quillstrata.queries import _BM25, _DENSE, _QRELS, _asked, _asked_vectors, _corpus, _qrels, _top, _vectors, query
from quillstrata.sources import files, lineage, sinks, versions


def _folder(df: DataFrame) -> str:
    lineage.ready(df.sparkSession)
    return f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/out-{uuid.uuid4().hex}"


# Sources and sinks


@query("SELECT doc_id, lang, CASE WHEN doc_id % 7 > 0 THEN source END AS source, sha256(text) AS text_sha256 FROM documents")
def jsonl_round_trip(t):
    rows = t("documents").select("doc_id", "lang", F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("source"), "text")
    place = _folder(rows)
    sinks.write_jsonl(rows, place)
    return files.read_jsonl(rows.sparkSession, place, "doc_id long, lang string, source string, text string").select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def manifest_round_trip(t):
    rows = t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    place = _folder(rows) + ".json"
    sinks.write_manifest(rows, place, "s_suppkey")
    return files.read_manifest(rows.sparkSession, place, "s_suppkey long, s_name string, s_nationkey long")


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS place, trim(text) AS query FROM benchmark")
def query_file(t):
    rows = t("benchmark").select("item_id", F.concat(F.lit("  "), "text", F.lit(" ")).alias("query"))
    place = _folder(rows)
    rows.coalesce(1).orderBy("item_id").select(F.to_json(F.struct("query")).alias("value")).coalesce(1).write.text(place)
    read = files.read_query_texts(rows.sparkSession, place)
    return read.select((F.col("place") - F.lit(read.agg(F.min("place")).first()[0])).alias("place"), "query")


@query("SELECT vec_id AS pos, 'r' || vec_id AS record_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS total, 'model' AS model_name FROM embeddings")
def archive_round_trip(t):
    rows = t("embeddings").select(F.col("vec_id").alias("pos"), F.concat(F.lit("r"), "vec_id").alias("record_id"), F.transform(retrieval.unit(F.col("embedding")), lambda x: x.cast("float")).alias("embedding"))
    place = _folder(rows)
    archive.save_archive(rows, place, "model", "1", "a" * 64)
    found, origin = archive.load_archive(rows.sparkSession, place, rows.select("pos", "record_id"))
    return found.select("pos", "record_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"), F.lit(origin["model_name"]).alias("model_name"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'first' WHEN c_custkey % 3 = 1 THEN 'second' END AS run, c_custkey % 3 = 2 AS failed FROM customer")
def resumed_appends(t):
    """Two runs: the first does a third and fails at the rest, the second does another third and fails at all that is left."""
    rows = t("customer").select("c_custkey")
    place = _folder(rows)
    k = F.col("c_custkey") % 3
    once = lambda run, bad: sinks.append_missing(rows.withColumns({"run": F.lit(run), "error": F.when(bad, "x")}), f"{place}/done", "c_custkey", "error", f"{place}/errors-{run}")
    once("first", k > 0)
    once("second", k == 2)
    spark = rows.sparkSession
    done = spark.read.parquet(f"{place}/done").select("c_custkey", "run", F.lit(False).alias("failed"))
    return done.unionByName(spark.read.parquet(f"{place}/errors-second").select("c_custkey", F.lit(None).cast("string").alias("run"), F.lit(True).alias("failed")))


@query("SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey % 2 = 0 THEN 2 ELSE 1 END AS written FROM supplier")
def replaced_parts(t):
    rows = t("supplier").select("s_suppkey", "s_nationkey")
    place = _folder(rows)
    sinks.write_parts(rows.withColumn("written", F.lit(1)), place, "s_nationkey")
    sinks.write_parts(rows.where("s_nationkey % 2 = 0").withColumn("written", F.lit(2)), place, "s_nationkey")
    return rows.sparkSession.read.parquet(place).select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"), "written")


@query("SELECT o_orderkey, o_orderstatus, 3 AS version FROM orders WHERE o_orderkey % 2 = 1")
def newest_version(t):
    rows = t("orders").select("o_orderkey", "o_orderstatus")
    place = _folder(rows)
    for n in (1, 2, 3):
        versions.publish(rows.where(F.col("o_orderkey") % 2 == n % 2).withColumn("version", F.lit(n)), place)
    versions.prune(rows.sparkSession, place, 1)
    return versions.read(rows.sparkSession, place)


@query("SELECT c_nationkey::VARCHAR AS ticker, min(c_custkey) AS cik, CASE WHEN c_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS origin, c_nationkey AS place FROM customer WHERE c_nationkey % 5 < 4 GROUP BY c_nationkey")
def merged_manifest(t):
    """New rows replace old ones by ticker; companies that the registry doesn't enable go."""
    rows = t("customer").groupBy(F.col("c_nationkey").cast("string").alias("ticker")).agg(F.min("c_custkey").alias("cik"))
    named = lambda df, origin: df.withColumn("origin", F.lit(origin))
    registry = t("nation").select(F.col("n_nationkey").cast("string").alias("ticker"), (F.col("n_nationkey") % 5 < 4).alias("enabled"), F.col("n_nationkey").alias("place"))
    return ingest.merge_manifest(named(rows, "old"), named(rows.where("ticker % 3 = 0"), "new"), registry)


# Text and element functions

_NORMAL = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN true WHEN 1 THEN length(text) + 9 <= 180 AND NOT contains(text, chr(10) || chr(10)) ELSE false END AS starts FROM conversations")
def heading_starts(t):
    k = F.col("turn") % 4
    made = F.when(k == 0, F.concat(F.lit("**Head**\n\n"), "text")).when(k == 1, F.concat(F.lit("__Head__ "), "text")).otherwise(F.col("text"))
    return t("conversations").select("conv_id", "turn", X.is_heading_start(made).alias("starts"))


@query(f"SELECT doc_id, sha256({_NORMAL.format('text')}) AS clean_sha256 FROM documents")
def cleaned_text(t):
    """Zero-width characters, soft hyphens and no-break spaces put into the texts leave the same text."""
    noisy = F.regexp_replace(F.regexp_replace("text", "e", "e​"), " ", " ­ ")
    return t("documents").select("doc_id", F.sha2(E.clean(noisy, compose=True), 256).alias("clean_sha256"))


@query("SELECT conv_id, turn, turn % 3 = 0 OR (turn % 3 = 1 AND length(t) <= 120 AND len(regexp_extract_all(t, '[\\w''-]+')) <= 15 AND NOT regexp_matches(t, '[.!?;]$') AND length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 4) AS heading FROM (SELECT conv_id, turn, upper(regexp_replace(substring(text, 1, 40), '[^a-zA-Z ]', '', 'g')) AS t FROM conversations)")
def heading_elements(t):
    k = F.col("turn") % 3
    text = F.regexp_replace(F.substring("text", 1, 40), "[^a-zA-Z ]", "")
    made = F.when(k == 1, F.upper(text)).otherwise(F.concat(F.lower(text), F.lit(" x")))
    return t("conversations").select("conv_id", "turn", E.is_heading_element(F.when(k == 0, "H2").otherwise("p"), made).alias("heading"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'list' WHEN 2 THEN 'heading' WHEN 3 THEN 'paragraph' ELSE 'table' END AS class FROM nation")
def element_classes(t):
    k, name = F.col("n_nationkey") % 5, F.regexp_replace("n_name", "[0-9_]", "")
    long_ = F.concat(F.repeat(F.concat(name, F.lit(" grows and ")), 12), F.lit("ends. It is so"))
    text = F.when(k == 0, F.concat(name, F.lit(" | 12\nmore | 13"))).when(k == 1, F.concat(F.lit("• "), name, F.lit("\n• again"))).when(k == 2, name).when(k == 3, long_).otherwise(F.concat(name, F.lit("\n12\n13")))
    return t("nation").select("n_nationkey", E.element_class(text).alias("class"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN NULL ELSE c_mktsegment || ' risk' END AS section, CASE c_custkey % 4 WHEN 0 THEN 'Description: ' || c_mktsegment || chr(10) || 'Unit: in millions' WHEN 1 THEN 'Description: ' || c_mktsegment || chr(10) || 'Unit: Dollars in thousands' ELSE 'Section: ' || c_mktsegment || ' risk' || chr(10) || 'Description: ' || c_mktsegment END AS context FROM customer")
def section_contexts(t):
    """Titles that are ignored, units in headers and descriptions, and the lines made of them."""
    k, segment = F.col("c_custkey") % 4, F.col("c_mktsegment")
    title = F.when(k == 0, "Table of Contents (continued)").when(k == 1, "Forward-Looking Statements").otherwise(F.concat(F.lit("  "), segment, F.lit("   risk ")))
    header = F.when(k == 0, "Year, in millions, 2025").when(k == 1, "Dollars in thousands").otherwise("Year")
    return t("customer").select("c_custkey", E.useful_section(title).alias("section"), E.table_context(title, header, segment).alias("context"))


@query("SELECT conv_id AS doc, turn AS place, last_value(CASE WHEN turn % 3 = 0 THEN 'Item ' || (turn % 15 + 1) || CASE WHEN turn % 2 = 0 THEN 'A' ELSE '' END WHEN turn % 3 = 1 AND false THEN '' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS item FROM conversations")
def filled_items(t):
    """Every third turn begins an item; the others are text."""
    number = F.concat(F.col("turn") % 15 + 1, F.when(F.col("turn") % 2 == 0, "a").otherwise(""))
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("ITEM "), number, F.lit(". Heading"))).otherwise(F.concat(F.lit("about "), F.col("role"), F.lit(". "), F.repeat(F.lit("words of text "), 12)))
    return E.filled_items(t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("place"), text.alias("text"))).select("doc", "place", "item")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Balances of ' || replace(n_name, '_', '') WHEN 1 THEN n_name ELSE 'In millions' END AS title FROM nation")
def table_titles(t):
    k = F.col("n_nationkey") % 3
    before = F.when(k == 0, F.concat(F.lit("Intro.\n\n**Balances of "), "n_name", F.lit(":**\n\n"))).when(k == 1, "").otherwise("**Long** text\n\nIn millions.\n\n")
    text = F.concat(before, F.lit("|  "), "n_name", F.lit(" | 2025 |\n|---|---|\n| a | 1 |"))
    return t("nation").select("n_nationkey", M.table_title(text).alias("title"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN [n_name || ' | Amount'] WHEN 1 THEN [n_name || ' | Amount', '2025 | 2024'] ELSE [n_name || ' | Amount', 'a | b', 'c | d'] END AS header FROM nation")
def header_lines(t):
    k = F.col("n_nationkey") % 3
    rows = F.when(k == 0, "Loans | 12").when(k == 1, "2025 | 2024\nLoans | 1,200").otherwise("a | b\nc | d\ne | f\nLoans | 3")
    return t("nation").select("n_nationkey", locators.header_rows(F.concat("n_name", F.lit(" | Amount\n"), rows)).alias("header"))


@query("SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN 'glossary_entry' ELSE 'narrative' END AS scope, CASE n_nationkey % 2 WHEN 0 THEN 'H' || chr(10) || 'Term: ' || n_name || chr(10) || 'Definition: nation of ' || n_regionkey || ' kept' ELSE 'H' || chr(10) || 'Table content: ' || n_name || ' told in words' END AS document FROM nation")
def plain_locators(t):
    """Glossary rows and narrative tables; single cells and layout tables have none."""
    cell = lambda c: c.cast("string")
    glossary = F.array(F.array(F.col("n_name"), F.lit(""), F.concat(F.lit("nation of "), "n_regionkey"), F.lit("kept"), F.lit("kept")), F.array(F.lit("alone")))
    story = F.array(F.array(F.col("n_name"), F.lit("12")), F.array(F.lit("told in words"), cell(F.col("n_nationkey"))))
    even = F.col("n_nationkey") % 2 == 0
    rows = t("nation").select(F.col("n_nationkey").cast("string").alias("table_id"), F.when(even, "glossary").otherwise("narrative_table").alias("table_type"), F.array(F.when(even, glossary).otherwise(story)).alias("cell_matrices"), F.lit("H").alias("head"))
    layout = rows.withColumn("table_type", F.lit("layout"))
    return locators.table_locators(rows.unionByName(layout)).select(F.col("table_id").cast("long").alias("n_nationkey"), "scope", "document")


# Corpus


@query("SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS tokens FROM documents")
def injected_counts(t):
    return t("documents").select("doc_id", counted(records.word_tokens)(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS value FROM documents")
def coalesced_fields(t):
    rows = t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("value"), F.struct(F.col("source").alias("value")).alias("metadata"))
    return rows.select("doc_id", X.field("value").alias("value"))


@query(
    """WITH e AS (SELECT 'a-' || conv_id AS accession_number, 'e' || turn // 2 AS id, turn, text, conv_id FROM conversations),
    f AS (SELECT accession_number, id, arg_min(text, turn) AS content, min(turn) AS page FROM e GROUP BY ALL)
    SELECT accession_number, row_number() OVER (PARTITION BY accession_number ORDER BY page) - 1 AS element_index, id, sha256(trim(content)) AS content_sha256, page::INT AS page_start, (page + 2)::INT AS page_end,
        CASE WHEN page % 4 = 0 THEN (page + 100)::INT END AS start_display_page FROM f"""
)
def ordered_elements(t):
    """Turns are pages of two that share an element's id: the first stays, spans default to its page, every fourth page has a display number."""
    turn = F.col("turn").cast("int")
    element = F.struct(F.concat(F.lit("e"), F.floor(turn / 2)).alias("id"), F.lit(None).cast("string").alias("kind"), F.col("text").alias("content"), F.lit(None).cast("int").alias("page_start"), (turn + 2).alias("page_end"), F.lit(None).cast("array<string>").alias("tags"))
    pages = t("conversations").select(F.concat(F.lit("a-"), F.col("conv_id")).alias("accession_number"), turn.alias("number"), F.when(turn % 4 == 0, turn + 100).alias("display_page"), F.col("text").alias("content"), F.array(element).alias("elements"))
    made = corpus.ordered_elements(pages)
    return made.select("accession_number", "element_index", "id", F.sha2("content", 256).alias("content_sha256"), "page_start", "page_end", "start_display_page")


@query(
    """SELECT 'a-' || conv_id AS accession_number, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS table_index, 'data_table' AS table_type, true AS retrieval_eligible, 'In millions' AS section_title, turn::INT AS page_start, turn::INT AS page_end,
    't' || turn AS table_element_id, role AS tag, 'Item/2025/Turn/' || (turn + 10) AS cells FROM conversations WHERE role = 'system'"""
)
def table_records(t):
    """Lossless tables of the corpus with their running numbers, spans and tags."""
    m = lambda c: F.col(f"metadata.{c}")
    tables = _corpus(t)[1]
    return tables.select(
        m("accession_number").alias("accession_number"), "table_index", "table_type", "retrieval_eligible", m("section_title").alias("section_title"), m("page_start").alias("page_start"), m("page_end").alias("page_end"),
        m("table_element_id").alias("table_element_id"), F.array_join(m("xbrl_tags"), ",").alias("tag"), F.array_join(F.flatten(F.flatten("cell_matrices")), "/").alias("cells"),
    )


# Judgements and searches


@query(f"WITH {_QRELS}, r AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY query_id) SELECT CASE WHEN n IS NULL THEN 'unsupported' ELSE 'answerable' END AS status, count(*) AS query_count FROM benchmark LEFT JOIN r ON query_id = item_id GROUP BY 1")
def status_counts(t):
    return qrels.status_counts(_judged(t))


@query(f"WITH {_QRELS} SELECT query_id, target::VARCHAR AS target FROM qrels WHERE query_id IN (SELECT item_id FROM benchmark)")
def answerable_judgements(t):
    return qrels.judgements(_judged(t))


def _judged(t) -> DataFrame:
    found = _qrels(t).groupBy("query_id").agg(F.collect_list(F.col("target").cast("string")).alias("ids"))
    rows = t("benchmark").select(F.col("item_id").alias("query_id"), "text").join(found, "query_id", "left")
    return rows.select("query_id", F.col("text").alias("query"), F.when(F.col("ids").isNull(), "unsupported").otherwise("answerable").alias("status"), F.coalesce("ids", F.array().cast("array<string>")).alias(qrels.RELEVANT))


_PLAIN_TEXT = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"


@query(
    f"""WITH a AS (SELECT item_id, {_PLAIN_TEXT.format("text")} AS x, {_PLAIN_TEXT.format("string_split(text, ' ')[2]")} AS y FROM benchmark), d AS (SELECT doc_id, {_PLAIN_TEXT.format("text")} AS z FROM documents),
    m AS (SELECT item_id AS query_id, doc_id AS target, length(z) AS n FROM a JOIN d ON contains(z, x) AND contains(z, y))
    SELECT query_id, target, row_number() OVER (PARTITION BY query_id ORDER BY n, target) = 1 AS is_primary FROM m"""
)
def anchored_primaries(t):
    """All anchors of a passage in any case and spacing; the shortest document that holds them is primary."""
    word = F.get(F.split("text", " "), 1)
    anchors = t("benchmark").select(F.col("item_id").alias("query_id"), F.array(F.translate("text", string.ascii_lowercase, string.ascii_uppercase), F.regexp_replace(word, "$", "  ")).alias("anchors"))
    return qrels.anchored_judgements(t("documents").select(F.col("doc_id").alias("target"), F.col("text").alias("document")), anchors)


_LISTS = f"b30 AS ({_top('bm25_scores', 30)}), d30 AS ({_top('dense_scores', 30)})"
_FUSED = """fused AS (SELECT query_id, doc_id, d30.rank AS dense_rank, b30.rank AS bm25_rank, round(coalesce(1.0::DOUBLE / (60 + d30.rank), 0) + coalesce(1.0::DOUBLE / (60 + b30.rank), 0), 9) AS rrf_score FROM d30 FULL JOIN b30 USING (query_id, doc_id)),
f20 AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, least(dense_rank, bm25_rank), doc_id::VARCHAR) AS rank FROM fused) WHERE rank <= 20)"""


@query(
    f"""WITH {_BM25}, {_DENSE}, {_LISTS}, {_FUSED},
    p AS (SELECT query_id, doc_id, 0 AS step, rank FROM f20 UNION ALL SELECT query_id, doc_id, 1, rank FROM d30 WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, 1, rank FROM b30 WHERE rank <= 5),
    o AS (SELECT query_id, doc_id, min((step, rank)) AS best FROM p GROUP BY ALL)
    SELECT query_id, doc_id, rank::INT AS rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY best, doc_id) AS rank FROM o) WHERE rank <= 30"""
)
def candidate_pools(t):
    asked = _asked_vectors(t)
    dense = lineage.cut(retrieval.dense_topk(_vectors(t), asked.select("query_id", "vector"), 30))
    bm25 = lineage.cut(retrieval.bm25_topk(t("documents"), asked.select("query_id", "text"), 30))
    return retrieval.candidate_pool(dense, bm25).select("query_id", "doc_id", "rank")


@query(f"WITH {_BM25}, {_DENSE}, x AS ({_top('bm25_scores', 5, 'doc_id IN (SELECT doc_id FROM documents WHERE source = ' + chr(39) + 'src1' + chr(39) + ')')}), y AS ({_top('dense_scores', 5, 'doc_id IN (SELECT doc_id FROM documents WHERE source = ' + chr(39) + 'src1' + chr(39) + ')')}) SELECT 'bm25' AS mode, * FROM x UNION ALL SELECT 'dense', * FROM y")
def search_modes(t):
    """Modes by name, with the filter of one ticker."""
    docs = t("documents").withColumn("ticker", F.col("source"))
    where = vectors.filtered(docs.withColumn("record_type", F.lit("text")), ticker="SRC1")
    rows = lambda mode: vectors.search(mode, docs, _asked_vectors(t) if mode == "dense" else _asked(t), _vectors(t), 5, where=where).select(F.lit(mode).alias("mode"), "query_id", "doc_id", "score", "rank")
    return rows("bm25").unionByName(rows("dense"))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS ordered FROM customer")
def partitioned_by_key(t):
    customers, ordered = t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey"))
    return records.split_by_key(customers, ordered, "c_custkey", "ordered")
