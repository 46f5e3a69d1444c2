"""Reports over retrieval runs, corpora and filings: summaries, gates, profiles, histograms, previews and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.functions.elements import BULLET, SENTENCE_END, WORD
from quillstrata.functions.text import normalize_space, strip
from quillstrata.operators.metrics import CUTS

# Types of questions that are families of their own, and the headings of items in raw filings.
FAMILIES = {"narrative_risk": "narrative", "cross_bank_coverage": "cross_bank"}
ITEM_HEADING = r"(?i)^item\s+\d{1,2}[a-c]?\b"
#: Hits as a report shows them.
SHOWN = ("rank", "record_id", "target_chunk_id", "record_type", "ticker", "score", "dense_rank", "bm25_rank")
SHORT_TABLE = 120


def compact(hits: DataFrame) -> DataFrame:
    """Hits without their long texts."""
    return hits.drop("embedding_text", "retrieval_text", "document", "evidence", "text")


def result_preview(hits: DataFrame) -> DataFrame:
    """The columns of SHOWN; those that hits lacks are null."""
    return hits.select(*(F.col(c) if c in hits.columns else F.lit(None).cast("string").alias(c) for c in SHOWN))


def preview(document: Column, most: int = 500) -> Column:
    return F.substring(normalize_space(document), 1, most)


def with_previews(hits: DataFrame, most: int = 500) -> DataFrame:
    """Adds preview and, as score, the best that is known: the reranker's, the fused or the plain one."""
    known = [F.col(c).cast("double") for c in ("reranker_score", "rrf_score", "score") if c in hits.columns]
    return hits.withColumns({"score": F.coalesce(*known), "preview": preview(F.col("document"), most)})


def question_family(question_type: Column) -> Column:
    family = F.lit("table")
    for name, of in FAMILIES.items():
        family = F.when(question_type == name, of).otherwise(family)
    return family


def latencies(timings: DataFrame, *by: str) -> DataFrame:
    """timings: seconds. Mean, exact median, least and greatest, by the columns given."""
    return timings.groupBy(*by).agg(F.count("*").alias("query_count"), F.avg("seconds").alias("mean_seconds"), F.median("seconds").alias("median_seconds"), F.min("seconds").alias("min_seconds"), F.max("seconds").alias("max_seconds"))


def ticker_accuracy(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """method, query_id, ticker_filter_accuracy: the share of hits of the asked ticker; asked: query_id, ticker (null: any)."""
    rows = hits.join(asked.where("ticker is not null").select("query_id", F.upper("ticker").alias("wanted")), "query_id")
    return rows.groupBy("method", "query_id").agg(F.avg((F.upper("ticker") == F.col("wanted")).cast("int")).alias("ticker_filter_accuracy"))


def run_summary(rows: DataFrame, *by: str) -> DataFrame:
    """One row a method (or by): hit counts and rates, recalls, reciprocal rank, times, parents, candidates and evidence groups.

    rows: method, query_id, hit_at_k, recall_at_k, reciprocal_rank_at_10; where they are there also retrieval_seconds,
    reranking_seconds, unique_parents, max_siblings, ticker_filter_accuracy, candidate_hit, candidate_recall,
    candidate_parents, candidate_siblings, group_recall_at_k and complete_group_hit_at_k. Null values don't count.
    """
    has = lambda c: c in rows.columns
    mean = lambda c, name: [F.round(F.avg(c), 9).alias(name)] if has(c) else []
    total = lambda c, name: [F.sum(c).cast("long").alias(name)] if has(c) else []
    most = lambda c, name: [F.max(c).alias(name)] if has(c) else []
    found = [F.count("*").alias("query_count")]
    for k in CUTS:
        found += total(f"hit_at_{k}", f"hits_at_{k}") + mean(f"hit_at_{k}", f"hit_rate_at_{k}") + mean(f"recall_at_{k}", f"mean_recall_at_{k}")
    found += mean("reciprocal_rank_at_10", "mrr_at_10") + mean("retrieval_seconds", "mean_retrieval_seconds") + mean("reranking_seconds", "mean_reranking_seconds")
    found += mean("unique_parents", "mean_unique_parents_at_10") + most("max_siblings", "max_siblings_at_10") + mean("ticker_filter_accuracy", "ticker_filter_accuracy")
    found += total("candidate_hit", "candidate_hits_at_30") + mean("candidate_hit", "candidate_hit_rate_at_30") + mean("candidate_recall", "mean_candidate_recall_at_30") + mean("candidate_parents", "mean_candidate_parents") + most("candidate_siblings", "max_candidate_siblings")
    if has(f"group_recall_at_{CUTS[0]}"):
        found.append(F.count(f"group_recall_at_{CUTS[0]}").alias("grouped_query_count"))
        for k in CUTS:
            found += mean(f"group_recall_at_{k}", f"mean_group_recall_at_{k}") + total(f"complete_group_hit_at_{k}", f"complete_group_hits_at_{k}") + mean(f"complete_group_hit_at_{k}", f"complete_group_hit_rate_at_{k}")
    return rows.groupBy(*(by or ("method",))).agg(*found)


def gates(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: whether each condition holds for all rows (an unknown one does not), and pass, whether all do."""
    checked = rows.agg(*(F.coalesce(F.every(F.coalesce(c, F.lit(False))), F.lit(True)).alias(name) for name, c in conditions.items()))
    passed = F.lit(True)
    for name in conditions:
        passed = passed & F.col(name)
    return checked.withColumn("pass", passed)


def crosstab(rows: DataFrame, by: str, of: str, values: list[str]) -> DataFrame:
    """Counts of each of values a row of by."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(of) == v).alias(v) for v in values))


def token_stats(chunks: DataFrame, by: str, tokens: str) -> DataFrame:
    """by, chunks, tokens_min, tokens_mean, tokens_p95, tokens_max.

    The 95th percentile is the sorted value at place max(0, int(0.95 n) - 1), found from counts of equal values, so a hot
    group is no window of rows.
    """
    counts = chunks.groupBy(by, tokens).agg(F.count("*").alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(by).orderBy(tokens).rowsBetween(Window.unboundedPreceding, 0)))
    sizes = counts.groupBy(by).agg(F.sum("c").alias("chunks"), F.min(tokens).alias("tokens_min"), F.round(F.sum(F.col(tokens) * F.col("c")) / F.sum("c"), 9).alias("tokens_mean"), F.max(tokens).alias("tokens_max"))
    wanted = F.greatest(F.lit(0), F.floor(F.lit(0.95) * F.col("chunks")) - 1) + 1
    return run.join(sizes, by).where(F.col("upto") >= wanted).groupBy(by, "chunks", "tokens_min", "tokens_mean", "tokens_max").agg(F.min(tokens).alias("tokens_p95"))


def coverage(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, elements, coverage: the share of rows whose value is not null."""
    return rows.groupBy(by).agg(F.count("*").alias("elements"), F.avg(F.col(value).isNotNull().cast("int")).alias("coverage"))


def variant_summary(records: DataFrame, by: str, most: Column) -> DataFrame:
    """One row a variant. records: by, eligible, tokens, page_start, page_end; most: a row's token limit."""
    eligible = F.coalesce(F.col("eligible"), F.lit(False))
    unplaced = F.coalesce(F.col("page_start") <= 0, F.lit(True)) | F.coalesce(F.col("page_end") <= 0, F.lit(True))
    return records.groupBy(by).agg(
        F.count("*").alias("all_records"), F.count_if(eligible).alias("eligible_records"), F.count_if(~eligible).alias("ineligible_records"), F.coalesce(F.max(F.when(eligible, F.col("tokens"))), F.lit(0)).alias("maximum_tokens"),
        F.count_if(eligible & (F.col("tokens") > most)).alias("over_limit"), F.count_if(eligible & unplaced).alias("missing_page_provenance"),
    )


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("count"))


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(strip(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != ""))


def word_thresholds(records: DataFrame, by: str, text: str, at_most: tuple[int, ...] = (5, 10, 25, 50)) -> DataFrame:
    """by, records and how many have at most 5, 10, 25 and 50 words."""
    n = words(F.col(text))
    return records.groupBy(by).agg(F.count("*").alias("records"), *(F.count_if(n <= k).alias(f"at_most_{k}") for k in at_most))


def short_sections(records: DataFrame, by: str, section: str, text: str, at_most: int = 10, top: int = 10) -> DataFrame:
    """The top most frequent sections among records of at most so many words; ties by name."""
    counts = records.where(words(F.col(text)) <= at_most).groupBy(by, F.coalesce(section, F.lit("")).alias("section")).agg(F.count("*").alias("count"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("count"), "section"))).where(F.col("rank") <= top)


def table_features(tables: DataFrame, text: str = "text") -> DataFrame:
    """tables with row_count, content_columns, char_count, word_count, and what the table looks like."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.transform(F.split(body, r"\R"), strip), lambda x: x != "")
    plain = normalize_space(body)
    filled = F.coalesce(F.array_max(F.transform(lines, lambda r: F.size(F.filter(F.split(r, r" \| "), lambda c: F.trim(c) != "")))), F.lit(0))
    rows = tables.withColumns({"row_count": F.size(lines), "content_columns": filled, "char_count": F.length(plain), "word_count": F.regexp_count(plain, F.lit(WORD)), "has_numeric_value": plain.rlike(r"\d"), "bullet_like": strip(body).rlike(BULLET)})
    narrow, short = F.col("content_columns") <= 1, F.col("char_count") <= SHORT_TABLE
    return rows.withColumns({
        "one_row": F.col("row_count") == 1, "one_content_column": narrow, "very_short": short, "no_numeric_values": ~F.col("has_numeric_value"),
        "title_like": (F.col("row_count") <= 2) & narrow & short & (F.col("word_count") <= 15) & ~F.col("has_numeric_value") & ~plain.rlike(r"[.!?;]$"),
        "paragraph_like": narrow & ~short & plain.rlike(SENTENCE_END),
    })


LOOKS = ("one_row", "one_content_column", "very_short", "no_numeric_values", "title_like", "bullet_like", "paragraph_like")


def table_feature_counts(tables: DataFrame, by: str) -> DataFrame:
    """by, tables and how many have each look; tables as table_features gives them."""
    return tables.groupBy(by).agg(F.count("*").alias("tables"), *(F.count_if(c).alias(c) for c in LOOKS))


def filing_profile(elements: DataFrame, filings: DataFrame, key: str) -> DataFrame:
    """key, size_bytes, text_chars, tables, html_headings, item_candidates (sorted, each once).

    elements: key, kind, text (page_elements); filings: key, html.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    count = lambda tag: F.regexp_count(html, F.lit(rf"(?i)<{tag}[\s>/]"))
    raw = filings.select(key, F.octet_length(html).alias("size_bytes"), count("table").alias("tables"), count("h[1-6]").alias("html_headings"))
    said = elements.groupBy(key).agg(F.sum(F.length("text")).alias("text_chars"), F.sort_array(F.collect_set(F.when((F.length("text") <= 100) & F.col("text").rlike(ITEM_HEADING), F.col("text")))).alias("item_candidates"))
    return raw.join(said, key, "left").withColumns({"text_chars": F.coalesce("text_chars", F.lit(0)), "item_candidates": F.coalesce("item_candidates", F.array().cast("array<string>"))})


def item_transitions(elements: DataFrame, doc: str, place: str, item: str) -> DataFrame:
    """doc, place, item: where the item changes, nulls left out."""
    order = Window.partitionBy(doc).orderBy(place)
    rows = elements.where(F.col(item).isNotNull()).withColumn("__qs_before", F.lag(item).over(order))
    return rows.where(~F.col(item).eqNullSafe(F.col("__qs_before"))).select(doc, place, item)


def heading_spans(elements: DataFrame, doc: str, place: str, is_heading: Column, text: str) -> DataFrame:
    """doc, place, heading, content_elements, content_words: what lies between a heading and the next; is_short where that is little."""
    order = Window.partitionBy(doc).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = elements.withColumn("__qs_h", F.coalesce(is_heading, F.lit(False))).withColumn("__qs_span", F.sum(F.col("__qs_h").cast("int")).over(order)).where("__qs_span > 0")
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD))
    spans = rows.groupBy(doc, "__qs_span").agg(F.min(place).alias(place), F.min_by(text, place).alias("heading"), (F.count("*") - 1).alias("content_elements"), F.sum(F.when(~F.col("__qs_h"), n).otherwise(0)).alias("content_words"))
    return spans.drop("__qs_span").withColumn("is_short", (F.col("content_elements") <= 2) | (F.col("content_words") < 40))


def median_representatives(records: DataFrame, by: list[str], size: Column, key: str) -> DataFrame:
    """Of each group the row in the middle by size (ties by key): place n // 2, counted from 0."""
    group = Window.partitionBy(*by)
    placed = records.withColumns({"__qs_i": F.row_number().over(group.orderBy(size, key)) - 1, "__qs_n": F.count("*").over(group)})
    return placed.where(F.col("__qs_i") == F.floor(F.col("__qs_n") / 2)).drop("__qs_i", "__qs_n")


def round_robin(rows: DataFrame, by: str, size: Column, key: str, most: int = 8) -> DataFrame:
    """The first most rows, taken in turn from each group of by, the largest first; place tells the order."""
    turn = rows.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(size.desc(), key))).where(F.col("turn") <= most)
    return turn.orderBy("turn", by).limit(most).withColumn("place", F.row_number().over(Window.orderBy("turn", by)))


def answer_snippets(records: DataFrame, text: str, pattern: str, holds: tuple[str, ...] = (), around: int = 700) -> DataFrame:
    """Rows whose text (white space normalised) holds the pattern and, in any case, all of holds; snippet: around characters on either side."""
    rows = records.withColumn("__qs_t", normalize_space(F.col(text)))
    for h in holds:
        rows = rows.where(F.contains(F.lower("__qs_t"), F.lit(h.lower())))
    at = F.regexp_instr("__qs_t", F.lit(pattern))
    found = rows.withColumn("__qs_at", at).where("__qs_at > 0")
    start = F.greatest(F.lit(1), F.col("__qs_at") - around)
    size = F.col("__qs_at") - start + F.length(F.regexp_substr("__qs_t", F.lit(pattern))) + around
    return found.withColumn("snippet", F.substr("__qs_t", start, size)).drop("__qs_t", "__qs_at")
