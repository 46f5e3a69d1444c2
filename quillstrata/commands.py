"""Command line: python -m quillstrata.commands NAME, where NAME is one of

download, build-corpus, index, embed, search, evaluate, benchmark: the pipeline from feeds to measured retrieval;
parse, chunk, proxies, model-proxies, records, manifest: the element corpus;
structure, anchors, bakeoff: the structure-aware corpus and its comparison.

Inputs and outputs are Parquet folders unless said otherwise; an output appears whole or not at all. Models, tokenizers,
scorers, fetchers and clients are named as module:function; the function builds the encoder (texts -> vectors), the
counter (text -> tokens), the scorer (pairs -> scores) or the generator, or is the fetcher (url -> bytes).
"""

from __future__ import annotations

import argparse
import functools
import importlib
import time
from collections.abc import Callable
from statistics import fmean, median

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstrata.operators import archive, chunker, corpus, descriptions, experiments, ingest, metrics, proxies, qrels, reports, retrieval, structure, vectors
from quillstrata.operators.records import word_tokens
from quillstrata.sources import sinks
from quillstrata.sources.filings import parse_filings
from quillstrata.sources.files import embedding_inputs, read_html, read_query_texts, read_registry
from quillstrata.sources.lineage import cut
from quillstrata.sources.paths import inside
from quillstrata.sources.settings import load_settings, web_fetcher

MODES = ("dense", "bm25", "hybrid")


def named(place: str) -> Callable:
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def _counter(tokenizer: str | None) -> Callable[[str], int]:
    return named(tokenizer) if tokenizer else word_tokens


def _save(df: DataFrame, path: str, overwrite: bool) -> None:
    sinks.save(df, path, overwrite)


def build_corpus(spark: SparkSession, filings: str, pages: str, output: str, ticker: list[str] | None = None, overwrite: bool = False, default_output: str | None = None, tokenizer: str | None = None, description_mode: str = "local", model: str = "gpt-4o", client: str | None = None, grids: str | None = None) -> dict:
    """chunks, tables and manifest.json below output. A build of some tickers only may not replace default_output."""
    if ticker and default_output == output:
        raise ValueError("a filtered build needs an output of its own")
    count = _counter(tokenizer)
    picked = ingest.chosen(spark.read.parquet(filings), *(ticker or []))
    make = named(client) if client else descriptions.responses_client
    describe = functools.partial(descriptions.described, mode=description_mode, make=make, model=model)
    own = spark.read.parquet(pages).join(picked.select("accession_number"), "accession_number", "left_semi")
    chunks, tables = corpus.build_corpus(picked, own, count, spark.read.parquet(grids) if grids else None, describe=describe)
    _save(chunks, f"{output}/chunks", overwrite)
    _save(tables, f"{output}/tables", overwrite)
    chunks, tables = spark.read.parquet(f"{output}/chunks"), spark.read.parquet(f"{output}/tables")
    corpus.require_none(corpus.violations(chunks, tables, count))
    counts = sinks.rows_of(corpus.manifest(chunks, tables, count))
    total = next(r for r in counts if r["accession_number"] is None)
    about = {
        "corpus_version": corpus.VERSION, "tokenizer_name": tokenizer or "words", "max_embedding_tokens": vectors.MOST_TOKENS, "description_mode": description_mode, "description_model": model if description_mode != "local" else None,
        "filing_count": len(counts) - 1, **{k: v for k, v in total.items() if k not in ("ticker", "accession_number")}, "filings": sorted((r for r in counts if r["accession_number"] is not None), key=lambda r: (str(r["ticker"]), r["accession_number"])),
        "outputs": {r["path"]: {"sha256": r["sha256"], "bytes": r["bytes"]} for r in sinks.output_digests(spark, f"{output}/chunks", f"{output}/tables").collect()},
    }
    sinks.write_json(spark, f"{output}/manifest.json", about)
    return about


def index(spark: SparkSession, chunks: str, output: str, overwrite: bool = False) -> None:
    """The lexical index of the chunks, which search and evaluate read."""
    retrieval.store_index(_records(spark, chunks), output, overwrite=overwrite)


def _digest(spark: SparkSession, path: str) -> str:
    return sinks.output_digests(spark, path).first()["sha256"]


def embed(spark: SparkSession, chunks: str, output: str, model: str, limit: int | None = None, batch_size: int = vectors.BATCH, max_seq_length: int = vectors.MOST_TOKENS, overwrite: bool = False, tokenizer: str | None = None, reuse: str | None = None) -> int:
    """An archive of the chunks' vectors at output. With limit it is a smoke test: so many records are encoded, nothing is written.

    reuse: an archive of the same model, whose vectors are taken for the ids that it has.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    made_by = vectors.model_at(model)
    rows = embedding_inputs(spark.read.parquet(chunks)).select(F.col("record_id").alias("vec_id"), "embedding_text")
    code = lambda df: vectors.encoded(df, "vec_id", "embedding_text", made_by.make, batch_size, _counter(tokenizer), max_seq_length)
    if limit is not None:
        return code(rows.orderBy("vec_id").limit(limit)).count()
    if reuse:
        stored, origin = archive.load_archive(spark, reuse)
        if origin["model_name"] != made_by.name:
            raise ValueError(f"the archive to reuse is of {origin['model_name']}")
        kept = stored.join(rows.select(F.col("vec_id").alias("record_id")), "record_id", "left_semi").select(F.col("record_id").alias("vec_id"), "embedding")
        found = kept.unionByName(code(rows.join(kept.select("vec_id"), "vec_id", "left_anti")))
    else:
        found = code(rows)
    places = _places(spark, chunks)
    archive.save_archive(found.withColumnRenamed("vec_id", "record_id").join(places, "record_id"), output, made_by.name, made_by.revision, _digest(spark, chunks), overwrite)
    return archive.load_archive(spark, output, places)[0].count()


#: Buckets of ids by which records are ordered.
PLACES = 4_096


def _places(spark: SparkSession, chunks: str) -> DataFrame:
    """record_id, pos: a fixed order of the records, by buckets of their ids and then by id, numbered without gaps."""
    rows = spark.read.parquet(chunks).select("record_id", F.pmod(F.xxhash64("record_id"), F.lit(PLACES)).cast("int").alias("b"))
    before = rows.groupBy("b").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    placed = rows.withColumn("i", F.row_number().over(Window.partitionBy("b").orderBy("record_id")) - 1)
    return placed.join(F.broadcast(before.select("b", "before")), "b").select("record_id", (F.col("before") + F.col("i")).alias("pos"))


def _records(spark: SparkSession, chunks: str) -> DataFrame:
    return spark.read.parquet(chunks).select(F.col("record_id").alias("doc_id"), F.col("embedding_text").alias("text"), "document", "record_type", "target_chunk_id", F.col("metadata.ticker").alias("ticker"))


def _asked(queries: DataFrame, mode: str, model: str | None) -> DataFrame:
    if mode == "bm25":
        return queries.select("query_id", "text")
    if model is None:
        raise ValueError(f"{mode} search needs a model")
    return queries.select("query_id", "text").join(vectors.encoded(queries, "query_id", "text", named(model)).withColumnRenamed("embedding", "vector"), "query_id")


def _stored(spark: SparkSession, embeddings: str | None, chunks: str) -> tuple[DataFrame | None, str | None]:
    """(vectors, what a report should warn of) of an archive of these chunks."""
    if not embeddings:
        return None, None
    found, origin = archive.load_archive(spark, embeddings, _places(spark, chunks))
    if origin["input_sha256"] != _digest(spark, chunks):
        raise ValueError("the archive is of other chunks")
    return found.select(F.col("record_id").alias("doc_id"), "embedding"), archive.revision_warning(origin)


def _index(spark: SparkSession, path: str | None, asked: DataFrame) -> retrieval.LexicalIndex | None:
    return retrieval.stored_index(spark, path, asked.select("query_id", "text")) if path else None


def _whole_tables(spark: SparkSession, tables: str, records: DataFrame) -> DataFrame:
    """target_chunk_id, document; a table record without its table is an error."""
    whole = spark.read.parquet(tables).select(F.col("table_id").alias("target_chunk_id"), "document")
    unknown = records.where("record_type = 'table'").join(whole, "target_chunk_id", "left_anti")
    corpus.require_none(unknown.select(F.lit("unknown table").alias("rule"), F.col("target_chunk_id").alias("key")))
    return whole


def search(spark: SparkSession, query: str, chunks: str, tables: str, embeddings: str | None = None, model: str | None = None, mode: str = "hybrid", limit: int = 5, candidate_k: int = retrieval.CANDIDATES, rrf_k: int = retrieval.RRF_K, ticker: str | None = None, record_type: str | None = None, lexical: str | None = None, compact: bool = False) -> DataFrame:
    """rank, record, scores and evidence (a table hit's whole table) of one question; compact: without the long texts."""
    records = _records(spark, chunks)
    where = vectors.filtered(records, ticker, record_type) if ticker or record_type else None
    asked = spark.createDataFrame([(1, query)], "query_id long, text string")
    hits = vectors.search(mode, records, _asked(asked, mode, model), _stored(spark, embeddings, chunks)[0] if mode != "bm25" else None, limit, candidate_k, rrf_k, where, _index(spark, lexical, asked))
    found = hits.join(records.drop("text"), "doc_id")
    shown = retrieval.hydrate(found, _whole_tables(spark, tables, records), "target_chunk_id").orderBy("rank")
    return reports.compact(shown) if compact else shown


def evaluate(spark: SparkSession, queries: str, chunks: str, embeddings: str | None = None, model: str | None = None, methods: tuple[str, ...] = MODES, candidate_k: int = retrieval.CANDIDATES, rrf_k: int = retrieval.RRF_K, tables: str | None = None, output: str | None = None, lexical: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics a method and query, and their summary a method; all queries are ranked at once.

    output: a JSON report of both, with the corpus, the judgements, previews of what was found and the queries left out.
    """
    if not methods or len(set(methods)) < len(methods):
        raise ValueError("methods must be given once each")
    if "hybrid" in methods and (rrf_k < 1 or candidate_k < max(metrics.CUTS)):
        raise ValueError(f"rrf_k must be at least 1 and candidate_k at least {max(metrics.CUTS)}")
    records, asked = _records(spark, chunks), spark.read.parquet(queries)
    corpus.require_none(qrels.qrel_violations(asked, records.select("target_chunk_id")))
    if tables:
        _whole_tables(spark, tables, records)
    posed = asked.where("status = 'answerable'").select("query_id", F.col("query").alias("text"))
    stored, warning = _stored(spark, embeddings, chunks) if set(methods) != {"bm25"} else (None, None)
    hits = shown = None
    for m in methods:
        top = vectors.search(m, records, _asked(posed, m, model), stored if m != "bm25" else None, max(metrics.CUTS), candidate_k, rrf_k, index=_index(spark, lexical, posed))
        full = top.join(records.select("doc_id", F.col("doc_id").alias("record_id"), F.col("target_chunk_id").alias("target"), "target_chunk_id", "record_type", "ticker"), "doc_id").withColumn("method", F.lit(m))
        rows = full.select("method", "query_id", "target", "rank")
        seen = full.select("method", F.col("query_id").cast("string"), *(F.col(c).cast("string").alias(c) if c in full.columns else F.lit(None).cast("string").alias(c) for c in reports.SHOWN))
        hits = rows if hits is None else hits.unionByName(rows)
        shown = seen if shown is None else shown.unionByName(seen)
    measured = metrics.ranking_metrics(hits, qrels.judgements(asked)).join(metrics.group_metrics(hits, qrels.evidence_groups(asked)), ["method", "query_id"], "left")
    summary = metrics.summary(measured)
    if output:
        report = {
            "corpus": {"chunks": chunks, "tables": tables, "embeddings": embeddings, "record_count": records.count(), "chunks_sha256": _digest(spark, chunks), "embedding_revision_warning": warning},
            "qrels": {"path": queries, "sha256": _digest(spark, queries), "answerable_count": posed.count(), "skipped_by_status": {r["status"]: r["query_count"] for r in qrels.status_counts(asked.where("status <> 'answerable'")).collect()}, "skipped": sinks.rows_of(asked.where("status <> 'answerable'").select("query_id", "status"))},
            "methods": list(methods), "candidate_k": candidate_k, "rrf_k": rrf_k, "summary": {r.pop("method"): r for r in sinks.rows_of(reports.run_summary(measured))}, "per_query": sinks.rows_of(measured), "retrieved": sinks.rows_of(shown),
        }
        sinks.write_json(spark, output, report)
    return measured, summary


def benchmark(spark: SparkSession, queries: str, embeddings: str, model: str, limit: int | None = None, batch_size: int = vectors.BATCH, output: str | None = None) -> dict:
    """Times of encoding the questions of a JSON-lines file on the driver: alone, one by one, and in batches."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    texts = [r["query"] for r in read_query_texts(spark, queries, limit).orderBy("place").collect()]
    stored, origin = archive.load_archive(spark, embeddings)
    width = len(stored.first()["embedding"])

    def timed(run: Callable[[], np.ndarray], n: int) -> float:
        began = time.perf_counter()
        found = vectors.unit_rows(run())
        took = time.perf_counter() - began
        if found.shape != (n, width):
            raise ValueError(f"the model gave {found.shape}, not {(n, width)}")
        return took

    began = time.perf_counter()
    encode = named(model)()
    loaded = time.perf_counter() - began
    first = timed(lambda: encode(texts[:1]), 1)
    each = [timed(lambda t=t: encode([t]), 1) for t in texts]
    whole = timed(lambda: np.concatenate([encode(texts[i : i + batch_size]) for i in range(0, len(texts), batch_size)]), len(texts))
    report = {
        "model": origin["model_name"], "revision": origin["model_revision"], "query_count": len(texts), "dimensions": width, "model_load_seconds": loaded, "first_query_seconds": first, "individual_mean_seconds": fmean(each), "individual_median_seconds": median(each),
        "individual_min_seconds": min(each), "individual_max_seconds": max(each), "batch_total_seconds": whole, "batch_seconds_per_query": whole / len(texts), "batch_size": batch_size,
    }
    if output:
        sinks.write_json(spark, output, report)
    return report


def download(spark: SparkSession, registry: str, manifest: str, output: str, fetch: str | None = None, ticker: list[str] | None = None, root: str | None = None, slots: str | None = None, tasks: int = 1) -> int:
    """The newest filing of the enabled companies as files below output, and the manifest (JSON). Returns the exit status.

    Files that are there stay. A company that fails is named in the log; the others go on, and the status is 1. With
    ticker the other rows of the manifest stay. root: a folder that the files must lie in; paths are written relative to it.
    slots: a folder that all tasks see, for a rate over all of them. Feeds are judged in one job and files written by the
    tasks; only the companies' rows reach the driver, which writes the manifest.
    """
    log = sinks.configure_logging()
    settings = load_settings() if fetch is None else None
    get, rate = (web_fetcher(settings), settings.sec_requests_per_second) if settings else (named(fetch), 10.0)
    known = read_registry(spark, registry)
    banks = ingest.chosen(known.where("enabled"), *(ticker or []))
    feeds = cut(ingest.fetched(banks.withColumn("source_url", F.concat(F.lit(ingest.FEED.split("{")[0]), "cik", F.lit(".json"))), get, rate, tasks, slots))
    kinds = "cik string, legal_name string, ticker string, form string, accession_number string, filing_date string, report_date string, primary_document string, source_url string, local_html_path string"
    names = [c.split()[0] for c in kinds.split(", ")]
    judged = ingest.judged_filings(ingest.parsed_feeds(feeds, "PERMISSIVE")).select(*names, "error").collect()  # one row a company
    failed = [(r["ticker"], r["error"]) for r in [*feeds.where("error is not null").select("ticker", "error").collect(), *judged] if r["error"]]
    rows = [r for r in judged if not r["error"]]
    found = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], kinds)
    place = lambda r: f"{output.rstrip('/')}/{r['local_html_path']}"
    missing = [r["ticker"] for r in rows if not sinks.exists(spark, place(r))]
    if missing:
        for r in ingest.downloaded(found.where(F.col("ticker").isin(missing)), get, output, rate, tasks, slots).select("ticker", "local_html_path", "error").collect():
            if r["error"]:
                failed.append((r["ticker"], r["error"]))
            else:
                log.info("downloaded", extra={"fields": {"ticker": r["ticker"], "path": place(r)}})
    lost = {t for t, _ in failed}
    path = F.concat(F.lit(inside(output, root) if root else output.rstrip("/")), F.lit("/"), "local_html_path")
    new = found.where(~F.col("ticker").isin(*lost)) if lost else found
    new = new.withColumn("local_html_path", path)
    old = spark.read.option("multiLine", True).schema(new.schema).json(manifest) if ticker and sinks.exists(spark, manifest) else new.limit(0)
    sinks.write_manifest(ingest.merge_manifest(old.select(*new.columns), new, known), manifest, "place")
    for t, why in failed:
        log.error("download failed", extra={"fields": {"ticker": t, "error": why}})
    return int(bool(failed))


def parse(spark: SparkSession, filings: str, html: str, output: str, overwrite: bool = False) -> DataFrame:
    """Typed elements of raw filings, in parts by ticker. filings: Parquet with html_path; html: a glob of files. Coverage by ticker."""
    raw = read_html(spark, html).withColumnRenamed("path", "html_path")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    rows = spark.read.parquet(filings).withColumn("__qs_n", name(F.col("html_path"))).drop("html_path").join(raw.withColumn("__qs_n", name(F.col("html_path"))).select("__qs_n", "html"), "__qs_n").drop("__qs_n")
    if sinks.exists(spark, output) and not overwrite:
        raise FileExistsError(output)
    sinks.write_parts(parse_filings(rows), output, "ticker")
    return reports.coverage(spark.read.parquet(output), "ticker", "sec_item")


def chunk(spark: SparkSession, elements: str, output: str, tokenizer: str | None = None, older: bool = False, overwrite: bool = False) -> DataFrame:
    """Chunks of elements; token statistics by ticker."""
    _save(chunker.chunk_elements(spark.read.parquet(elements), _counter(tokenizer), older), output, overwrite)
    made = spark.read.parquet(output)
    corpus.require_none(chunker.chunk_violations(made))
    return reports.token_stats(made, "ticker", "token_count")


def make_proxies(spark: SparkSession, chunks: str, output: str, overwrite: bool = False) -> int:
    """Table proxies by rule, checked."""
    rows = spark.read.parquet(chunks)
    _save(proxies.table_proxies(rows), output, overwrite)
    made = spark.read.parquet(output)
    corpus.require_none(proxies.proxy_violations(rows, made))
    return made.count()


def make_model_proxies(spark: SparkSession, chunks: str, output: str, generator: str, model: str, errors: str | None = None, ticker: list[str] | None = None, exclude_ticker: list[str] | None = None, max_attempts: int = 2) -> int:
    """Table proxies by a model, appended; parts that are done stay, failures go to the folder errors. How many were added."""
    asked = proxies.model_proxies(spark.read.parquet(chunks), named(generator), model, max_attempts, tuple(ticker or ()), tuple(exclude_ticker or ()))
    if sinks.exists(spark, output):
        done = spark.read.parquet(output).select(F.col("target_chunk_id").alias("chunk_id"), "model").where(F.col("model") == model)
        todo = spark.read.parquet(chunks).join(done.select("chunk_id"), "chunk_id", "left_anti")
        asked = proxies.model_proxies(todo, named(generator), model, max_attempts, tuple(ticker or ()), tuple(exclude_ticker or ()))
    return sinks.append_missing(asked, output, "proxy_id", "error", errors)


def make_records(spark: SparkSession, chunks: str, proxy: str, output: str, overwrite: bool = False) -> int:
    rows, made = spark.read.parquet(chunks), spark.read.parquet(proxy)
    corpus.require_none(proxies.record_violations(rows, made))
    _save(proxies.embedding_records(rows, made), output, overwrite)
    return spark.read.parquet(output).count()


def manifest(spark: SparkSession, records: str, proxy: str, embeddings: str, output: str) -> dict:
    made = archive.embedding_manifest(spark, records, proxy, embeddings)
    sinks.write_json(spark, output, made)
    return made


def build_structure(spark: SparkSession, filings: str, pages: str, output: str, tokenizer: str | None = None, ticker: list[str] | None = None, overwrite: bool = False) -> DataFrame:
    """The corpus, and records and parents of the structure-aware one, below output; a summary."""
    count = _counter(tokenizer)
    build_corpus(spark, filings, pages, f"{output}/corpus", ticker, overwrite, tokenizer=tokenizer)
    picked = ingest.chosen(spark.read.parquet(filings), *(ticker or []))
    rows, parents = structure.structure_corpus(picked, spark.read.parquet(f"{output}/corpus/chunks"), spark.read.parquet(f"{output}/corpus/tables"), count)
    _save(rows, f"{output}/records", overwrite)
    _save(parents, f"{output}/parents", overwrite)
    made, whole = spark.read.parquet(f"{output}/records"), spark.read.parquet(f"{output}/parents")
    corpus.require_none(structure.corpus_violations(made, whole, count))
    sinks.write_json(spark, f"{output}/config.json", {v: structure.config_hash(v) for v in structure.CHUNKERS})
    sized = made.select("record_type", F.col("metadata.retrieval_eligible").alias("eligible"), F.size(F.split("document", r"\s+")).alias("tokens"), "metadata.page_start", "metadata.page_end")
    return reports.variant_summary(sized, "record_type", F.lit(structure.TEXT_MOST))


def _variant(spark: SparkSession, records: str) -> DataFrame:
    m = lambda c: F.col(f"metadata.{c}")
    return spark.read.parquet(records).select("record_id", "target_chunk_id", "record_type", "document", F.col("embedding_text").alias("text"), m("ticker").alias("ticker"), F.lit(None).cast("string").alias("report_date"), m("page_start").alias("page_start"), m("page_end").alias("page_end"), m("parent_id").alias("parent_id"))


def anchors(spark: SparkSession, specs: str, records: str, variant: str, output: str, overwrite: bool = False) -> DataFrame:
    """queries and audit below output, from question specifications with anchors."""
    made, audit = experiments.anchored_queries(spark.read.parquet(specs), _variant(spark, records), variant)
    _save(made, f"{output}/queries", overwrite)
    _save(audit, f"{output}/audit", overwrite)
    return spark.read.parquet(f"{output}/audit").select("query_id", "status", "matched_count", "primary_target_chunk_id")


def bakeoff(spark: SparkSession, variants: list[str], records: list[str], queries: list[str], model: str, scorer: str, output: str) -> dict:
    """A report on several corpora by the same questions: summaries, rows and gates of each. The lists go together."""
    if not len(variants) == len(records) == len(queries) or len(set(variants)) < len(variants):
        raise ValueError("variants, records and queries go together, each variant once")
    made, first = {}, spark.read.parquet(queries[0])
    for name, rows, asked in zip(variants, records, queries, strict=True):
        corpus_rows, posed = _variant(spark, rows), spark.read.parquet(asked)
        corpus.require_none(experiments.same_questions(first, posed))
        corpus.require_none(experiments.question_violations(posed, corpus_rows.select("target_chunk_id")))
        judged, coded = qrels.judgements(posed), vectors.model_at(model)
        stored = vectors.encoded(corpus_rows, "record_id", "text", coded.make, most=10**9).withColumnRenamed("record_id", "doc_id")
        vector = vectors.encoded(posed, "query_id", "query", coded.make).withColumnRenamed("embedding", "vector")
        run = experiments.retrieved(corpus_rows, stored, posed.join(vector, "query_id"), named(scorer))
        answerable = posed.where("status = 'answerable'")
        rows_ = experiments.variant_rows(run, posed, judged)
        spec = posed.select("query_id", F.array().cast("array<string>").alias("anchors")).limit(0)
        measured = experiments.per_query(run, answerable, judged, qrels.evidence_groups(posed))
        made[name] = {"record_count": corpus_rows.count(), "summary": {r.pop("method"): r for r in sinks.rows_of(reports.run_summary(measured))}, "gates": experiments.bakeoff_gates(rows_, run, judged, corpus_rows, spec).first().asDict(), "per_query": sinks.rows_of(rows_)}
    report = {"embedding_model_name": model, "reranker_model_name": scorer, "variants": made}
    sinks.write_json(spark, output, report)
    return report


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillstrata")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, **options: dict) -> None:
        sub = commands.add_parser(name)
        for option, how in options.items():
            how = dict(how)
            sub.add_argument(option if how.pop("plain", False) else "--" + option.replace("_", "-"), **how)
        sub.set_defaults(run=run)

    need, flag, many, number, some, free = {"required": True}, {"action": "store_true"}, {"action": "append"}, {"type": int}, {"nargs": "+", "required": True}, {}
    ranking = {"embeddings": free, "model": free, "lexical": free, "candidate_k": {**number, "default": retrieval.CANDIDATES}, "rrf_k": {**number, "default": retrieval.RRF_K}}
    coding = {"batch_size": {**number, "default": vectors.BATCH}, "limit": number}
    command("download", download, registry=need, manifest=need, output=need, fetch=free, ticker=many, root=free, slots=free, tasks={**number, "default": 1})
    command("build-corpus", build_corpus, filings=need, pages=need, output=need, grids=free, tokenizer=free, description_mode={"choices": descriptions.MODES, "default": "local"}, model={"default": "gpt-4o"}, client=free, ticker=many, overwrite=flag)
    command("index", index, chunks=need, output=need, overwrite=flag)
    command("embed", embed, chunks=need, output=need, model=need, tokenizer=free, reuse=free, max_seq_length={**number, "default": vectors.MOST_TOKENS}, overwrite=flag, **coding)
    command("search", search, query={"plain": True}, chunks=need, tables=need, mode={"choices": MODES, "default": "hybrid"}, limit={**number, "default": 5}, ticker=free, record_type={"choices": ("text", "table")}, compact=flag, **ranking)
    command("evaluate", evaluate, queries=need, chunks=need, tables=free, output=free, methods={"nargs": "+", "choices": MODES, "default": list(MODES)}, **ranking)
    command("benchmark", benchmark, queries=need, embeddings=need, model=need, output=free, **coding)
    command("parse", parse, filings=need, html=need, output=need, overwrite=flag)
    command("chunk", chunk, elements=need, output=need, tokenizer=free, older=flag, overwrite=flag)
    command("proxies", make_proxies, chunks=need, output=need, overwrite=flag)
    command("model-proxies", make_model_proxies, chunks=need, output=need, generator=need, model=need, errors=free, ticker=many, exclude_ticker=many, max_attempts={**number, "default": 2})
    command("records", make_records, chunks=need, proxy=need, output=need, overwrite=flag)
    command("manifest", manifest, records=need, proxy=need, embeddings=need, output=need)
    command("structure", build_structure, filings=need, pages=need, output=need, tokenizer=free, ticker=many, overwrite=flag)
    command("anchors", anchors, specs=need, records=need, variant=need, output=need, overwrite=flag)
    command("bakeoff", bakeoff, variants=some, records=some, queries=some, model=need, scorer=need, output=need)
    given = vars(parser.parse_args(argv))
    run, name = given.pop("run"), given.pop("command")
    made = run(SparkSession.builder.getOrCreate(), **given)
    if name == "download":
        return int(made)
    for df in made if isinstance(made, tuple) else (made,):
        if isinstance(df, DataFrame):
            df.show(50, truncate=120)
        elif df is not None:
            print(df)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
