"""The thirteen operators and the pipeline as queries with their production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstrata.llm import balltree, bpe, licenses, linefield, lines, mixing, quality, resample, secrets, simhash, urls, variants, windows
from quillstrata.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict[str, Query]:
    on_docs = lambda f: lambda spark, sf_dir: f(documents(spark, sf_dir))
    table = lambda name, f: lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return {
        "op1_license_scan": on_docs(licenses.license_verdicts),
        "op2_source_mix": on_docs(mixing.mix_report),
        "op3_quality_rules": on_docs(lambda d: quality.quality_verdicts(d).select("doc_id", *quality.STATS, "base_failed", "kept")),
        "op4_simhash": on_docs(simhash.simhash_digests),
        "op5_line_dedup": on_docs(lines.line_digests),
        "op6_url_filter": table("pages", urls.url_verdicts),
        "op7_substring_dedup": on_docs(windows.window_digests),
        "op8_ball_tree_top_k": table("embeddings", balltree.top_inner_products),
        "op9_secret_scan": on_docs(secrets.secret_digests),
        "op10_bpe": on_docs(lambda d: bpe.bpe_digests(d, tokenizer_path())),
        "op11_importance_resampling": lambda spark, sf_dir: resample.resample_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
        "op12_spelling_variants": on_docs(variants.spelling_variants),
        "op13_quality_classifier": lambda spark, sf_dir: linefield.quality_predictions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": lines.LINE_SQL, "op6_url_filter": urls.URL_SQL}
