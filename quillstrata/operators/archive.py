"""Embedding archives: vectors in a stated order with where they come from, checked as they are read; their manifest.

An archive is a folder: vectors (pos long, record_id string, embedding array<float>) as Parquet, and provenance, one JSON
line with model_name, model_revision and input_sha256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillstrata.operators.corpus import require_none
from quillstrata.operators.digests import same_order
from quillstrata.operators.vectors import archive_violations
from quillstrata.sources import sinks
from quillstrata.sources.files import read_jsonl

FIELDS = ("model_name", "model_revision", "input_sha256")
SHA256 = "^[0-9a-f]{64}$"


def _blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


def order_violations(vectors: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows (rule, n): ids of either side alone, and ids at another place; both: record_id, pos.

    Sides of equal digests agree, which takes one aggregate each; only others are joined to tell what is wrong.
    """
    placed = lambda rows: rows.select("record_id", F.coalesce("pos", F.lit(-1)).alias("pos"))
    if same_order(placed(vectors), placed(expected), "pos", "record_id"):
        return vectors.sparkSession.createDataFrame([], "rule string, n long")
    pairs = vectors.select("record_id", F.col("pos").alias("a")).join(expected.select("record_id", F.col("pos").alias("b")), "record_id", "full_outer")
    counts = pairs.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("alone"), F.count_if(F.col("a") != F.col("b")).alias("moved"))
    return counts.select(F.explode(F.array(F.struct(F.lit("ids differ from the records'").alias("rule"), F.col("alone").alias("n")), F.struct(F.lit("ids in another order").alias("rule"), F.col("moved").alias("n")))).alias("x")).select("x.*").where("n > 0")


def provenance_violations(provenance: DataFrame) -> DataFrame:
    """Rows (rule, n); provenance must be one row with no blank field and a lower-case SHA-256."""
    one = provenance.agg(F.count("*").alias("rows"), *(F.count_if(_blank(F.col(c))).alias(c) for c in FIELDS), F.count_if(~_blank(F.col("input_sha256")) & ~F.col("input_sha256").rlike(SHA256)).alias("sha"))
    rules = [F.struct(F.lit("provenance is not one row").alias("rule"), (F.col("rows") != 1).cast("long").alias("n")), *(F.struct(F.lit(f"blank {c}").alias("rule"), F.col(c).alias("n")) for c in FIELDS), F.struct(F.lit("bad input_sha256").alias("rule"), F.col("sha").alias("n"))]
    return one.select(F.explode(F.array(*rules)).alias("x")).select("x.*").where("n > 0")


def violations(vectors: DataFrame, provenance: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Rows (rule, n) of all that is wrong with an archive; expected: record_id, pos of the records."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    found = archive_violations(vectors.select(F.col("record_id").alias("vec_id"), "embedding")).unionByName(provenance_violations(provenance))
    if kind != "array<float>":
        found = found.unionByName(vectors.sparkSession.range(1).select(F.lit(f"components are {kind}").alias("rule"), F.lit(1).cast("long").alias("n")))
    return found if expected is None else found.unionByName(order_violations(vectors, expected))


def save_archive(vectors: DataFrame, path: str, model_name: str, model_revision: str, input_sha256: str, overwrite: bool = False) -> None:
    """Written beside path, checked, and put in place whole; a fault leaves what was there."""
    spark = vectors.sparkSession
    origin = spark.createDataFrame([(model_name, model_revision, input_sha256)], ", ".join(f"{c} string" for c in FIELDS))

    def write(place: str) -> None:
        vectors.select("pos", "record_id", "embedding").write.parquet(f"{place}/vectors")
        origin.coalesce(1).write.json(f"{place}/provenance")
        load_archive(spark, place)

    sinks.published(spark, path, write, overwrite)


def load_archive(spark: SparkSession, path: str, expected: DataFrame | None = None) -> tuple[DataFrame, Row]:
    """(vectors, provenance) of a sound archive; anything wrong is an error."""
    vectors = spark.read.parquet(f"{path}/vectors")
    origin = read_jsonl(spark, f"{path}/provenance", ", ".join(f"{c} string" for c in FIELDS))
    require_none(violations(vectors, origin, expected).select("rule", F.col("n").alias("key")))
    return vectors, origin.first()


def revision_warning(provenance: Row) -> str | None:
    """What a report says where the model's revision is not known."""
    return "model_revision is unknown, so the model cannot be told exactly" if provenance["model_revision"].strip().lower() == "unknown" else None


def corpus_counts(records: DataFrame, proxies: DataFrame) -> dict:
    """Counts of an embedding corpus by type, ticker and both, and of its proxies by version.

    records: record_id, record_type, target_chunk_id, ticker; proxies: proxy_version.
    """
    total = records.agg(F.count("*").alias("records"), F.count_distinct("record_id").alias("ids"), F.count_distinct("target_chunk_id").alias("targets")).first()
    cells = records.groupingSets([["record_type"], ["ticker"], ["ticker", "record_type"]], "ticker", "record_type").agg(F.count("*").alias("n"), F.grouping_id("ticker", "record_type").alias("level")).collect()
    by_type = {r["record_type"]: r["n"] for r in cells if r["level"] == 2}
    by_ticker = {r["ticker"]: r["n"] for r in cells if r["level"] == 1}
    both: dict[str, dict[str, int]] = {}
    for r in sorted((r for r in cells if r["level"] == 0), key=str):
        both.setdefault(r["ticker"], {})[r["record_type"]] = r["n"]
    versions = {r[0]: r[1] for r in proxies.groupBy(F.coalesce("proxy_version", F.lit("missing"))).count().collect()}
    return {
        "embedding_record_count": total["records"], "unique_record_id_count": total["ids"], "unique_target_chunk_id_count": total["targets"],
        "record_type_counts": dict(sorted(by_type.items())), "ticker_counts": dict(sorted(by_ticker.items())), "ticker_type_counts": dict(sorted(both.items())), "proxy_version_counts": dict(sorted(versions.items())),
    }


def norm_range(vectors: DataFrame) -> DataFrame:
    """count, dimension, minimum_norm, maximum_norm."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.agg(F.count("*").alias("count"), F.max(F.size("embedding")).alias("dimension"), F.min(norm).alias("minimum_norm"), F.max(norm).alias("maximum_norm"))


def manifest_violations(records: DataFrame, proxies: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows (rule, n): records, proxies and vectors that don't fit together. records: record_id, pos, record_type, target_chunk_id."""
    named = vectors.select(F.col("record_id").alias("vec_id"), "embedding")
    ids = records.agg((F.count("record_id") - F.count_distinct("record_id")).alias("a"), (F.count("target_chunk_id") - F.count_distinct("target_chunk_id")).alias("b"), F.count_if(F.col("record_type") == "table").alias("t"))
    tables = ids.crossJoin(proxies.agg(F.count("*").alias("p")))  # one row each
    rules = F.array(F.struct(F.lit("repeated record id").alias("rule"), F.col("a").alias("n")), F.struct(F.lit("repeated target").alias("rule"), F.col("b").alias("n")), F.struct(F.lit("tables and proxies differ in number").alias("rule"), F.abs(F.col("t") - F.col("p")).alias("n")))
    return archive_violations(named).unionByName(order_violations(vectors, records)).unionByName(tables.select(F.explode(rules).alias("x")).select("x.*").where("n > 0"))


def embedding_manifest(spark: SparkSession, records_path: str, proxies_path: str, archive_path: str) -> dict:
    """What an embedding corpus holds, where it lies and what its files' digests are; parts that don't fit are an error."""
    records, proxies = spark.read.parquet(records_path), spark.read.parquet(proxies_path)
    vectors, origin = load_archive(spark, archive_path)
    require_none(manifest_violations(records, proxies, vectors).select("rule", F.col("n").alias("key")))
    files = {r["path"]: {"size_bytes": r["bytes"], "sha256": r["sha256"]} for r in sinks.output_digests(spark, records_path, proxies_path, f"{archive_path}/vectors").collect()}
    return {"artifacts": files, "corpus": corpus_counts(records, proxies), "embedding_model": {c: origin[c] for c in FIELDS}, "embedding_matrix": norm_range(vectors).first().asDict()}
