"""Target-distribution importance resampling: hashed word n-gram weights and a Gumbel top-k draw.

A ring of CRC states reads each document once: at a word, the state of every start among the last n - 1 words is extended
by a space and the word, and the word begins a state of its own; each state is the CRC-32 of one feature. So a document's
features of all lengths come out of one scan, and what is kept of it are the buckets (two bytes a feature), written to the
shared checkpoint folder. Counts and weights both read those.

A bucket's gain compares its smoothed share in the target with that in the corpus; a document's weight sums its features'
gains; its score adds Gumbel noise of its doc_id. Highest scores drawn this way are a sample without replacement by weight.
Ranks come from one range-partitioned sort: a row's place in its partition, and the sizes of the partitions before it.

Null text has no words. A document without features weighs 0 and has noise all the same. A null doc_id is written as the
empty string in the noise and comes last among ties. Rows that repeat a doc_id are documents of their own; ranks of rows
that agree in score and doc_id are dealt in any order. An empty target or corpus counts no features. Every input row gives
one output row.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import cut, lean, map_texts, text_or_empty

ORDER = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = "42"

#: ASCII letters are lower-cased before this; every other ASCII character but letters and digits parts words.
_PARTS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().lower().translate(_PARTS).split()


def ring_buckets(row: list[bytes], order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of 1 to order words, by the run's last word; within one, the shortest run first."""
    out: list[int] = []
    ring: list[int] = []
    crc = zlib.crc32
    for word in row:
        ring = [crc(word), *map(crc, repeat(b" " + word), ring)][:order]
        out += ring
    return (np.array(out, np.uint32) % np.uint32(buckets)).astype(np.uint16)


def bucketed(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """docs with n_words and buckets (two bytes a feature, little-endian) in place of the text."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("a bucket has two bytes")

    def made(texts: list[str]) -> tuple[list[int], list[bytes]]:
        rows = [words(t) for t in texts]
        return [len(r) for r in rows], [ring_buckets(r, order, buckets).tobytes() for r in rows]

    return map_texts(docs.withColumn(text_col, text_or_empty(text_col)), lambda: made, {"n_words": "long", "buckets": "binary"}, text_col)


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket: a task adds up its own, so buckets rows leave it at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for row in b.column("buckets").to_pylist():
                total += np.bincount(np.frombuffer(row, np.uint16), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    counted = features.select("buckets").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for r in counted.collect():  # at most buckets rows, whatever the corpus
        total[r.bucket] = r.n
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel_noise(doc_id: int | None, seed: str = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(features: DataFrame, gains: np.ndarray, seed: str = SEED) -> DataFrame:
    """features with n_features, weight and score in place of buckets."""
    others = [c for c in features.columns if c != "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(x, np.uint16) for x in b.column("buckets").to_pylist()]
            weight = [int(gains[x].sum()) for x in rows]
            score = [w + gumbel_noise(i, seed) for w, i in zip(weight, b.column("doc_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(map(len, rows), pa.int64()), pa.array(weight, pa.int64()), pa.array(score, pa.int64())], [*others, "n_features", "weight", "score"])

    kept = [features.schema[c] for c in others]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return features.mapInArrow(lean(run), f"{schema}, n_features long, weight long, score long")


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored (doc_id, n_words, score and more) with rank: 1, 2, ... for the drawn documents, null for all others.

    Drawn are the percent (floored) of the documents with at least least_words words that score highest.
    """
    can = F.col("n_words") >= least_words
    order = [can.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__row")]
    # __row parts equal keys, so that no range has to hold all rows of one.
    sorted_ = cut(scored.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order))
    # Partition number and place within it; both stay as they are once the rows are written.
    placed = sorted_.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.sum(can.cast("long")).alias("can")).orderBy("part").collect()  # one row a partition
    before, starts = 0, []
    for r in sizes:
        starts.append((r.part, before))
        before += r.rows
    drawn = sum(r.can for r in sizes) * percent // 100
    spark = scored.sparkSession
    offsets = F.broadcast(spark.createDataFrame(starts, "__part long, __before long"))  # one row a partition
    rank = F.col("__before") + F.col("__at") - F.shiftleft("__part", 33) + 1
    joined = placed.withColumn("__part", part).join(offsets, "__part", "left")
    return joined.withColumn("rank", F.when(can & (rank <= drawn), rank)).select(*(F.col(f"`{c}`") for c in scored.columns), "rank")


def resampled(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs (doc_id, text); target has text."""
    features = cut(bucketed(docs.select("doc_id", "text"), order, buckets))
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(bucketed(target.select("text"), order, buckets), buckets))
    return ranked(weighed(features, gains, seed), least_words, percent)


def drawn_documents(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The drawn rows of docs, with its columns, by doc_id; rows that share a drawn doc_id all come."""
    picks = resampled(docs, target, **parameters).where("rank is not null").select("doc_id").distinct()
    return docs.join(picks, docs["doc_id"].eqNullSafe(picks["doc_id"]), "left_semi")


def resample_scores(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
