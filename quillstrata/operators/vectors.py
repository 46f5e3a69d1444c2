"""Vectors of texts by an injected model, their archive and its checks; a dispatcher for the search modes."""

from __future__ import annotations

import importlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.operators import retrieval
from quillstrata.operators.records import archive_report, word_tokens

Encoder = Callable[[list[str]], np.ndarray]
MOST_TOKENS, BATCH = 2048, 8


def unit_rows(found: np.ndarray) -> np.ndarray:
    """Rows as float32 of length one; zero, non-finite and empty vectors are errors."""
    found = np.asarray(found, dtype=np.float64)
    if found.ndim != 2 or found.shape[1] == 0 or not np.isfinite(found).all():
        raise ValueError("the model gave vectors that are empty or not finite")
    norms = np.linalg.norm(found, axis=1, keepdims=True)
    if (norms == 0).any():
        raise ValueError("the model gave a zero vector")
    return (found / norms).astype(np.float32)


def hashed_words(width: int = 64) -> Encoder:
    """A model that needs no files: signed counts of hashed words, and one fixed component so that no text is zero."""

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width + 1))
        out[:, width] = 1
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % width] += 1 if h >> 31 else -1
        return out

    return model


@dataclass(frozen=True)
class Model:
    """An encoder with the name and revision that an archive states; make builds it once a task."""

    name: str
    make: Callable[[], Encoder]
    revision: str = "unknown"


def model_at(place: str, revision: str | None = None) -> Model:
    """The model that module:function builds; its revision is the function's attribute of that name, if none is given."""
    module, _, name = place.partition(":")
    make = getattr(importlib.import_module(module), name)
    return Model(place, make, revision or str(getattr(make, "revision", None) or "unknown"))


def encoded(rows: DataFrame, key: str, text: str, make: Callable[[], Encoder], batch: int = BATCH, count: Callable[[str], int] = word_tokens, most: int = MOST_TOKENS) -> DataFrame:
    """key, embedding. make builds the model once a task. Texts of more than most tokens fail: none is cut silently."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or make()
            for i in range(0, len(pdf), batch):
                texts = [t or "" for t in pdf[text].iloc[i : i + batch]]
                if over := [t for t in texts if count(t) > most]:
                    raise ValueError(f"a text has {count(over[0])} tokens; at most {most} are encoded")
                yield pd.DataFrame({key: pdf[key].iloc[i : i + batch], "embedding": list(unit_rows(model(texts)))})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def archive_violations(vectors: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """vectors: vec_id, embedding. Rows (rule, n) of what is wrong; expected (vec_id) must be the same set of ids."""
    report = archive_report(vectors).select(
        (F.col("n") == 0).cast("long").alias("empty archive"), F.col("repeated").alias("repeated id"), F.greatest(F.col("widths") - 1, F.lit(0)).alias("differing width"),
        F.col("not_finite").alias("not finite"), F.col("not_unit").alias("not of length one"),
    )
    names = report.columns
    rows = report.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").cast("long").alias("n")) for c in names))).alias("x")).select("x.*")
    blank = vectors.agg(F.count_if(F.coalesce(F.trim(F.col("vec_id").cast("string")) == "", F.lit(True))).alias("n")).select(F.lit("blank id").alias("rule"), "n")
    rows = rows.unionByName(blank)
    if expected is not None:
        pairs = vectors.select("vec_id", F.lit(1).alias("v")).join(expected.select("vec_id", F.lit(1).alias("e")), "vec_id", "full_outer")
        rows = rows.unionByName(pairs.agg(F.count_if(F.col("v").isNull() | F.col("e").isNull()).alias("n")).select(F.lit("ids differ from the records'").alias("rule"), "n"))
    return rows.where("n > 0")


def filtered(records: DataFrame, ticker: str | None = None, record_type: str | None = None) -> Column:
    """The condition for the filters given (none: all rows). Fails where no record satisfies it."""
    condition = F.lit(True)
    if ticker:
        condition = condition & (F.upper("ticker") == ticker.upper())
    if record_type:
        condition = condition & (F.lower("record_type") == record_type.lower())
    if records.where(condition).isEmpty():
        raise ValueError(f"no records for ticker {ticker!r} and type {record_type!r}")
    return condition


def search(mode: str, records: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, limit: int = retrieval.LIMIT, candidates: int = retrieval.CANDIDATES, rrf_k: int = retrieval.RRF_K, where: Column | None = None, index: retrieval.LexicalIndex | None = None) -> DataFrame:
    """dense, bm25 or hybrid. records: doc_id, text and what where names; queries: query_id, text, vector (but for bm25).

    index: the lexical index of the records, if there is one.
    """
    if mode not in ("dense", "bm25", "hybrid") or limit < 1:
        raise ValueError("mode is dense, bm25 or hybrid, and limit at least 1")
    if mode == "bm25":
        return retrieval.bm25_topk(records if index is None else index, queries.select("query_id", "text"), limit, where, records)
    if vectors is None or "vector" not in queries.columns:
        raise ValueError(f"{mode} search needs vectors")
    if mode == "hybrid" and (candidates < limit or rrf_k < 1):
        raise ValueError("candidates must be at least limit, and rrf_k at least 1")
    pool = vectors if where is None else vectors.join(records.where(where).select("doc_id"), "doc_id", "left_semi")
    dense = retrieval.dense_topk(pool, queries.select("query_id", "vector"), limit if mode == "dense" else candidates)
    if mode == "dense":
        return dense
    return retrieval.rrf(dense, retrieval.bm25_topk(records if index is None else index, queries.select("query_id", "text"), candidates, where, records), limit, rrf_k)
