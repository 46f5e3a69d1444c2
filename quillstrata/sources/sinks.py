"""Sinks that publish whole outputs: JSON lines, readable JSON, manifests, resumable appends, parts by key, log lines."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    """The file system of a path, whichever it is, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def exists(spark: SparkSession, path: str) -> bool:
    fs, make = _fs(spark, path)
    return fs.exists(make(path))


def published(spark: SparkSession, path: str, write: Callable[[str], None], overwrite: bool) -> None:
    """write(place) writes beside path; only a finished write takes its place, and the old output goes after that."""
    fs, make = _fs(spark, path)
    if fs.exists(make(path)) and not overwrite:
        raise FileExistsError(path)
    new, old = (f"{path.rstrip('/')}.{word}-{uuid.uuid4().hex}" for word in ("new", "old"))
    try:
        write(new)
    except BaseException:
        fs.delete(make(new), True)
        raise
    if fs.exists(make(path)):
        fs.rename(make(path), make(old))
    if not fs.rename(make(new), make(path)):
        fs.rename(make(old), make(path))
        raise OSError(f"{path} could not be replaced")
    fs.delete(make(old), True)


def save(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; a failed overwrite leaves the old output."""
    published(df.sparkSession, path, lambda place: df.write.parquet(place), overwrite)


def not_finite(value: Column, kind: T.DataType) -> Column:
    """Whether a value of that type holds a NaN or an infinite number anywhere."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(value, lambda x: not_finite(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.StructType):
        return F.coalesce(F.reduce(F.array(F.lit(False), *(not_finite(value[f.name], f.dataType) for f in kind.fields)), F.lit(False), lambda a, x: a | x), F.lit(False))
    return F.lit(False)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Compact JSON lines with their nulls. A NaN or infinite number fails the write, and a failed write changes nothing."""
    bad = F.lit(False)
    for f in df.schema.fields:
        bad = bad | not_finite(F.col(f"`{f.name}`"), f.dataType)
    line = F.when(bad, F.raise_error(F.lit("a number is not finite, which JSON cannot say")).cast("string")).otherwise(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}))
    published(df.sparkSession, path, lambda place: df.select(line.alias("value")).write.text(place), overwrite)


def write_bytes(spark: SparkSession, path: str, content: bytes, overwrite: bool = True) -> None:
    """One file from the driver, put in place when whole."""

    def write(place: str) -> None:
        fs, make = _fs(spark, place)
        out = fs.create(make(place))
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    published(spark, path, write, overwrite)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A readable report: two spaces of indent, no NaN, a line end at last."""
    write_bytes(spark, path, (json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False, default=str) + "\n").encode())


#: Rows of a manifest or report that the driver writes as one JSON file.
MOST_ROWS = 100_000


def rows_of(df: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    """The rows as dictionaries, for reports that are one file; more than most are an error."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows is no single file")
    return rows


def write_manifest(df: DataFrame, path: str, *order: str) -> None:
    """A JSON array of the rows in that order."""
    write_json(df.sparkSession, path, rows_of(df.orderBy(*order) if order else df))


def output_digests(spark: SparkSession, *paths: str) -> DataFrame:
    """path, files, bytes, sha256: of each output folder; the digest is that of its files' names and digests in order."""
    out = None
    for path in paths:
        files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha"))
        # A part's name holds a job's random id, so parts go by their number.
        numbered = files.select(F.regexp_extract("name", r"part-(\d+)", 1).alias("part"), "sha", "length")
        one = numbered.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "sha"))), lambda x: F.concat_ws(" ", x["part"], x["sha"])), "\n"), 256).alias("sha256"))
        one = one.select(F.lit(path).alias("path"), "files", "bytes", "sha256")
        out = one if out is None else out.unionByName(one)
    return out


def append_missing(new: DataFrame, path: str, key: str, error: str | None = None, errors: str | None = None) -> int:
    """Resumable append to Parquet: only rows whose key is not there yet. Returns how many were written.

    error: rows where this column is not null are failures; they are appended to the folder errors instead, so the next run
    tries them again. Ids are read from path as columns only.
    """
    spark = new.sparkSession
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    counted = new.persist()
    try:
        good = counted if error is None else counted.where(F.col(error).isNull()).drop(error)
        written = good.count()
        if written:
            good.write.mode("append").parquet(path)
        if error is not None and errors is not None:
            failed = counted.where(F.col(error).isNotNull())
            if not failed.isEmpty():
                failed.write.mode("append").parquet(errors)
        return written
    finally:
        counted.unpersist()


def write_parts(rows: DataFrame, path: str, key: str) -> None:
    """A checkpoint by key: the parts of the keys in rows are replaced, those of other keys stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_part(spark: SparkSession, path: str, key: str, value: str, expected: DataFrame, id_col: str) -> DataFrame | None:
    """The checkpoint of one key, if it is there and holds exactly the expected ids, in their order by pos; else None."""
    if not exists(spark, path):
        return None
    part = spark.read.parquet(path).where(F.col(key) == value)
    wrong = part.select(F.col(id_col), F.col("pos").alias("a")).join(expected.select(F.col(id_col), F.col("pos").alias("b")), id_col, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return part if not part.isEmpty() and wrong.isEmpty() else None


class JsonLines(logging.Formatter):
    """Log records as JSON lines: time, level, logger, message and what extra names under fields."""

    def format(self, record: logging.LogRecord) -> str:
        row = {"timestamp": self.formatTime(record, "%Y-%m-%dT%H:%M:%S%z"), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        row |= getattr(record, "fields", {})
        if record.exc_info:
            row["exception"] = self.formatException(record.exc_info)
        return json.dumps(row, ensure_ascii=False, default=str)


def configure_logging(level: str = "INFO") -> logging.Logger:
    """The package's logger, with one handler of JSON lines however often this is called."""
    log = logging.getLogger("quillstrata")
    log.setLevel(level.upper())
    log.propagate = False
    for old in list(log.handlers):
        log.removeHandler(old)
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines())
    log.addHandler(handler)
    return log
