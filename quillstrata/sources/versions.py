"""Tables in versions: readers never see half a table, and no rename is needed, which object stores lack.

A writer puts a table's files into a folder of its own, then makes the next numbered pointer file, which names the folder.
A reader takes the greatest pointer that is whole (it ends with a line feed). A writer that dies leaves files that nothing
points to; one that loses the race for a number takes the next. What a reader has opened stays until it is pruned.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from quillstrata.sources.sinks import _fs

_POINTER = "version-"


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of whole pointers, in order."""
    fs, make = _fs(spark, path)
    if not fs.exists(make(path)):
        return []
    found = []
    for status in fs.listStatus(make(path)):
        name = status.getPath().getName()
        if name.startswith(_POINTER) and name[len(_POINTER) :].isdigit():
            stream = fs.open(status.getPath())
            try:
                said = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if said.endswith("\n"):
                found.append((int(name[len(_POINTER) :]), said.strip()))
    return sorted(found)


def publish(df: DataFrame, path: str, *partition_by: str) -> int:
    """Write df as the newest version of the table at path; its number."""
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
    fs, make = _fs(spark, path)
    n = max((k for k, _ in _pointers(spark, path)), default=0) + 1
    while True:
        try:
            out = fs.create(make(f"{path}/{_POINTER}{n:012d}"), False)
            break
        except Py4JJavaError as taken:
            if "AlreadyExists" not in taken.java_exception.getClass().getName():
                raise
            n += 1
    try:
        out.write(bytearray(f"{folder}\n".encode()))
    finally:
        out.close()
    return n


def versions(spark: SparkSession, path: str) -> list[int]:
    return [n for n, _ in _pointers(spark, path)]


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one of that number."""
    found = dict(_pointers(spark, path))
    n = max(found, default=None) if version is None else version
    if n not in found:
        raise FileNotFoundError(f"{path}: no version {'' if n is None else n}".rstrip())
    return spark.read.parquet(f"{path}/{found[n]}")


def prune(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the newest versions, pointers first; how many went. Files that nothing points to are left to their writers."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    fs, make = _fs(spark, path)
    old = _pointers(spark, path)[:-keep]
    for n, folder in old:
        fs.delete(make(f"{path}/{_POINTER}{n:012d}"), False)
        fs.delete(make(f"{path}/{folder}"), True)
    return len(old)
