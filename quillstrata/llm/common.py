"""What the operators of this subpackage share: the word rule, text keys and lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a longest run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

#: Second seed of 128-bit text keys.
_SALT = "\u0001second"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes; together they stand for the text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(_SALT), text)]


def ready_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only where the driver is the whole cluster (local tests) and none is set, make one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillstrata-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: one evaluation, no lineage, safe when executors go."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables of one computation below the shared checkpoint folder, removed together once its result stands.

    While it is used, shuffle files go as soon as the table that needed them is written.
    """

    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        ready_checkpoints(spark)
        self._spark, self._n = spark, 0
        self._folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        self._before = self._spark.conf.get(self._CLEANUP, None)
        self._spark.conf.set(self._CLEANUP, "true")
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """df, evaluated once, written and read again."""
        self._n += 1
        df.write.parquet(f"{self._folder}/{self._n}")
        return self._spark.read.schema(df.schema).parquet(f"{self._folder}/{self._n}")

    def __exit__(self, *_: object) -> None:
        if self._before is None:
            self._spark.conf.unset(self._CLEANUP)
        else:
            self._spark.conf.set(self._CLEANUP, self._before)
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


#: Arrow types by the names that schemas use here.
_ARROW = {"long": "int64", "int": "int32", "string": "string", "boolean": "bool_", "double": "float64", "binary": "binary"}


#: Text that a worker turns into Python objects at a time.
SLICE_BYTES = 2_000_000


def arrow_type(name: str) -> pa.DataType:
    return pa.list_(arrow_type(name[6:-1])) if name.startswith("array<") else getattr(pa, _ARROW[name])()


_KEPT: dict[str, object] = {}


def kept_in_worker(key: str, make: Callable[[], object]) -> object:
    """A table that one operator's tasks share in a worker process, which keeps one table at most."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget_kept() -> None:
    _KEPT.clear()


def give_back() -> None:
    """Return what a task has freed to the system: worker processes live on, and allocators hold it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, between dropping what another operator kept in the worker (unless keeps) and giving memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget_kept()
        yield from run(batches)
        give_back()

    return whole


def with_fields(kept: list[T.StructField], ddl: str) -> T.StructType:
    return T.StructType([*kept, *T.StructType.fromDDL(ddl).fields])


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], Iterable[Sequence]]], fields: dict[str, str], text: str = "text", keeps: bool = False) -> DataFrame:
    """Replace the column named by text by columns made from it, batch by batch; the others pass through as they are.

    make() runs once a task and returns a function from a batch's texts (no nulls) to the new columns. keeps: it uses a
    table of kept_in_worker().
    """
    others = [c for c in df.columns if c != text]
    names, types = [*others, *fields], [arrow_type(t) for t in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        for batch in batches:
            rows = batch.num_rows
            step = max(1, rows * SLICE_BYTES // max(1, batch.column(text).nbytes))
            for at in range(0, rows, step):
                part = batch.slice(at, step)
                new = made(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *(pa.array(x, t) for x, t in zip(new, types, strict=True))], names)

    return df.mapInArrow(lean(run, keeps), with_fields([df.schema[c] for c in others], ", ".join(f"{n} {t}" for n, t in fields.items())))


#: Rows up to which a counted table is broadcast; beyond it Spark picks a shuffled join.
BROADCAST_ROWS = 50_000


def join_counted(left: DataFrame, small: DataFrame, rows: int, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a table whose rows were counted: broadcast it only if they are few."""
    return left.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)
