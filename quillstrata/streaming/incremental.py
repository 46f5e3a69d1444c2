"""Incremental intake: rows of a stream whose key is not in the table yet are appended, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillstrata.sources.sinks import append_missing


def append_stream(rows: DataFrame, path: str, key: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """rows: a streaming DataFrame. A batch that is run again after a failure adds nothing twice; once: stop when caught up."""

    def add(batch: DataFrame, _: int) -> None:
        append_missing(batch.dropDuplicates([key]), path, key)

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
