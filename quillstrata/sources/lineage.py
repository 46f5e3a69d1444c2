"""Tables that loops go on from: written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """The checkpoint folder: that of spark.checkpoint.dir; one is made only where the driver is all there is."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillstrata-"))


def cut(df: DataFrame) -> DataFrame:
    """df, evaluated once and written below the checkpoint folder."""
    ready(df.sparkSession)
    return df.checkpoint()
