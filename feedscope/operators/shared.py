"""Tables that are read more than once, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return _own[0]


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table: what follows neither makes them twice nor depends on how they were made."""
    path = f"{folder(df.sparkSession)}/feedscope-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
