"""Tables written once in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KNOWN: dict[tuple, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master without it, a folder of this session's own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="dwellscope-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The table written and read again: later steps neither plan nor compute it a second time, and lost executors cost nothing."""
    spark = df.sparkSession
    path = path or f"{shared_root(spark)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, name: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name of this application, made and written at its first use."""
    key = (spark.sparkContext.applicationId, *name)
    if key not in _KNOWN:
        path = f"{shared_root(spark)}/{uuid.uuid4().hex}"
        written(make(), path)
        _KNOWN[key] = path
    return spark.read.parquet(_KNOWN[key])
