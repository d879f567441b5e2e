"""Shared helpers of the training-data operators.

Every operator reads only the columns it names (an id and a text column), so
extra columns of the input, whatever their names, never reach a plan.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python operator turns into Python objects at once.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string); a null text counts as empty, a null id stays null."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    )


def lower_az(col):
    """Lower-case A-Z only, on the JVM."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    Where ``spark.checkpoint.dir`` is unset, a temporary folder is made and set
    for this session on a local master; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_dir(spark)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="dwellscope-"))
        known = sc.getCheckpointDir()
    return known


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it: cuts lineage and survives lost executors."""
    path = shared_dir(spark)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Keys that hold over one part in HEAVY of all rows are spread; there are at most HEAVY of them.
HEAVY = 10_000
#: A spread key's rows are dealt so that a share holds about one part in SHARES of all rows.
SHARES = 1_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right on ``keys``; the rows of frequent keys of ``left`` are dealt over several tasks.

    ``right`` has few rows for a key. ``counts`` holds the keys, or some of them,
    and ``n``, the rows of ``left`` that have them. Keys with more than one part in HEAVY of
    the sum of ``n`` (at most HEAVY keys, so their broadcast is bounded) get
    shares; their rows of ``right`` are repeated for each share. ``left`` must
    come in a fixed order (a scan and maps), as a row's place gives its share.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    shares = F.least(F.ceil(F.col("n") * SHARES / F.lit(max(total, 1))), F.col("n")).cast("int")
    known = [k for k in keys if k in counts.columns]
    heavy = F.broadcast(counts.where(F.col("n") * HEAVY > total).select(*[F.col(k).alias(f"__{k}") for k in known], shares.alias("__shares")))

    def marked(df: DataFrame) -> DataFrame:
        on = [df[k].eqNullSafe(heavy[f"__{k}"]) for k in known]
        return df.join(heavy, on, "left").drop(*[f"__{k}" for k in known]).withColumn("__shares", F.coalesce("__shares", F.lit(1)))

    dealt = marked(left.withColumn("__place", F.monotonically_increasing_id())).withColumn("__share", F.pmod("__place", "__shares").cast("int")).drop("__place", "__shares")
    copies = marked(right).withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).drop("__shares")
    return dealt.join(copies, [*keys, "__share"], how).drop("__share")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[dict[str, list]]:
    """Python lists of at most ``rows`` rows, so that a batch of long texts stays bounded; free memory goes back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pydict()
    release_memory()


def release_memory() -> None:
    """Give the worker's free memory back to the system; Spark keeps idle workers between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def batch_of(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
