"""Exact duplicate removal with composable polynomial fingerprints.

A text is lower-cased (A-Z only), cut into byte chunks, and each chunk gets a
polynomial hash in two prime fields. Chunk hashes combine by length-shifted
arithmetic, H(AB) = H(A) * b**len(B) + H(B), so chunks of one huge text can be
hashed anywhere and in any order: the chunks of a text of more than ``huge``
bytes are dealt over all tasks and their hashes combined after. Rows with equal
(fingerprint, length) are then compared with one reference row of their group,
chunk by chunk; a group in which a chunk differs is split by the strong digest.
Rows of large groups are dealt over tasks.

Defined cases: a null text is the empty text; empty texts equal each other;
a null doc_id loses against any other and, alone, is kept; repeated rows
(same doc_id, equal text) count in group_size and share the decision of their
doc_id. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, lower_az, slices, spread_join, table, texts, written

#: Bytes of a chunk; 255 * 2**31 * CHUNK stays below 2**63.
CHUNK = 1 << 16
#: (prime, base) of the two fields.
FIELDS = ((2147483647, 1000003), (2147483629, 911382323))
#: Texts of more bytes are hashed in parallel.
HUGE = 32 << 20


@lru_cache
def _powers(prime: int, base: int) -> np.ndarray:
    """base**(CHUNK-1) .. base**0 modulo prime, by doubling."""
    out = np.ones(CHUNK, dtype=np.uint64)
    filled = 1
    while filled < CHUNK:
        out[filled : 2 * filled] = out[:filled] * pow(base, filled, prime) % prime
        filled *= 2
    return out[::-1].copy()


def chunk_hash(data: bytes, fields=FIELDS) -> tuple[int, int]:
    """Hash of one chunk (at most CHUNK bytes) in both fields."""
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    return tuple(int(np.dot(a, _powers(*f)[CHUNK - len(a) :])) % f[0] for f in fields)


def combine(left: tuple[int, int], right: tuple[int, int], right_len: int, fields=FIELDS) -> tuple[int, int]:
    """Hash of a concatenation from the hashes of its parts."""
    return tuple((x * pow(b, right_len, p) + y) % p for x, y, (p, b) in zip(left, right, fields, strict=True))


def fingerprint(data: bytes, fields=FIELDS) -> int:
    """62-bit fingerprint of a byte string, chunk by chunk."""
    total = (0, 0)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        total = combine(total, chunk_hash(part, fields), len(part), fields)
    return total[0] << 31 | total[1]


_PRINTS = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("fp", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string())])
_CHUNKS = pa.schema([("fp", pa.int64()), ("n_bytes", pa.int64()), ("is_ref", pa.bool_()), ("no", pa.int32()), ("part", pa.binary())])


def _prints(huge: int, fields):
    """Fingerprint (null for huge texts), length and digest of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            norm = [t.encode("utf-8", "surrogatepass").lower() for t in rows["text"]]
            yield batch_of(
                {
                    "doc_id": rows["doc_id"],
                    "rid": rows["rid"],
                    "fp": [fingerprint(x, fields) if len(x) <= huge else None for x in norm],
                    "n_bytes": [len(x) for x in norm],
                    "text_sha256": [hashlib.sha256(x).hexdigest() for x in norm],
                },
                _PRINTS,
            )

    return run


_PART = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("text_sha256", pa.string()), ("n_bytes", pa.int64()), ("row", pa.int64()), ("no", pa.int32()), ("size", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _part_hashes(fields):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 64):
            part = rows.pop("part")
            both = [chunk_hash(x, fields) for x in part]
            yield batch_of(rows | {"size": list(map(len, part)), "h1": [h[0] for h in both], "h2": [h[1] for h in both]}, _PART)

    return run


def _whole_hashes(fields):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 16):
            rows["fp"] = []
            for parts in rows.pop("parts"):
                total = (0, 0)
                for x in sorted(parts, key=lambda x: x["no"]):
                    total = combine(total, (x["h1"], x["h2"]), x["size"], fields)
                rows["fp"].append(total[0] << 31 | total[1])
            yield batch_of(rows, _PRINTS)

    return run


def _huge_prints(rows: DataFrame, huge: int, fields) -> DataFrame:
    """_prints of the huge texts: their chunks are hashed by all tasks, the hashes (16 bytes for each chunk) meet again."""
    norm = rows.where(F.octet_length("text") > huge).select("doc_id", "rid", lower_az(F.col("text")).alias("norm")).select("doc_id", "rid", F.sha2("norm", 256).alias("text_sha256"), F.col("norm").cast("binary").alias("norm"))
    norm = norm.withColumn("n_bytes", F.octet_length("norm").cast("long")).withColumn("row", F.monotonically_increasing_id())
    chunks = norm.withColumn("no", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_bytes") / CHUNK).cast("int") - 1)))
    chunks = chunks.select("doc_id", "rid", "text_sha256", "n_bytes", "row", "no", F.substring("norm", F.col("no") * CHUNK + 1, F.lit(CHUNK)).alias("part")).repartition("row", "no")
    hashes = chunks.mapInArrow(_part_hashes(fields), "doc_id long, rid long, text_sha256 string, n_bytes long, row long, no int, size int, h1 long, h2 long")
    whole = hashes.groupBy("doc_id", "rid", "text_sha256", "n_bytes", "row").agg(F.collect_list(F.struct("no", "size", "h1", "h2")).alias("parts")).drop("row")
    return whole.mapInArrow(_whole_hashes(fields), "doc_id long, rid long, fp long, n_bytes long, text_sha256 string")


_NORM = pa.schema([("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("norm", pa.binary())])


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches):
        norm = [t.encode("utf-8", "surrogatepass").lower() for t in rows["text"]]
        yield batch_of({"n_bytes": list(map(len, norm)), "text_sha256": [hashlib.sha256(x).hexdigest() for x in norm], "norm": norm}, _NORM)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk, so that no comparison holds two whole huge texts."""
    for rows in slices(batches, 32):
        out: dict[str, list] = {f.name: [] for f in _CHUNKS}
        for is_ref, fp, n, norm in zip(rows["is_ref"], rows["fp"], rows["n_bytes"], rows["norm"], strict=True):
            for no, at in enumerate(range(0, n, CHUNK)):
                for k, v in (("fp", fp), ("n_bytes", n), ("is_ref", is_ref), ("no", no), ("part", norm[at : at + CHUNK])):
                    out[k].append(v)
        yield batch_of(out, _CHUNKS)


def collided_groups(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(fp, n_bytes) of the groups of several rows in which some text differs from the reference text.

    Rows of ``docs`` find their entry of ``prints`` (fp, n_bytes, text_sha256)
    by length and digest; what decides is the comparison of their bytes with
    the bytes of the group's reference, the text with the smallest digest.
    """
    spark = docs.sparkSession
    several = written(spark, prints.groupBy("fp", "n_bytes").agg(F.min("text_sha256").alias("ref"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    entries = prints.groupBy("fp", "n_bytes", "text_sha256").agg(F.count(F.lit(1)).alias("rows")).join(several, ["fp", "n_bytes"])
    entries = written(spark, entries.select("fp", "n_bytes", "text_sha256", (F.col("text_sha256") == F.col("ref")).alias("is_ref"), F.col("rows").alias("n")))
    carried = docs.select("text").mapInArrow(_norms, "n_bytes long, text_sha256 string, norm binary")
    members = spread_join(carried, entries.drop("n").hint("shuffle_hash"), ["n_bytes", "text_sha256"], entries.select("n_bytes", "text_sha256", "n"))
    parts = written(spark, members.select("fp", "n_bytes", "is_ref", "norm").mapInArrow(_chunks, "fp long, n_bytes long, is_ref boolean, no int, part binary"))
    ref = written(spark, parts.where("is_ref").dropDuplicates(["fp", "n_bytes", "no"]).select("fp", "n_bytes", "no", F.col("part").alias("ref_part")))
    return spread_join(parts, ref, ["fp", "n_bytes", "no"], several.select("fp", "n_bytes", "n")).where("part <> ref_part").select("fp", "n_bytes").distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE, fields=FIELDS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, rid (xxhash64 of the text) for each row of ``docs``."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("rid", F.xxhash64("text"))
    prints = written(spark, rows.mapInArrow(_prints(huge, fields), "doc_id long, rid long, fp long, n_bytes long, text_sha256 string"))
    if not prints.where("fp is null").isEmpty():
        prints = written(spark, prints.where("fp is not null").unionByName(_huge_prints(rows, huge, fields)))
    bad = written(spark, collided_groups(rows, prints))
    keyed = prints.withColumn("sub", F.lit(""))
    if not bad.isEmpty():
        split = prints.join(bad.withColumn("bad", F.lit(True)), ["fp", "n_bytes"], "left")
        keyed = written(spark, split.withColumn("sub", F.when(F.col("bad"), F.col("text_sha256")).otherwise("")).drop("bad"))
    groups = keyed.groupBy("fp", "n_bytes", "sub").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = spread_join(keyed, groups, ["fp", "n_bytes", "sub"], groups.withColumnRenamed("group_size", "n").drop("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "rid")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("rid")


OP6_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
