"""Near-duplicate classes with HyperMinHash sketches, exact in their links.

A document is the set of its distinct word shingles. Its sketch has one
register for each of ROWS * BANDS hash functions: of the smallest hash value
the leading-zero count (6 bits) and the next MANTISSA bits. Bands of ROWS
registers are bucket keys. Documents with equal sets first become one class.
Within a bucket each class is compared with the bucket's smallest and largest
class; the Jaccard estimate from the registers, corrected for registers that
collide by chance, drops unlikely pairs, and the rest is decided on the full
sets. Buckets of four or more classes that are not one component by then are
searched again in blocks: all classes of different components are compared with
each other, in the order of their estimates and on their full sets, until what
is linked is connected. No candidate is lost, and only connecting links leave a
task.

With 30 bands of 4 registers a pair at the threshold 0.8 shares no bucket with
a probability of 0.00000014, and the estimate's margin of 0.2 is over five of
its standard deviations.

Links and set sizes are decided on 64-bit hashes of shingles. Texts of any
length are read whole.

Defined cases: an empty table gives no rows; a null text is the empty text; texts without words have empty
sets and are linked with nothing; with fewer words than a shingle the whole
sequence is the one shingle; repeated rows share a class; a null doc_id has a
null component unless its class has an id; different texts under one id are one
node and may share its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, slices, table, texts, written
from .components import components

SHINGLE, PERCENT = 2, 80
ROWS, BANDS, MANTISSA = 4, 30, 10
#: Below this estimate a pair is not looked at further.
LEAST_ESTIMATE = 0.6
#: Classes of a block when a bucket is searched again.
BLOCK = 2000
#: Bytes of the full sets of a block, on average.
BLOCK_BYTES = 16 << 20

_RNG = np.random.default_rng(20240607)
_XOR = _RNG.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64)[:, None]
_MUL = (_RNG.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1))[:, None]
_BAND_MUL = _RNG.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
#: Shingles hashed against all functions at once.
_STEP = 2048


def shingle_set(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = (out ^ h[j : j + len(out)]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One register (leading zeros and mantissa of the minimum) for each hash function."""
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), _STEP):
            low = np.minimum(low, ((shingles[None, at : at + _STEP] ^ _XOR) * _MUL).min(1))
    bits = np.maximum(low, np.uint64(1)).astype(np.float64).view(np.uint64)  # a double holds exponent and mantissa
    exponent = (bits >> np.uint64(52)) - np.uint64(1023)
    zeros = np.uint64(63) - np.minimum(exponent, np.uint64(63))
    mantissa = bits >> np.uint64(52 - MANTISSA) & np.uint64((1 << MANTISSA) - 1)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def estimates(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers, corrected for chance collisions.

    Two unrelated minima of sets of sizes s and t agree in their leading zeros
    and mantissa with a probability of about 2 s t / (s + t)**2 / 2**MANTISSA
    times 0.7, the collision rate of the exponential minimum in its octave.
    """
    same = (a == b).mean(-1)
    s, t = size_a.astype(np.float64), size_b.astype(np.float64)
    chance = 1.4 * s * t / (s + t) ** 2 / (1 << MANTISSA)
    return (same - chance) / (1 - chance)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary())])
_BAND = pa.schema([("bucket", pa.int64()), ("cid", pa.int64())])
_SET = pa.schema([("cid", pa.int64()), ("members", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sketches(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            sets = [shingle_set(t, n_words) for t in rows["text"]]
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            yield batch_of(
                {
                    "doc_id": rows["doc_id"],
                    "rid": rows["rid"],
                    "n": [len(s) for s in sets],
                    "d1": [signed(d >> 64) for d in digests],
                    "d2": [signed(d & (1 << 64) - 1) for d in digests],
                    "sig": [sketch(s).tobytes() if len(s) else None for s in sets],
                },
                _SKETCH,
            )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        with np.errstate(over="ignore"):
            h = np.full(sigs.shape[:2], 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
            for j in range(ROWS):
                h = (h ^ sigs[:, :, j]) * _BAND_MUL[None, :, j]
                h ^= h >> np.uint64(31)
        cid = np.repeat(batch.column("cid").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(cid)], schema=_BAND)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose estimate is high enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
        keep = estimates(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) >= LEAST_ESTIMATE
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            yield batch_of({"cid": rows["cid"], "members": [shingle_set(t, n_words).tobytes() for t in rows["text"]]}, _SET)

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 64):
            out: dict[str, list] = {"a": [], "b": []}
            for a, b, x, y in zip(rows["a"], rows["b"], rows["set_a"], rows["set_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out["a"].append(a)
                    out["b"].append(b)
            yield batch_of(out, _PAIR)

    return run


def _searcher(percent: int):
    def run(key, held):
        """Links that join components of a bucket's two blocks, each decided on full sets; at most one for each class."""
        sig = np.frombuffer(b"".join(held.column("sig").to_pylist()), np.uint16).reshape(held.num_rows, -1)
        cid, comp, n, block = (held.column(c).to_numpy() for c in ("cid", "comp", "n", "block"))
        sets = [np.frombuffer(m, np.uint64) for m in held.column("members").to_pylist()]
        crossing = key[1].as_py() != key[2].as_py()
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        out: dict[str, list[int]] = {"a": [], "b": []}
        for i in range(held.num_rows):
            fits = (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            other = np.flatnonzero(fits & (block > block[i] if crossing else cid > cid[i]))
            if not len(other):
                continue
            likely = estimates(sig[other], sig[i], n[other], np.full(len(other), n[i]))
            by = np.argsort(-likely)
            for j in other[by[: np.count_nonzero(likely >= LEAST_ESTIMATE)]].tolist():
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x == y:
                    continue  # already connected
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    above[max(x, y)] = min(x, y)
                    out["a"].append(min(int(cid[i]), int(cid[j])))
                    out["b"].append(max(int(cid[i]), int(cid[j])))
        return pa.table(out, schema=_PAIR)

    return run


def _class_sets(rows: DataFrame, ids: DataFrame, n_words: int) -> DataFrame:
    """(cid, members) of the classes named by ``ids`` (doc_id); only their texts are read again."""
    sets = rows.join(ids.hint("shuffle_hash"), "doc_id").select(F.col("doc_id").alias("cid"), "text").mapInArrow(_sets(n_words), "cid long, members binary")
    return written(rows.sparkSession, sets.dropDuplicates(["cid", "members"]))


def _verified(rows: DataFrame, pairs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets."""
    sets = _class_sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), n_words)
    one = sets.select(F.col("cid").alias("a"), F.col("members").alias("set_a"))
    two = sets.select(F.col("cid").alias("b"), F.col("members").alias("set_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, rid (xxhash64 of the text) for each row of ``docs``."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    sketches = written(spark, rows.withColumn("rid", F.xxhash64("text")).mapInArrow(_sketches(n_words), "doc_id long, rid long, n long, d1 long, d2 long, sig binary"))
    classes = written(spark, sketches.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("cid"), F.first("sig").alias("sig")).where("cid is not null"))
    bands = classes.select("cid", "sig").mapInArrow(_bands, "bucket long, cid long")
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("low"), F.max("cid").alias("high")).where("low <> high")
    shared = written(spark, bands.join(buckets, "bucket"))
    pairs = shared.select("cid", F.explode(F.array("low", "high")).alias("c")).where("cid <> c").select(F.least("cid", "c").alias("a"), F.greatest("cid", "c").alias("b")).distinct()
    sig = classes.select("cid", "n", "sig")
    side = {x: sig.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab"}
    likely = written(spark, pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(_likely, "a long, b long"))
    links = written(spark, _verified(rows, likely, n_words, percent))
    found = written(spark, components(links))
    # buckets of four or more classes that are still several components
    large = shared.where("size > 3").select("bucket", "cid", "size").join(found.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", "size", F.coalesce("component", "cid").alias("comp"))
    large = written(spark, large.join(classes.select("cid", "n"), "cid"))
    split = large.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum("n").alias("total")).where("x <> y").select("bucket", "total")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") * 8 / BLOCK_BYTES)).cast("int")
    open_ = written(spark, large.join(split, "bucket"))
    if open_.limit(1).count():
        sets = _class_sets(rows, open_.select(F.col("cid").alias("doc_id")).distinct(), n_words)
        held = open_.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        held = held.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).join(sig.drop("n"), "cid").join(sets, "cid")
        more = held.select("bucket", "i", "j", "block", "cid", "comp", "n", "sig", "members").groupBy("bucket", "i", "j").applyInArrow(_searcher(percent), "a long, b long")
        links = written(spark, links.unionByName(more.distinct()))
        found = written(spark, components(links))
    named = classes.select("n", "d1", "d2", "cid").join(found.withColumnRenamed("node", "cid"), "cid", "left").select("n", "d1", "d2", F.coalesce("component", "cid").alias("class_comp"))
    out = sketches.select("doc_id", "rid", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left").withColumn("component_id", F.coalesce("class_comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "rid")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("rid")
