"""Quality score by compression against good and bad text.

Two zstandard dictionaries are trained, on labelled good and on labelled bad
text. A text is compressed under each of them, whole and in blocks. The
differences of the sizes, divided by the text's size (of the whole, and the
least and the mean of its blocks), go through a logistic calibration fitted on
labelled texts that the dictionaries have not seen, and moved to the shares of
both labels in the table, from which the sample takes at most ``per_class`` each.

Defined cases: an empty table gives no rows; null and empty texts get the score
of empty input; texts of any length are compressed whole, block by block; ties
do not occur, as rows are scored apart; with no labelled rows of one class
every score is the share of good labels (0.5 without any); repeated rows are
each scored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, slices, table, texts
from .labelled import Logistic, held_out, training_rows

#: Bounds of the training sample (rows of each class, bytes of a text).
PER_CLASS, MAX_BYTES = 1500, 1 << 15
DICTIONARY_BYTES = 100 << 10
BLOCK = 2048
LEVEL = 3
THRESHOLD = 0.7


def _dictionary(data: list[bytes]) -> bytes:
    """A trained dictionary; the text itself where there is too little to train on."""
    parts = [x[i : i + 1024] for x in data for i in range(0, len(x), 1024) if len(x[i : i + 1024]) >= 16]
    random.Random(0).shuffle(parts)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:] or b"\n" * 16


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}

        def of(data: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, **plain)

        self.good, self.bad = of(good), of(bad)

    def difference(self, data: bytes) -> float:
        """Bytes that the good dictionary saves over the bad one, per byte of text."""
        return (len(self.bad.compress(data)) - len(self.good.compress(data))) / (len(data) + 16)

    def features(self, data: bytes) -> list[float]:
        whole = self.difference(data)
        blocks = [self.difference(data[i : i + BLOCK]) for i in range(0, len(data), BLOCK)] if len(data) > BLOCK else [whole]
        return [whole, min(blocks), sum(blocks) / len(blocks)]


def fit(rows: list[tuple[str, int]], odds: float | None = None) -> tuple[bytes, bytes, Logistic] | float:
    """Dictionaries and calibration, or a constant score if a class has fewer than two rows. ``odds``: good to bad among all labels."""
    share = sum(y for _, y in rows) / len(rows) if rows else 0.5
    of = {y: [t.encode("utf-8", "surrogatepass") for t, q in rows if q == y] for y in (0, 1)}
    if min(map(len, of.values())) < 2:
        return share
    good, bad = _dictionary(of[1][::2]), _dictionary(of[0][::2])
    comp = Compressors(good, bad)
    x = np.array([comp.features(d) for y in (0, 1) for d in of[y][1::2]])
    y = np.concatenate([np.full(len(of[q][1::2]), q) for q in (0, 1)])
    calibration = Logistic(x, y)
    if odds:
        calibration.shift(np.log(odds * max((y == 0).sum(), 1) / max((y == 1).sum(), 1)))
    return good, bad, calibration


_SCORE = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("score", pa.float64())])


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        comp = None if isinstance(model, float) else Compressors(*model[:2])
        for rows in slices(batches):
            if comp is None:
                scores = [model] * len(rows["text"])
            else:
                scores = model[2](np.array([comp.features(t.encode("utf-8", "surrogatepass")) for t in rows["text"]])).tolist()
            yield batch_of({"doc_id": rows["doc_id"], "rid": rows["rid"], "score": scores}, _SCORE)

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, to_score: DataFrame | None = None, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, rid (xxhash64 of the text), score for each row of ``to_score`` (``docs`` unless given); learnt from ``docs`` with ``labels``."""
    seen = {r[0]: r[1] for r in labels.where(~held_out(labels["doc_id"])).groupBy(labels["quality"].cast("int").alias("q")).count().collect()}
    odds = seen.get(1, 0) / seen[0] if seen.get(0) else None
    model = fit(training_rows(docs, labels, "quality", per_class, max_bytes), odds)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries
    rows = texts(docs if to_score is None else to_score).withColumn("rid", F.xxhash64("text"))
    return rows.mapInArrow(_scorer(shared), "doc_id long, rid long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
