"""Labelled rows for training, and probability calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, max_bytes: int) -> list[tuple[str, int]]:
    """At most ``per_class`` labelled texts of each class, not held out, for the driver.

    The rows are those with the smallest hash of their id, so the sample does
    not depend on partitions; texts longer than ``max_bytes`` are not used for
    training (they are scored like all others). The driver holds at most
    2 * per_class * max_bytes bytes. Ids with contradicting labels, null labels
    and null texts are left out; repeated rows count once.
    """
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    rows = rows.where(~held_out(F.col("doc_id")))
    # the ids are chosen before their texts are read; both sides are bounded by per_class from here on
    known = rows.select("doc_id").join(marked, "doc_id").distinct()
    ids: list[tuple[int, int]] = []
    for label in (0, 1):
        ids += [(r["doc_id"], label) for r in known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, label int")
    got = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").collect()  # 2 * per_class rows
    return _ordered(got)


def _ordered(rows) -> list[tuple[str, int]]:
    distinct = {(r["doc_id"], r["text"]): r["label"] for r in rows}
    return [(text, label) for (_, text), label in sorted(distinct.items())]


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps; calibrates scores."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._inputs(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -40, 40)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge * np.eye(len(self.w)), z.T @ (p - y) + ridge * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-9:
                break

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))]

    def shift(self, log_odds: float) -> None:
        """Moves the calibration to another share of both classes."""
        self.w[-1] += log_odds

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._inputs(x) @ self.w, -40, 40)))
