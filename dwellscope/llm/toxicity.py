"""Toxicity score from subword-bag embeddings and a linear softmax.

The words of a text, each at its first place only, are bags of byte n-grams (with a blank on each side), n-grams are hashed
to rows of an embedding table, and the vectors of all n-grams of a short
passage are averaged, word by word, into a linear softmax over two classes.
Table and softmax are trained jointly in numpy from document labels: a
document's logit is the soft maximum over its passages, so a few words count in
a long text. Misspellings share most n-grams with the words they distort.

The average over a whole text instead of passages finds under half of the toxic
documents (README), as few words among many carry the label.

After training, embedding and softmax collapse to one number for each table
row, and whole texts are scored with array operations only.

Defined cases: an empty table gives no rows; texts of any length are read whole;
null, empty and wordless texts get the score of one passage
without n-grams; with no labelled rows of one class every score is the share
of label 1 (0 without any); repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, slices, table, texts
from .labelled import Logistic, held_out, training_rows

#: Bounds of the training sample (rows of each class, bytes of a text).
PER_CLASS, MAX_BYTES = 1500, 1 << 15
SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIM = 4
#: Words of a passage.
PASSAGE = 3
EPOCHS, RATE, DECAY = 60, 0.01, 2e-6
THRESHOLD = 0.3

_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_buffer(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, each word once a text, one blank before each and one at the end; and their number in each text."""
    split = [list(dict.fromkeys(t.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())) for t in docs]
    counts = np.array([len(s) for s in split], dtype=np.int64)
    data = b" " + b"".join(w + b" " for s in split for w in s)
    return np.frombuffer(data, dtype=np.uint8), counts


def ngrams(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, table row) of every n-gram, blanks at an end only; in no special order."""
    blank = buffer == 32
    word = np.cumsum(blank) - 1  # a word's blank in front has the word's number
    inner = np.concatenate(([0], np.cumsum(blank)))
    codes = buffer.astype(np.uint64)
    owners, rows = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            size = len(buffer) - n + 1
            if size <= 0:
                continue
            h = np.full(size, n, dtype=np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + codes[j : j + size]
            h *= np.uint64(0x9E3779B97F4A7C15)
            whole = inner[n - 1 : n - 1 + size] - inner[1 : 1 + size] == 0  # no blank strictly inside
            owners.append(word[:size][whole])
            rows.append((h[whole] >> np.uint64(47)).astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(rows)


def _word_means(buffer: np.ndarray, n_words: int, value: np.ndarray) -> np.ndarray:
    """Mean of the n-gram values of each word; 0 for a word without n-grams."""
    owner, row = ngrams(buffer)
    sums = np.bincount(owner, value[row], n_words)[:n_words]
    return sums / np.maximum(np.bincount(owner, minlength=n_words)[:n_words], 1)


def _passages(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage number of each word, words of each passage, text of each passage (at least one a text)."""
    per = np.maximum(1, -(-counts // PASSAGE))
    first = np.cumsum(per) - per
    begin = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    passage = first[doc] + (np.arange(counts.sum()) - begin[doc]) // PASSAGE
    return passage, np.bincount(passage, minlength=per.sum()), np.repeat(np.arange(len(counts)), per)


def _pooled(z: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Soft maximum of each text's passage logits, and each passage's share in it."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, text_of, z)
    e = np.exp(z - top[text_of])
    total = np.bincount(text_of, e, n)
    return top + np.log(total / np.bincount(text_of, minlength=n)), e / total[text_of]


class Model:
    """value: one logit for each table row; calibration: of (soft maximum, maximum, mean of passage logits)."""

    def __init__(self, rows: list[tuple[str, int]]):
        labels = np.array([y for _, y in rows], dtype=np.float64)
        fit_on = np.arange(len(rows)) % 3 != 2
        self.value = self._train([t for (t, _), f in zip(rows, fit_on, strict=True) if f], labels[fit_on])
        rest = [t for (t, _), f in zip(rows, fit_on, strict=True) if not f]
        self.calibration = Logistic(self.features(rest), labels[~fit_on])

    @staticmethod
    def _train(docs: list[str], labels: np.ndarray) -> np.ndarray:
        buffer, counts = word_buffer(docs)
        n_words = int(counts.sum())
        words, ids = np.unique(np.array(buffer.tobytes().split(), dtype=object), return_inverse=True) if n_words else (np.array([], dtype=object), np.zeros(0, np.int64))
        owner, row = ngrams(np.frombuffer(b" " + b"".join(w + b" " for w in words), dtype=np.uint8))
        per_word = np.maximum(np.bincount(owner, minlength=len(words))[: len(words)], 1)
        passage, size, text_of = _passages(counts)
        share = 1 / np.maximum(size, 1)
        rng = np.random.default_rng(0)
        table_ = rng.normal(0, 0.01, (BUCKETS, DIM))
        soft = rng.normal(0, 0.5, (DIM, 2))
        state = [np.zeros_like(p) for p in (table_, soft)]
        weight = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
        bias = 0.0
        for epoch in range(1, EPOCHS + 1):
            word_vec = np.stack([np.bincount(owner, table_[row, d], len(words))[: len(words)] / per_word for d in range(DIM)], 1)
            pas_vec = np.stack([np.bincount(passage, word_vec[ids, d], len(size)) * share for d in range(DIM)], 1)
            direction = soft[:, 1] - soft[:, 0]  # softmax over two classes: the logit is the difference
            z = PASSAGE * (pas_vec @ direction)
            pooled, part = _pooled(z, text_of, len(docs))
            p = 1 / (1 + np.exp(-np.clip(pooled + bias, -30, 30)))
            g_doc = weight * (p - labels)
            bias -= RATE * 4 * g_doc.sum()
            g_z = PASSAGE * g_doc[text_of] * part
            g_dir = pas_vec.T @ g_z
            g_word = np.bincount(ids, (g_z * share)[passage], len(words)) / per_word
            g_row = np.bincount(row, g_word[owner], BUCKETS)
            grads = (g_row[:, None] * direction + DECAY * table_, np.stack([-g_dir, g_dir], 1))
            for param, grad, s in zip((table_, soft), grads, state, strict=True):
                # one step size for all rows of a table: n-grams of many texts move far, rare ones hardly
                s += 0.2 * (grad - s)
                param -= RATE * np.sqrt(grad.shape[0]) * s / (np.linalg.norm(s) + 1e-9)
        return (table_ @ (soft[:, 1] - soft[:, 0])).astype(np.float32)

    def features(self, docs: list[str]) -> np.ndarray:
        buffer, counts = word_buffer(docs)
        logits = _word_means(buffer, int(counts.sum()), self.value)
        passage, size, text_of = _passages(counts)
        z = PASSAGE * np.bincount(passage, logits, len(size)) / np.maximum(size, 1)
        pooled, _ = _pooled(z, text_of, len(docs))
        top = np.full(len(docs), -np.inf)
        np.maximum.at(top, text_of, z)
        mean = np.bincount(text_of, z, len(docs)) / np.bincount(text_of, minlength=len(docs))
        return np.stack([pooled, top, mean], 1)

    def scores(self, docs: list[str]) -> np.ndarray:
        return self.calibration(self.features(docs))


def fit(rows: list[tuple[str, int]]) -> Model | float:
    """A model, or a constant score if a class has fewer than six rows."""
    labels = [y for _, y in rows]
    if min(labels.count(0), labels.count(1)) < 6:
        return sum(labels) / len(labels) if labels else 0.0
    return Model(rows)


_SCORE = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows in slices(batches, 64):
            scores = [model] * len(rows["text"]) if isinstance(model, float) else model.scores(rows["text"]).tolist()
            yield batch_of({"doc_id": rows["doc_id"], "score": scores}, _SCORE)

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, to_score: DataFrame | None = None, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, score for each row of ``to_score`` (``docs`` unless given); learnt from ``docs`` with ``labels``."""
    model = fit(training_rows(docs, labels, "toxic", per_class, max_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    return texts(docs if to_score is None else to_score).mapInArrow(_scorer(shared), "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
