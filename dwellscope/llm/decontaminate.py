"""Benchmark decontamination with a broadcast set of benchmark n-grams.

Texts are lower-cased (A-Z only) and cut into words of digits, letters and
non-ASCII characters. Every window of ``n`` consecutive words of a benchmark
item (or the whole item, if it has fewer words) enters a hash set that goes to
all executors; each document is scanned once, word windows found by hash are
compared word by word, and the words they cover are hits.

The set is arrays: word numbers of all items and, for each window, its hash,
place and item. It is only sent if the benchmark's words measure at most
``max_bytes`` (checked first); a larger benchmark is cut into sections of
SECTION windows, so that no item exceeds a block, and handled in blocks of
about that size, one scan for each block; the hits of a document are merged.

Defined cases: null and wordless texts have no words and no hits; items
without words are ignored; an item that occurs twice counts by its item_id;
null item_ids are ignored; repeated document rows are each reported; texts of
any length are scanned whole; an empty table of documents gives no rows, an
empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, lower_az, slices, table, texts

#: Words of a window.
N_WORDS = 10
#: Bytes of benchmark words whose windows are broadcast at once.
MAX_BYTES = 8 << 20
#: Windows of a section of a benchmark item.
SECTION = 4096

#: Separators become blanks, A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MIX = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Windows:
    """The benchmark's windows: a word table, all items' word numbers, and for each window length the sorted hashes with place and item."""

    def __init__(self, items: list[tuple[int, str]], n: int = N_WORDS):
        self.vocabulary: dict[bytes, int] = {}
        parts, places, at = [], {}, 0
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.uint32)
            if not len(ids):
                continue
            size = min(n, len(ids))
            places.setdefault(size, []).append((at, len(ids) - size + 1, item_id))
            parts.append(ids)
            at += len(ids)
        self.flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        self.by_size = {}
        for size, runs in places.items():
            begin, count, item = (np.array(x, np.int64) for x in zip(*runs, strict=True))
            start = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            item = np.repeat(item, count)
            hashes = self._hashes(self.flat, start, size)
            by = np.lexsort((item, hashes))
            hashes, start, item = hashes[by], start[by], item[by]
            again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1]))  # a window that its item repeats
            keep = np.ones(len(hashes), bool)
            keep[again[self._equal(self.flat, start[again + 1], start[again], size)] + 1] = False
            self.by_size[size] = (hashes[keep], start[keep].astype(np.int32), item[keep])

    @staticmethod
    def _hashes(ids: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size):
                out = out * np.uint64(_MIX) + ids[start + j].astype(np.uint64)
        return out

    def _equal(self, ids: np.ndarray, at: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        """Whether the windows at ``at`` of ids and at ``start`` of the benchmark are the same words."""
        out = np.ones(len(at), bool)
        for j in range(size):
            out &= ids[at + j] == self.flat[start + j]
        return out

    def scan(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """For each document: covered word intervals [start, end), merged, and the items found."""
        get = self.vocabulary.get
        starts, flat = [], []
        for doc in docs:
            starts.append(len(flat))
            flat += [get(w, 0) for w in doc]
            flat.append(0)
        ids = np.array(flat, dtype=np.uint32)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        hits: list[list[tuple[int, int]]] = [[] for _ in docs]
        items: list[set[int]] = [set() for _ in docs]
        for size, (ordered, places, item) in self.by_size.items():
            if len(ids) < size:
                continue
            known = np.flatnonzero(unknown[size:] == unknown[:-size])  # windows of benchmark words only
            if not len(known):
                continue
            hashes = self._hashes(ids, known, size)
            low = np.searchsorted(ordered, hashes)
            found = np.flatnonzero(ordered[np.minimum(low, len(ordered) - 1)] == hashes)
            low, count = low[found], np.searchsorted(ordered, hashes[found], side="right") - low[found]
            at = np.repeat(known[found], count)
            entry = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            same = self._equal(ids, at, places[entry], size)
            at, owners = at[same], item[entry[same]]
            doc = np.searchsorted(starts, at, side="right") - 1
            for a, d, i in zip(at.tolist(), doc.tolist(), owners.tolist(), strict=True):
                items[d].add(i)
                hits[d].append((a - starts[d], a - starts[d] + size))
        return [(merged(h), i) for h, i in zip(hits, items, strict=True)]


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(bench: DataFrame, id_col: str, text_col: str, n_words: int, max_bytes: int) -> list[DataFrame]:
    """(item_id, text) of the benchmark in blocks that measure about max_bytes at most; items of many words come in overlapping sections."""
    found = F.regexp_extract_all(lower_az(bench[text_col].cast("string")), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    items = bench.select(bench[id_col].cast("long").alias("item_id"), found.alias("ws")).where("item_id is not null and size(ws) > 0")
    last = F.floor(F.greatest(F.size("ws") - n_words, F.lit(0)) / SECTION).cast("int")
    sections = items.withColumn("no", F.explode(F.sequence(F.lit(0), last)))
    sections = sections.select("item_id", "no", F.array_join(F.slice("ws", F.col("no") * SECTION + 1, F.lit(SECTION + n_words - 1)), " ").alias("text"))
    total = sections.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 if total <= max_bytes else 2 * (1 + total // max_bytes)
    return [sections] if n == 1 else [sections.where(F.pmod(F.xxhash64("item_id", "no"), F.lit(n)) == i) for i in range(n)]


_HITS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))])
_HITS_DDL = "doc_id long, text string, n_words long, spans array<int>, items array<long>"


def _scanner(windows, keep_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            docs = [words(t) for t in rows["text"]]
            found = windows.value.scan(docs)
            yield batch_of(
                {
                    "doc_id": rows["doc_id"],
                    "text": rows["text"] if keep_text else [""] * len(docs),
                    "n_words": [len(d) for d in docs],
                    "spans": [[x for s in h for x in s] for h, _ in found],
                    "items": [sorted(i) for _, i in found],
                },
                _HITS,
            )

    return run


def scan(docs: DataFrame, bench: DataFrame, n: int = N_WORDS, max_bytes: int = MAX_BYTES, keep_text: bool = True) -> DataFrame:
    """doc_id, text, n_words, spans (start, end, start, end, ... in words), items for each document row."""
    spark = docs.sparkSession
    rows = texts(docs)

    def found_in(block: DataFrame | None, with_text: bool) -> DataFrame:
        items = [] if block is None else [(r["item_id"], r["text"]) for r in block.collect()]  # bounded: see _blocks
        return rows.mapInArrow(_scanner(spark.sparkContext.broadcast(Windows(items, n)), with_text), _HITS_DDL)

    blocks = _blocks(bench, "item_id", "text", n, max_bytes)
    if len(blocks) == 1:
        return found_in(blocks[0], keep_text)
    # several blocks: rows are told apart by id and text; equal rows have equal hits and come out as often as they came in
    every = None
    for block in blocks:
        one = found_in(block, True).where("size(items) > 0")
        every = one if every is None else every.unionByName(one)
    found = every.groupBy(F.col("doc_id").alias("f_id"), F.col("text").alias("f_text")).agg(
        F.flatten(F.collect_set("spans")).alias("f_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("f_items")
    )
    base = found_in(None, True).select("doc_id", "text", "n_words")
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text") == F.col("f_text")), "left").select(
        "doc_id", "text", "n_words", F.coalesce("f_spans", F.array().cast("array<int>")).alias("spans"), F.coalesce("f_items", F.array().cast("array<long>")).alias("items")
    )
    return joined.mapInArrow(_merge_spans, _HITS_DDL)


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches):
        rows["spans"] = [[x for s in merged(list(zip(v[::2], v[1::2], strict=True))) for x in s] for v in rows["spans"]]
        yield batch_of(rows, _HITS)


def cut_spans(text: str, spans: list[int]) -> str:
    """The text without the characters from each span's first to its last word; what stands around a cut stays."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    out.append(text[at:])
    return "".join(out)


_CLEAN = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("clean_text", pa.string())])


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches):
        spans = rows.pop("spans")
        rows["n_hit"] = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        rows["clean_text"] = [cut_spans(t, s) for t, s in zip(rows["text"], spans, strict=True)]
        yield batch_of(rows, _CLEAN)


def decontaminated(docs: DataFrame, bench: DataFrame, n: int = N_WORDS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, text, n_words, n_hit, items, clean_text (the text without its hit spans) for each document row."""
    return scan(docs, bench, n, max_bytes).mapInArrow(_cutter, "doc_id long, text string, n_words long, n_hit long, items array<long>, clean_text string")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep_text=False)
    ends = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: x - acc)  # e2-(s2-(e1-(s1-0))) = sum of ends less sum of starts
    named = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        ends.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH fold AS (
  SELECT doc_id AS id, 0 AS kind, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT item_id, 1, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), w AS (
  SELECT id, kind, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM fold
), items AS (
  SELECT id AS item_id, ws, least(10, len(ws)) AS size FROM w WHERE kind = 1 AND len(ws) > 0
), grams AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i : i + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM items)
), sizes AS (
  SELECT DISTINCT size FROM grams
), docs AS (
  SELECT id AS doc_id, ws FROM w WHERE kind = 0
), places AS (
  SELECT doc_id, size, i, array_to_string(ws[i : i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM docs, sizes WHERE len(ws) >= size)
), hits AS (
  SELECT p.doc_id, p.i, p.size, g.item_id FROM places p JOIN grams g USING (size, gram)
), covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(f.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""
