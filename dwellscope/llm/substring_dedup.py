"""Removal of byte strings of WINDOW bytes that occur more than once.

Every window (WINDOW consecutive bytes of a text) is assigned to an anchor: of
the GRAM-byte strings inside it, the one with the smallest hash, leftmost among
equals. Equal windows have equal anchors at equal places, so windows need
comparing only where anchors repeat.

1. Each text gives its anchors: hash, place, the run of windows that share the
   anchor, and the hash of the bytes that run covers. All hashes come from one
   array of prefix polynomial hashes for each text.
2. Anchor hashes are counted. Anchors that occur once are done. Anchors whose
   whole run occurs again (equal run hashes, then verified by a strong digest
   of the bytes) repeat in full; of each such group one run stands for all.
3. The windows of the remaining runs are suffixes to sort: a mergesort whose
   comparisons find the common extension of two suffixes by binary search over
   prefix hashes. Neighbours with a common extension of WINDOW bytes are equal
   windows; their bytes are compared before they count.
   Anchors shared by more than ``large`` different runs would make one large
   sort; their windows go by digest instead, through partial aggregates.
4. The covered bytes of each text are joined with the text and cut.

Texts are told apart by a 64-bit hash; an anchor found through a hash
collision fails the recheck of its own hash and is ignored. Texts of any
length are handled in overlapping pieces of PIECE bytes. Equal runs within a
text (periodic texts have one at each byte) are compared and folded where the
text is read.

Defined cases: an empty table gives no rows; a null text is empty; texts under WINDOW bytes lose nothing;
repeated rows (and any equal texts) of WINDOW bytes or more occur elsewhere and
are removed whole; a null doc_id is carried through. Kept bytes may not be
UTF-8 any more; they are returned as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, slices, spread_join, table, texts, written

WINDOW = 400
GRAM = 200
LARGE = 2000
PIECE = 1 << 20
#: Windows sorted at once.
SORT_ITEMS = 400_000

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 1 << 63)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Low bits of a hash that give way to the place in a piece.
_PLACE = np.uint64((1 << 22) - 1)


class _Powers:
    """base**i and its inverse, modulo 2**64, as far as asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up), 1 << 14)
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", _INVERSE)):
                    a = np.full(n, base, np.uint64)
                    a[0] = 1
                    setattr(cls, name, np.cumprod(a, dtype=np.uint64))
        return cls.up, cls.down


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sum over j < i of code(data[j]) * base**j, for i from 0 to len(data)."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * _Powers.get(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * _MIX1
        h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), whatever their place."""
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * _Powers.get(len(prefix))[1][start]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Sizes(NamedTuple):
    """Bytes of a window, of the strings that serve as anchors, and of a piece; different runs of an anchor from which on windows go by digest."""

    window: int = WINDOW
    gram: int = GRAM
    piece: int = PIECE
    large: int = LARGE


def anchors(data: bytes, z: Sizes = Sizes()) -> tuple[np.ndarray, ...]:
    """Hash, run hash, place, first and last window start of each anchor of one piece."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    if n < z.window:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e.astype(np.uint64), e, e, e
    prefix = prefix_hashes(b)
    down = _Powers.get(n + 1)[1]
    with np.errstate(over="ignore"):
        h = mixed((prefix[z.gram :] - prefix[: n - z.gram + 1]) * down[: n - z.gram + 1])
    packed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    place = (sliding_min(packed, z.window - z.gram + 1) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    at = place[first]
    with np.errstate(over="ignore"):
        run = mixed(span_hashes(prefix, first, last + z.window) + ((at - first) * 1000003 + (last - first)).astype(np.uint64) * _MIX1)
    return h[at], run, at, first, last


def pieces(data: bytes, z: Sizes = Sizes()) -> Iterator[tuple[int, bytes]]:
    """Overlapping pieces; each window of the text lies in exactly one as a start below ``piece``."""
    for at in range(0, max(1, len(data) - z.window + 1), z.piece):
        yield at, data[at : at + z.piece + z.window - 1]


def merged(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans [s, e) as spans that do not touch."""
    by = np.argsort(s, kind="stable")
    s, reach = s[by], np.maximum.accumulate(e[by])
    head = np.flatnonzero(np.concatenate(([True], s[1:] > reach[:-1])))
    return s[head], reach[np.concatenate((head[1:], [len(s)])) - 1]


def text_anchors(data: bytes, z: Sizes = Sizes()) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """The anchors of a whole text, of equal runs one each, and the spans that equal runs cover.

    So a periodic text, which has an anchor at each byte, gives few rows.
    """
    parts = [(at, anchors(p, z)) for at, p in pieces(data, z)]
    cols = [np.concatenate([p[i] + at if i > 1 else p[i] for at, p in parts]) for i in range(5)]
    key, run, _, first, last = cols
    by = np.lexsort((first, run, key))
    head = np.ones(len(by), bool)
    head[1:] = (key[by][1:] != key[by][:-1]) | (run[by][1:] != run[by][:-1])
    none = np.zeros(0, np.int64)
    if head.all():
        return tuple(cols), (none, none)
    lead = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
    keep, again = np.ones(len(by), bool), np.zeros(len(by), bool)
    for i, j in zip(by[~head].tolist(), lead[~head].tolist(), strict=True):
        if data[first[i] : last[i] + z.window] == data[first[j] : last[j] + z.window]:  # not a collision
            keep[i] = False
            again[i] = again[j] = True
    spans = merged(first[again], last[again] + z.window) if again.any() else (none, none)
    return tuple(c[keep] for c in cols), spans


_ANCHOR = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("rid", pa.int64()), ("place", pa.int32()), ("before", pa.int16()), ("after", pa.int16()), ("e", pa.int32())])
_ANCHOR_DDL = "key long, run long, rid long, place int, before short, after short, e int"
_RUN = pa.schema(
    [("key", pa.int64()), ("run", pa.int64()), ("rid", pa.int64()), ("place", pa.int32()), ("before", pa.int16()), ("after", pa.int16()), ("kinds", pa.int64()), ("digest", pa.binary()), ("data", pa.binary())]
)
_RUN_DDL = "key long, run long, rid long, place int, before short, after short, kinds long, digest binary, data binary"
_SPAN = pa.schema([("rid", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
_WINDOWS = pa.schema([("digest", pa.binary()), ("rid", pa.int64()), ("s", pa.int32())])
_PACKED = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n_bytes", pa.int64()), ("z", pa.binary())])
_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _anchor_rows(z: Sizes):
    """Anchor rows; and rows without a key for spans [place, e) that repeat within a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 64):
            got = [(r, text_anchors(t.encode("utf-8", "surrogatepass"), z)) for r, t in zip(rows["rid"], rows["text"], strict=True)]
            key, run_, at, first, last = (np.concatenate([g[1][0][i] for g in got]) for i in range(5))
            rid = np.repeat(np.array([g[0] for g in got], np.int64), [len(g[1][0][0]) for g in got])
            cols = (key.view(np.int64), run_.view(np.int64), rid, at.astype(np.int32), (at - first).astype(np.int16), (at - last).astype(np.int16))
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(len(rid), pa.int32())], schema=_ANCHOR)
            s, e = (np.concatenate([g[1][1][i] for g in got]) for i in range(2))
            if len(s):
                rid = np.repeat(np.array([g[0] for g in got], np.int64), [len(g[1][1][0]) for g in got])
                none, short = pa.nulls(len(s), pa.int64()), pa.nulls(len(s), pa.int16())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(rid), pa.array(s.astype(np.int32)), short, short, pa.array(e.astype(np.int32))], schema=_ANCHOR)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    pack = zstandard.ZstdCompressor(level=3)
    for rows in slices(batches, 64):
        data = [t.encode("utf-8", "surrogatepass") for t in rows["text"]]
        yield batch_of({"doc_id": rows["doc_id"], "rid": rows["rid"], "n_bytes": list(map(len, data)), "z": list(map(pack.compress, data))}, _PACKED)


def _runs(z: Sizes):
    """For each repeated anchor of a text: a digest of its run's bytes, and for runs still to sort the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for rows in slices(batches, 16):
            out: dict[str, list] = {f.name: [] for f in _RUN}
            for rid, packed, wanted in zip(rows["rid"], rows["z"], rows["wanted"], strict=True):
                data = unpack.decompress(packed)
                for w in wanted:
                    first, end = w["place"] - w["before"], w["place"] - w["after"] + z.window
                    part = data[first:end]
                    gram = np.frombuffer(data[w["place"] : w["place"] + z.gram], np.uint8)
                    if len(part) != end - first or (w["sort"] and mixed(prefix_hashes(gram)[-1:]).view(np.int64)[0] != w["key"]):
                        continue  # another text with this rid
                    for k in ("key", "run", "place", "before", "after", "kinds"):
                        out[k].append(w[k])
                    out["rid"].append(rid)
                    out["digest"].append(hashlib.blake2b(part, digest_size=16).digest())
                    out["data"].append(part if w["sort"] else None)
            yield batch_of(out, _RUN)

    return run


class Suffixes:
    """Suffixes (at most ``window`` bytes) of one byte buffer, ordered within segments by hash-compared mergesort."""

    def __init__(self, buffer: np.ndarray, window: int = WINDOW):
        self.buffer, self.window = buffer, window
        self.prefix = prefix_hashes(buffer)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, at most ``window``, by binary search over prefix hashes."""
        low = np.zeros(len(a), np.int64)
        high = np.full(len(a), self.window, np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) // 2
            same = span_hashes(self.prefix, a, a + mid) == span_hashes(self.prefix, b, b + mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        n = self.extension(a, b)
        end = n >= self.window
        step = np.minimum(n, self.window - 1)
        x, y = self.buffer[a + step], self.buffer[b + step]
        return np.where(end, or_equal, x < y)

    def order(self, start: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Order of the suffixes ``start`` that sorts each segment (segments are contiguous), by merging runs bottom up."""
        n = len(start)
        begin = np.concatenate(([0], np.flatnonzero(segment[1:] != segment[:-1]) + 1)) if n else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((begin, [n])))
        seg_begin, seg_end = np.repeat(begin, size), np.repeat(begin + size, size)
        order = np.arange(n)
        width = 1
        while n and width < size.max():
            inside = np.arange(n) - seg_begin
            pair = inside // (2 * width) * (2 * width) + seg_begin
            left = inside % (2 * width) < width
            other_begin = np.minimum(np.where(left, pair + width, pair), seg_end)
            other_end = np.minimum(np.where(left, pair + 2 * width, pair + width), seg_end)
            # rank of each item in the other run: items of the left run stay before equal ones of the right run
            low, high = other_begin.copy(), other_end.copy()
            mine = start[order]
            while True:
                act = np.flatnonzero(low < high)
                if not len(act):
                    break
                mid = (low[act] + high[act]) // 2
                other = start[order[mid]]
                # the left run asks: other < mine; the right run: other <= mine
                go = np.where(left[act], self.less(other, mine[act], False), self.less(other, mine[act], True))
                low[act] = np.where(go, mid + 1, low[act])
                high[act] = np.where(go, high[act], mid)
            own = inside - (pair - seg_begin) - np.where(left, 0, width)
            new = np.empty_like(order)
            new[pair + own + (low - other_begin)] = order
            order = new
            width *= 2
        return order

    def equal_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows are equal; collisions of the hashes end here."""
        out = np.empty(len(a), bool)
        reach = np.arange(self.window)
        for at in range(0, len(a), 20_000):
            s = slice(at, at + 20_000)
            out[s] = (self.buffer[a[s, None] + reach] == self.buffer[b[s, None] + reach]).all(1)
        return out


def repeated_windows(key: np.ndarray, data: list[bytes], before: np.ndarray, after: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset before the anchor) of the windows that occur in several of the rows given.

    A row is a run: its bytes, from ``before`` bytes before the anchor. Windows
    of one key and offset make a segment, in which suffixes are sorted.
    """
    buffer = np.frombuffer(b"".join(data), np.uint8)
    begin = np.cumsum([0, *map(len, data)])[:-1]
    count = before - after + 1
    row = np.repeat(np.arange(len(data)), count)
    offset = before[row] - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    start = begin[row] + before[row] - offset
    by = np.lexsort((row, offset, key[row]))
    row, offset, start = row[by], offset[by], start[by]
    k = key[row]
    segment = np.concatenate(([0], np.cumsum((k[1:] != k[:-1]) | (offset[1:] != offset[:-1])))) if len(row) else np.zeros(0, np.int64)
    lone = np.bincount(segment)[segment] == 1 if len(row) else np.zeros(0, bool)
    row, offset, start, segment = row[~lone], offset[~lone], start[~lone], segment[~lone]
    if not len(row):
        return row, offset
    suffixes = Suffixes(buffer, window)
    order = suffixes.order(start, segment)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(segment[a] == segment[b])
    near = near[suffixes.extension(start[a[near]], start[b[near]]) >= window]
    near = near[suffixes.equal_bytes(start[a[near]], start[b[near]])]
    hit = np.unique(np.concatenate((a[near], b[near])))
    return row[hit], offset[hit]


def _sorted_runs(z: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by key; whole keys are sorted together, SORT_ITEMS windows or so at once."""
        held: list[tuple] = []
        items = 0
        for rows in slices(batches, 512):
            for r in zip(rows["key"], rows["data"], rows["before"], rows["after"], rows["rid"], rows["place"], strict=True):
                if items > SORT_ITEMS and r[0] != held[-1][0]:
                    yield from _spans_of(held, z.window)
                    held, items = [], 0
                held.append(r)
                items += r[2] - r[3] + 1
        if held:
            yield from _spans_of(held, z.window)

    return run


def _spans_of(held: list[tuple], window: int) -> Iterator[pa.RecordBatch]:
    key, data, before, after, rid, place = zip(*held, strict=True)
    row, offset = repeated_windows(np.array(key), list(data), np.array(before, np.int64), np.array(after, np.int64), window)
    s = np.array(place, np.int64)[row] - offset
    by = np.lexsort((s, row))
    row, s = row[by], s[by]
    if len(row):
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (s[1:] != s[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(row)])) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.array(rid, np.int64)[row[first]]), pa.array(s[first].astype(np.int32)), pa.array((s[last] + window).astype(np.int32))], schema=_SPAN)


def _window_digests(z: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 64):
            out: dict[str, list] = {"digest": [], "rid": [], "s": []}
            for data, before, after, rid, place in zip(rows["data"], rows["before"], rows["after"], rows["rid"], rows["place"], strict=True):
                for i in range(before - after + 1):
                    out["digest"].append(hashlib.blake2b(data[i : i + z.window], digest_size=16).digest())
                    out["rid"].append(rid)
                    out["s"].append(place - before + i)
            yield batch_of(out, _WINDOWS)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for rows in slices(batches, 64):
        out: dict[str, list] = {f.name: [] for f in _CUT}
        for doc_id, z, spans in zip(rows["doc_id"], rows["z"], rows["spans"], strict=True):
            data = unpack.decompress(z)
            kept, at, removed, n = [], 0, 0, 0
            for s, e in sorted((x["s"], min(x["e"], len(data))) for x in spans or ()):
                if e <= at and n:
                    continue
                if s > at or not n:
                    kept.append(data[at:s])
                    n += 1
                    removed += e - s
                else:
                    removed += e - at
                at = e
            kept.append(data[at:])
            for k, v in (("doc_id", doc_id), ("n_bytes", len(data)), ("n_removed", removed), ("n_spans", n), ("kept", b"".join(kept))):
                out[k].append(v)
        yield batch_of(out, _CUT)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for each row of ``docs``."""
    spark, z = docs.sparkSession, sizes
    rows = texts(docs, id_col, text_col).withColumn("rid", F.xxhash64("text"))
    found = written(spark, rows.where(F.octet_length("text") >= z.window).select("rid", "text").mapInArrow(_anchor_rows(z), _ANCHOR_DDL))
    packed = written(spark, rows.select("doc_id", "rid", "text").mapInArrow(_packed, "doc_id long, rid long, n_bytes long, z binary"))
    copies = written(spark, packed.groupBy("rid").agg(F.count(F.lit(1)).alias("n")))
    inside = found.where("key is null").select("rid", F.col("place").alias("s"), "e")
    found = found.where("key is not null").drop("e")
    # runs by (key, run) first: a hot passage is one row for each task from here on
    runs = found.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "place")).alias("one"))
    keys = runs.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1")
    repeated = written(spark, runs.join(keys, "key").select("key", "run", "n", "one", "kinds"))
    wanted = spread_join(found, repeated, ["key", "run"], repeated.select("key", "run", "n")).withColumn(
        # of equal runs one is sorted with the different runs of its anchor
        "sort", (F.col("kinds") > 1) & ((F.col("n") == 1) | (F.struct("rid", "place") == F.col("one")))
    )
    # an anchor near the border of two pieces has a run in each
    lists = wanted.dropDuplicates(["rid", "place", "before", "after"]).groupBy("rid").agg(F.collect_list(F.struct("key", "run", "place", "before", "after", "sort", "kinds")).alias("wanted"))
    got = written(spark, spread_join(packed.where(F.col("n_bytes") >= z.window), lists, ["rid"], copies).select("rid", "z", "wanted").mapInArrow(_runs(z), _RUN_DDL))
    # equal runs: of several rows with one digest all windows repeat
    same = written(spark, got.groupBy("key", "run", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    whole = spread_join(got.select("key", "run", "digest", "rid", "place", "before", "after"), same.drop("n"), ["key", "run", "digest"], same)
    spans = whole.select("rid", (F.col("place") - F.col("before")).cast("int").alias("s"), (F.col("place") - F.col("after") + z.window).cast("int").alias("e"))
    spans = spans.unionByName(inside)
    sort = got.where("data is not null").dropDuplicates(["rid", "place", "before", "after"]).select("key", "data", "before", "after", "rid", "place", "kinds")
    small = sort.where(F.col("kinds") <= z.large).drop("kinds")
    spans = spans.unionByName(small.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_runs(z), "rid long, s int, e int"))
    if not repeated.where(F.col("kinds") > z.large).isEmpty():
        windows = written(spark, sort.where(F.col("kinds") > z.large).mapInArrow(_window_digests(z), "digest binary, rid long, s int"))
        again = written(spark, windows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        spans = spans.unionByName(spread_join(windows, again.drop("n"), ["digest"], again).select("rid", "s", (F.col("s") + z.window).cast("int").alias("e")))
    cuts = spans.distinct().groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return spread_join(packed, cuts, ["rid"], copies, "left").select("doc_id", "z", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``text``: what is left, with U+FFFD for characters of which a cut left only a part."""
    left = without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
