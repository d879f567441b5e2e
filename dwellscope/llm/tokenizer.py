"""SentencePiece-compatible BPE encoding by backtracking, and decoding.

The model file is read directly. A text becomes one string in which blanks are
U+2581 and one such mark stands in front; it is cut where no vocabulary piece
can span (before a mark that follows another character, and between characters
that no chain of neighbours within pieces connects, such as letters and
punctuation), and each segment is encoded alone:

* an Aho-Corasick automaton over the pieces gives the longest piece that starts
  at each place;
* the encoder takes the longest piece first and checks that it may follow the
  piece before it: merging the two pieces' characters again must give exactly
  those two pieces;
* if no piece fits, the place is marked in a bit field of failed positions and
  the encoder steps back to a shorter piece.

Characters outside the vocabulary become byte tokens. The result is the one
that merging by score, leftmost first among equals, gives.

Defined cases: a null text is the empty text, whose encoding is the end id
alone; repeated rows are each encoded; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch_of, release_memory, slices, table, texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Segments and pairs a task remembers; the tables are emptied when full and when the task ends.
MEMORY = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of one protocol-buffer message: (number, int or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], dict[str, bool]]:
    """Pieces (text, score, type) and the normaliser's switches of a model file."""
    import struct

    pieces = []
    switches = {"add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}
    model_type = 1
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            pieces.append((text, score, kind))
        elif number == 2:
            model_type = next((v for n, v in _fields(value) if n == 3), 1)
        elif number == 3:
            names = {3: "add_dummy_prefix", 4: "remove_extra_whitespaces", 5: "escape_whitespaces"}
            for n, v in _fields(value):
                if n in names:
                    switches[names[n]] = bool(v)
                elif n == 2 and v:
                    raise ValueError("a character map in the model is not supported")
    if model_type != 2 or switches["remove_extra_whitespaces"] or not switches["escape_whitespaces"] or any(k == USER for _, _, k in pieces):
        raise ValueError("only BPE models with an identity normaliser and no user-defined pieces are supported")
    return pieces, switches


def _connected(pieces) -> list[set[str]]:
    """Sets of characters that stand side by side in pieces, directly or by way of others; marks apart, larger sets first."""
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    for piece in pieces:
        chars = piece.lstrip(MARK)
        for a, b in zip(chars, chars[1:], strict=False):
            parent[root(a)] = root(b)
    sets: dict[str, set[str]] = {}
    for c in list(parent):
        sets.setdefault(root(c), set()).add(c)
    return sorted(sets.values(), key=lambda s: (-len(s), min(s)))


class Tokenizer:
    def __init__(self, data: bytes):
        pieces, switches = read_model(data)
        self.prefix = MARK if switches["add_dummy_prefix"] else ""
        self.ids = {t: i for i, (t, _, k) in enumerate(pieces) if k == NORMAL}
        self.scores = {t: s for t, s, k in pieces if k == NORMAL}
        self.byte_ids = {int(t[3:5], 16): i for i, (t, _, k) in enumerate(pieces) if k == BYTE}
        self.unk_id = next(i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN)
        self.end_id = next((i for i, (t, _, k) in enumerate(pieces) if k == CONTROL and t == "</s>"), None)
        # a byte under 128 is a character wherever it stands; others are gathered into runs
        self.decoded = [(chr(int(t[3:5], 16)) if int(t[3:5], 16) < 128 else bytes([int(t[3:5], 16)])) if k == BYTE else "" if k == CONTROL else " ⁇ " if k == UNKNOWN else t.replace(MARK, " ") for t, _, k in pieces]
        #: ids whose piece starts with the mark
        self.marked = {i for t, i in self.ids.items() if t[0] == MARK}
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece has a blank after another character")
        self.automaton = ahocorasick.Automaton()
        for t in self.ids:
            self.automaton.add_word(t, len(t))
        self.automaton.make_automaton()
        classes = "".join(f"[{''.join(map(re.escape, sorted(c)))}]+|" for c in _connected(self.ids))
        #: marks, then characters that pieces connect or one that stands alone
        self.cut = re.compile(f"{MARK}*(?:{classes}[^{MARK}])|{MARK}+", re.DOTALL)
        #: piece -> the longest piece or single character that is a proper prefix of it
        self.shorter: dict[str, str] = {t: next(t[:n] for n in range(len(t) - 1, 0, -1) if n == 1 or t[:n] in self.ids) for t in self.ids if len(t) > 1}
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merges_to(self, left: str, right: str) -> bool:
        """Whether merging both pieces' characters by score, leftmost first among equals, gives the two pieces; a merge across their border ends it."""
        symbols = list(left + right)
        border = len(left)  # symbols of the left piece
        scores = self.scores
        while True:
            best, where = None, -1
            for i in range(len(symbols) - 1):
                score = scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if best is None:
                return symbols == [left, right]
            if where == border - 1:
                return False
            if where < border:
                border -= 1
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left``; remembered."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merges_to(left, right)
        return known

    def segment_pieces(self, segment: str) -> list[str]:
        """The segment's pieces, by backtracking."""
        if segment in self.ids:
            return [segment]
        size = len(segment)
        longest = [1] * size
        for end, n in self.automaton.iter(segment):
            longest[end - n + 1] = n  # of one start the longer match ends later
        pairs, compatible, shorter = self.pairs, self.compatible, self.shorter
        failed = 0  # bit i: no encoding of the rest from place i fits
        out: list[str] = []
        at, last = 0, ""
        piece: str | None = segment[: longest[0]] if size else None
        while piece is not None:
            end = at + len(piece)
            fits = not failed >> end & 1 if failed else True
            if fits and last:
                fits = pairs.get((last, piece))
                if fits is None:
                    fits = compatible(last, piece)
            if fits:
                out.append(piece)
                at, last = end, piece
                piece = segment[at : at + longest[at]] if at < size else None
            elif (less := shorter.get(piece)) is not None:
                piece = less
            else:
                failed |= 1 << at
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else ""
        return out

    def segment_ids(self, segment: str) -> tuple[tuple[int, ...], str]:
        """The segment's ids, and the same as text; remembered."""
        known = self.known.get(segment)
        if known is None:
            ids: list[int] = []
            for p in self.segment_pieces(segment):
                if p in self.ids:
                    ids.append(self.ids[p])
                elif self.byte_ids:
                    ids += [self.byte_ids[b] for b in p.encode()]
                else:
                    ids.append(self.unk_id)
            if len(self.known) >= MEMORY:
                self.known.clear()
            known = tuple(ids), " ".join(map(str, ids))
            if len(segment) <= 64:
                self.known[segment] = known
        return known

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def encoded_segments(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        segments = self.segments(text)
        found = list(map(self.known.get, segments))
        if None in found:
            found = [f or self.segment_ids(s) for f, s in zip(found, segments, strict=True)]
        return found

    def encode(self, text: str, end: bool = False) -> list[int]:
        ids = list(chain.from_iterable([f[0] for f in self.encoded_segments(text)]))
        return [*ids, self.end_id] if end else ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte runs are read as UTF-8 (each bad byte gives U+FFFD), the mark in front goes."""
        parts = [self.decoded[i] for i in ids]
        try:
            text = "".join(parts)
        except TypeError:  # byte runs outside ASCII
            joined: list[str] = []
            run = b""
            for p in parts:
                if isinstance(p, bytes):
                    run += p
                elif p or not run:
                    if run:
                        joined.append(_utf8(run))
                        run = b""
                    joined.append(p)
            if run:
                joined.append(_utf8(run))
            text = "".join(joined)
        first = next((i for i, p in zip(ids, parts, strict=True) if p), self.unk_id)
        return text[1:] if self.prefix and first in self.marked else text


def _utf8(run: bytes) -> str:
    """UTF-8, every byte that starts no whole character as U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


_WORKER: dict[str, Tokenizer] = {}


def _of(shared) -> Tokenizer:
    """One tokenizer for each Python worker and model."""
    key, data = shared.value
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Tokenizer(data)
    return _WORKER[key]


def _emptied(tok: Tokenizer) -> None:
    """Workers live on after a task; what it remembered would stay in the executor's memory."""
    tok.known.clear()
    tok.pairs.clear()
    release_memory()


_IDS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32()))])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _share(spark: SparkSession, model_path: str):
    """The model's bytes (half a megabyte) for all executors."""
    with open(model_path, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data))


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """doc_id, text, ids (end id last if asked for) for each row."""
    shared = _share(docs.sparkSession, model_path)

    def run(batches):
        tok = _of(shared)
        for rows in slices(batches, 64):
            yield batch_of({**rows, "ids": [tok.encode(t, end) for t in rows["text"]]}, _IDS)
        _emptied(tok)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decoded(tokens: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, decoded for rows of (doc_id, ids); null ids decode to the empty text."""
    shared = _share(tokens.sparkSession, model_path)

    def run(batches):
        tok = _of(shared)
        for rows in slices(batches, 64):
            yield batch_of({**rows, "decoded": [tok.decode(i or []) for i in rows["ids"]]}, _DECODED)

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids never leave the worker that makes them."""
    shared = _share(docs.sparkSession, model_path)

    def run(batches):
        tok = _of(shared)
        for rows in slices(batches, 64):
            out: dict[str, list] = {f.name: [] for f in _DIGEST}
            out["doc_id"] = rows["doc_id"]
            for t in rows["text"]:
                found = tok.encoded_segments(t)
                ids = list(chain.from_iterable([f[0] for f in found]))
                ids.append(tok.end_id)
                named = [f[1] for f in found]
                named.append(str(tok.end_id))
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(named).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(tok.decode(ids).encode()).hexdigest())
            yield batch_of(out, _DIGEST)
        _emptied(tok)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), model_path or default_model())
