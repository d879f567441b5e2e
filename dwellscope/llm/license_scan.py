"""Licence notices in paragraphs.

A paragraph is a run of lines up to the next blank line, joined, as notices are
wrapped. A softmax regression over licence families and an ``unknown`` class
scores all of it: in windows of WINDOWS words, each moved by half of itself,
the words are a sparse bag of hashed 1-, 2- and 3-grams. The regression is
fitted in numpy on variants of the templates below and on lines of the corpus
(a bounded sample, the one of smallest hash in each of PARAGRAPHS buckets of
hashes, from which those that contain a template or are part of one are left
out). A temperature fitted on variants that the regression has not seen
calibrates the probabilities. A window proposes each family whose probability
against ``unknown`` is at least ``MIN_PROBABILITY``; nothing else does.

An exact check follows. A template of the family must confirm a proposal: the
share of the template's word pairs that stand within twice its length is at
least ``MIN_COVER``. Families that differ in a version or kind also need the
words that tell them apart (``KEYS``). The words from the first to the last of
the template's pairs are the notice; it counts if its own probability against
``unknown`` is at least ``MIN_PROBABILITY``; several families of one line all
count.

n_paragraphs is the number of lines that are not blank, n_licensed the number
of lines in which the name of a counted notice begins (or the notice, if its name is damaged).

The sample of the unknown class takes lines of up to 4000 characters (a bound of
training rows; all lines are scanned).

Defined cases: an empty table gives no rows; null and empty texts have no
paragraphs; blank lines are none; names that stand in several families' notices
are decided by the templates;
repeated rows are each reported; paragraphs of any length are scored whole.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, slices, table, texts

# Licence families and public notice texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0."),
    ("GPL-1.0", "This work is licensed under the GNU General Public License, version 1."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("GPL-1.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 1 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: A version among the words that follow a name, before the next GNU licence.
_VERSION = r"(?:(?!gnu )\S+ ){0,40}?version "
#: Kinds of Creative Commons licences and their names in words.
_CC = {
    "by": "attribution",
    "by-sa": "attribution sharealike",
    "by-nc": "attribution noncommercial",
    "by-nd": "attribution noderivatives",
    "by-nc-sa": "attribution noncommercial sharealike",
    "by-nc-nd": "attribution noncommercial noderivatives",
}
#: Names of licences, with the words that tell them from others: family, fixed beginning, and what follows it (of lower-case words with one blank around each).
KEYS = (
    ("Apache-2.0", " apache license ", r"(?:\S+ ){0,2}2 0 "),
    ("MIT", " the mit license ", ""),
    ("MIT", " permission is hereby granted ", ""),
    ("GPL-1.0", " gnu general public license ", _VERSION + "1 (?![1-9] )"),
    ("GPL-2.0", " gnu general public license ", _VERSION + "2 (?![1-9] )"),
    ("GPL-3.0", " gnu general public license ", _VERSION + "3 (?![1-9] )"),
    ("LGPL-2.1", " gnu lesser general public license ", _VERSION + "2 1 "),
    ("LGPL-3.0", " gnu lesser general public license ", _VERSION + "3 (?![1-9] )"),
    ("AGPL-3.0", " gnu affero general public license ", _VERSION + "3 (?![1-9] )"),
    ("BSD-3-Clause", " redistribution and use ", ""),
    ("BSD-3-Clause", " bsd 3 clause license ", ""),
    ("MPL-2.0", " mozilla public license ", r"(?:\S+ ){0,2}2 0 "),
    *((f"CC-{k.upper()}-4.0", f" cc {k.replace('-', ' ')} ", "4 0 ") for k in _CC),
    *((f"CC-{k.upper()}-4.0", f" creative commons {name} ", "4 0 ") for k, name in _CC.items()),
    ("CC0-1.0", " cc0 ", "1 0 "),
    ("Unlicense", " unencumbered software ", ""),
)
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *sorted({f for f, _ in TEMPLATES}))
#: Bound of the sample of corpus paragraphs for the unknown class.
PARAGRAPHS = 1500
MIN_PROBABILITY, MIN_COVER = 0.5, 0.8
BITS = 18
VARIANTS, EPOCHS, RATE = 20, 60, 2.0
#: Words of the windows that are scored: whatever is as long as half a window or shorter lies whole in one.
WINDOWS = (8, 16, 32, 64, 128)
#: Words that are scored at once; longer paragraphs come in sections that share a longest window.
SECTION = 1 << 14
#: Characters of the paragraphs that are scored at once (one longer paragraph alone).
BLOCK_CHARS = 1 << 18

_KEYS = tuple((f, name.encode(), re.compile(name.encode() + rest.encode())) for f, name, rest in KEYS)
#: Families that differ from others in no version or kind: a template alone tells them, though words of their name be damaged.
_PLAIN = {f for f, _, _ in KEYS} - {f for f, _, rest in KEYS if rest}
#: Words that begin comment lines; other marks of comments are no words.
_COMMENT = {b"dnl", b"rem"}
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def ngram_rows(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph, table row) of the 1-, 2- and 3-grams of the paragraphs."""
    counts = np.array([len(d) for d in docs], np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for d in docs for w in d), np.uint64, counts.sum())
    owner = np.repeat(np.arange(len(docs)), counts)
    owners, rows = [owner], [(h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)]
    with np.errstate(over="ignore"):
        acc = h
        for n in (1, 2):
            acc = (acc[:-1] * np.uint64(0x100000001B3)) ^ h[n:]
            same = owner[:-n] == owner[n:]
            owners.append(owner[:-n][same])
            rows.append((acc[same] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    return np.concatenate(owners), np.concatenate(rows).astype(np.int64)


def _pairs(ws: list[bytes]) -> set[tuple[bytes, ...]]:
    return set(zip(ws, ws[1:], strict=False)) or {tuple(ws)}


class Model:
    def __init__(self, paragraphs: list[str]):
        rng = random.Random(7)
        self.templates = [(f, _pairs(words(t))) for f, t in TEMPLATES]
        corpus = [p for p in paragraphs if not any(self.cover(i, words(p)) >= MIN_COVER or self.part(i, words(p)) for i in range(len(TEMPLATES)))]
        filler = [w for p in corpus[:500] for w in words(p)] or [b"the"]
        data: list[tuple[list[bytes], int]] = []
        for family, text in TEMPLATES:
            base = words(text)
            for v in range(VARIANTS):
                ws = list(base)
                if v % 4 == 1 and len(ws) > 5:
                    del ws[rng.randrange(len(ws))]
                before, after = (rng.randrange(0, 40) if v % 2 else 0), (rng.randrange(0, 40) if v % 3 else 0)
                data.append((rng.choices(filler, k=before) + ws + rng.choices(filler, k=after), FAMILIES.index(family)))
        data += [(words(p), 0) for p in corpus] or [([b"text"], 0)]
        # parts of notices are no notice
        data += [(words(t)[:2] + rng.choices(filler, k=20), 0) for _, t in TEMPLATES for _ in range(5)]
        rng.shuffle(data)
        cut = len(data) * 4 // 5
        y = np.array([c for _, c in data])
        self.weight = np.zeros((1 << BITS, len(FAMILIES)), np.float32)
        self.bias = np.zeros(len(FAMILIES), np.float32)
        self._fit([d for d, _ in data[:cut]], y[:cut])
        self.used = np.abs(self.weight).sum(1) > 1e-4
        logits = self.logits([d for d, _ in data[cut:]])
        losses = {}
        for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0):
            p = _softmax(logits / t)
            losses[t] = -np.log(np.maximum(p[np.arange(len(p)), y[cut:]], 1e-12)).mean() if len(p) else t
        self.temperature = min(losses, key=losses.get)

    def _fit(self, docs: list[list[bytes]], y: np.ndarray) -> None:
        owner, row = ngram_rows(docs)
        keep, col = np.unique(row, return_inverse=True)
        w = np.zeros((len(keep), len(FAMILIES)))
        b = np.zeros(len(FAMILIES))
        hot = np.eye(len(FAMILIES))[y]
        balance = 1 / np.maximum(np.bincount(y, minlength=len(FAMILIES)), 1)[y]
        balance *= len(y) / balance.sum()
        for _ in range(EPOCHS):
            z = np.stack([np.bincount(owner, w[col, k], len(docs)) for k in range(len(FAMILIES))], 1) + b
            g = (_softmax(z) - hot) * balance[:, None] / len(docs)
            w -= RATE * (np.stack([np.bincount(col, g[owner, k], len(keep)) for k in range(len(FAMILIES))], 1) + 1e-5 * w)
            b -= RATE * g.sum(0)
        self.weight[keep] = w
        self.bias[:] = b

    def logits(self, docs: list[list[bytes]]) -> np.ndarray:
        owner, row = ngram_rows(docs)
        known = self.used[row]
        owner, row = owner[known], row[known]
        return np.stack([np.bincount(owner, self.weight[row, k], len(docs)) for k in range(len(FAMILIES))], 1) + self.bias

    def probabilities(self, docs: list[list[bytes]]) -> np.ndarray:
        return _softmax(self.logits(docs) / self.temperature)

    def cover(self, template: int, ws: list[bytes]) -> float:
        """Share of the template's word pairs that stand in the paragraph."""
        want = self.templates[template][1]
        return len(want & _pairs(ws)) / len(want) if ws else 0.0

    def part(self, template: int, ws: list[bytes]) -> bool:
        """Whether the words are mostly a part of the template, as a line of a wrapped notice."""
        have = _pairs(ws)
        return len(ws) > 4 and len(have & self.templates[template][1]) >= MIN_COVER * len(have)

    def _against_unknown(self, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Weights of n-grams less that of unknown, by their last word ``at`` of n; zero where there is none."""
        out = np.zeros((n, len(FAMILIES) - 1), np.float32)
        known = self.used[row]
        w = self.weight[row[known]]
        out[at[known]] = w[:, 1:] - w[:, :1]
        return out

    def proposed(self, docs: list[list[bytes]]) -> list[dict[int, list[tuple[int, int]]]]:
        """For each paragraph the windows (first word, end) that propose a family, by family."""
        out: list[dict[int, list[tuple[int, int]]]] = [{} for _ in docs]
        step = SECTION - WINDOWS[-1]
        sections = [(k, at, d[at : at + SECTION]) for k, d in enumerate(docs) for at in range(0, max(1, len(d) - WINDOWS[-1]), step) if d]
        while sections:
            some, size = [], 0
            while sections and (not some or size + len(sections[-1][2]) <= SECTION):
                some.append(sections.pop())
                size += len(some[-1][2])
            for i, family, s, e in self._proposed([x for _, _, x in some]):
                k, at, _ = some[i]
                out[k].setdefault(family, []).append((at + s, at + e))
        return out

    def _proposed(self, docs: list[list[bytes]]) -> Iterator[tuple[int, int, int, int]]:
        """(paragraph, family, first word, end) of the windows whose probability against unknown suffices."""
        counts = np.array([len(d) for d in docs])
        n, base = int(counts.sum()), np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(docs)), counts)
        acc = h = np.fromiter((xxhash.xxh3_64_intdigest(w) for d in docs for w in d), np.uint64, n)
        ending = []
        with np.errstate(over="ignore"):
            for size in (1, 2, 3):
                if size > 1:
                    acc = (acc[:-1] * np.uint64(0x100000001B3)) ^ h[size - 1 :]
                whole = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :]) if n >= size else np.zeros(0, np.int64)
                row = ((acc[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
                ending.append(self._against_unknown(row, whole + size - 1, n))
        before = np.zeros((n + 1, len(FAMILIES) - 1))
        np.cumsum(ending[0] + ending[1] + ending[2], axis=0, dtype=np.float64, out=before[1:])
        for width in WINDOWS:
            half = width // 2
            per = np.where((counts > half) | (width == WINDOWS[0]), np.maximum(1, -(-counts // half) - 1), 0)
            own = np.repeat(np.arange(len(docs)), per)
            s = (np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)) * half + base[own]
            e = np.minimum(s + width, base[own] + counts[own])
            # n-grams that end in a window but begin before it are none of its own
            z = before[e] - before[s] - ending[1][s] - ending[2][s] + self.bias[1:] - self.bias[0]
            more = s + 1 < e
            z[more] -= ending[2][s[more] + 1]
            w, f = np.nonzero(1 / (1 + np.exp(np.minimum(-z / self.temperature, 700))) >= MIN_PROBABILITY)
            yield from zip(own[w].tolist(), (f + 1).tolist(), (s - base[own])[w].tolist(), (e - base[own])[w].tolist(), strict=True)

    def region(self, family: str, ws: list[bytes], at: int, end: int) -> tuple[int, int] | None:
        """First word and end of the pairs of the template of the family that confirms what stands at ``at``, ``end``."""
        for f, want in self.templates:
            if f != family:
                continue
            reach = 2 * (len(want) + 1)
            low, high = max(0, at - reach), min(len(ws), max(at + reach, end))
            places = [i for i in range(low, high - 1) if (ws[i], ws[i + 1]) in want]
            left = {(ws[i], ws[i + 1]): i for i in places}
            if len(left) >= MIN_COVER * len(want):
                last = {(ws[i], ws[i + 1]): i for i in reversed(places)}
                # the shortest end, then the latest beginning, that hold every pair
                until = max(last.values())
                first = min({(ws[i], ws[i + 1]): i for i in places if i <= until}.values())
                return first, until + 2
        return None


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    return e / e.sum(1, keepdims=True) if len(z) else z


_OUT = pa.schema([("doc_id", pa.int64()), ("n_paragraphs", pa.int64()), ("n_licensed", pa.int64()), ("families", pa.string()), ("top_probability", pa.float64())])


def _blocks(paragraphs: list[str]) -> Iterator[list[str]]:
    """Consecutive paragraphs of at most BLOCK_CHARS characters together, or one longer one."""
    block, size = [], 0
    for x in paragraphs:
        if block and size + len(x) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(x)
        size += len(x)
    if block:
        yield block


def _joined(lines: list[str]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Words, and their lines, of the paragraphs."""
    for full, block in groupby(((k, words(x)) for k, x in enumerate(lines)), lambda b: bool(b[1])):
        if not full:
            continue
        ws: list[bytes] = []
        line: list[int] = []
        for k, x in block:
            x = x[1:] if x[0] in _COMMENT else x
            ws += x
            line += [k] * len(x)
        yield ws, line


def _confirmed(model: Model, ws: list[bytes], line: list[int], proposed: dict[int, list[tuple[int, int]]]) -> Iterator[tuple[int, str, str]]:
    """Line, family and words of the notices that stand where the regression proposes their families."""
    joined = b" " + b" ".join(ws) + b" "
    begin = list(accumulate((len(w) + 1 for w in ws), initial=0))
    for family, windows in ((FAMILIES[i], w) for i, w in proposed.items()):
        inside = bytearray(len(ws))
        for s, e in windows:
            inside[s:e] = b"\1" * (e - s)
        regions = []
        for f, name, key in _KEYS:
            if f != family or name not in joined:
                continue
            for m in key.finditer(joined):
                at = bisect_left(begin, m.start())
                if inside[at] and (region := model.region(family, ws, at, bisect_left(begin, m.end() - 1))):
                    regions.append(region)
                    yield line[at], family, b" ".join(ws[slice(*region)]).decode("utf-8", "replace")
        for s, e in windows if family in _PLAIN else ():
            region = model.region(family, ws, s, e)
            if region and not any(region[0] < y and x < region[1] for x, y in regions):
                regions.append(region)
                yield line[region[0]], family, b" ".join(ws[slice(*region)]).decode("utf-8", "replace")


def _named(model: Model, docs: list[list[str]]) -> list[list[tuple[int, str, str]]]:
    """Line, family and words of the notices of each text: all paragraphs are scored, what is proposed is checked."""
    out: list[list[tuple[int, str, str]]] = [[] for _ in docs]
    held: list[tuple[int, list[bytes], list[int]]] = []
    size = 0
    for i, block in chain(((i, b) for i, lines in enumerate(docs) for b in _joined(lines)), [(-1, ([], []))]):
        if held and (i < 0 or size + len(block[0]) > SECTION):
            for (k, ws, line), proposed in zip(held, model.proposed([x for _, x, _ in held]), strict=True):
                if proposed:
                    out[k] += _confirmed(model, ws, line, proposed)
            held, size = [], 0
        held.append((i, *block))
        size += len(block[0])
    return out


def _found(model: Model, named: list[tuple[int, str, str]]) -> list[float]:
    """Probability of the family of each confirmed name against unknown; the template rules the other families out."""
    out: list[float] = []
    families = iter([FAMILIES.index(f) for _, f, _ in named])
    for block in _blocks([x for _, _, x in named]):
        for row in model.probabilities([words(x) for x in block]):
            p = float(row[next(families)])
            out.append(p / max(p + float(row[0]), 1e-300))
    return out


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows in slices(batches, 64):
            lines = [t.split("\n") for t in rows["text"]]
            named = _named(model, lines)
            flat = iter(_found(model, [x for n in named for x in n]))
            hits = [[(k, f, p) for (k, f, _), p in [(x, next(flat)) for x in n] if p >= MIN_PROBABILITY] for n in named]
            yield batch_of(
                {
                    "doc_id": rows["doc_id"],
                    "n_paragraphs": [sum(1 for x in ls if x.strip()) for ls in lines],
                    "n_licensed": [len({k for k, _, _ in h}) for h in hits],
                    "families": [",".join(sorted({f for _, f, _ in h})) for h in hits],
                    "top_probability": [max((q for _, _, q in h), default=0.0) for h in hits],
                },
                _OUT,
            )

    return run


def _sample(rows: DataFrame, paragraphs: int) -> list[str]:
    """At most ``paragraphs`` different lines: of each bucket of hashes the line with the smallest; no line is shuffled before it is chosen."""
    lines = rows.select(F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> '' and length(line) <= 4000").withColumn("h", F.xxhash64("line"))
    chosen = lines.groupBy(F.pmod("h", F.lit(paragraphs)).alias("bucket")).agg(F.min("h").alias("h")).select("h")  # ``paragraphs`` rows
    return [r["line"] for r in lines.join(F.broadcast(chosen), "h").distinct().orderBy("h", "line").limit(paragraphs).collect()]


def licenses(docs: DataFrame, paragraphs: int = PARAGRAPHS) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, families (sorted, comma-joined), top_probability of each row."""
    rows = texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(Model(_sample(rows, paragraphs)))  # a fixed number of weights
    return rows.mapInArrow(_scanner(shared), "doc_id long, n_paragraphs long, n_licensed long, families string, top_probability double")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
