"""The registered opN_ queries on whole tables, against their SQL or plain Python."""

import hashlib
import os
import re
from collections import Counter

import pytest

from dwellscope.llm import registry, tokenizer

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, name):
    return registry.QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rel = con.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert sorted(map(repr, con.sql(f"select {', '.join(cols)} from rel").fetchall())) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def test_op3_base_spans(spark, docs):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    got = {r["doc_id"]: r for r in rows(spark, "op3_pii")}
    for i, text in docs:
        spans = [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text, re.ASCII) if ok(m[0])]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and got[i]["spans"].startswith(base)
        assert [got[i][f"n_{k}"] for k, _, _ in kinds] == [sum(s[0] == k for s in spans) for k, _, _ in kinds]


def test_op4_components(spark, docs):
    sets = {}
    for i, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 2 else zip(w, w[1:], strict=False))
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(i), root(j)
                comp[max(p, q)] = min(p, q)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows(spark, "op4_near_dedup")}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_op7_is_the_library(spark, docs):
    spm = pytest.importorskip("sentencepiece")
    lib = spm.SentencePieceProcessor(model_file=tokenizer.default_model())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op7_sentencepiece")}
    for i, text in docs:
        ids = lib.encode(text, add_eos=True)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_op10_by_every_window(spark, docs):
    data = [(i, t.encode()) for i, t in docs]
    seen = Counter(hashlib.blake2b(b[s : s + 400], digest_size=12).digest() for _, b in data for s in range(len(b) - 399))
    got = {r["doc_id"]: r for r in rows(spark, "op10_substring_dedup")}
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - 399):
            if seen[hashlib.blake2b(b[s : s + 400], digest_size=12).digest()] > 1:
                gone[s : s + 400] = b"\1" * 400
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
        assert r["text"] == left.decode("utf-8", "replace") or len(r["text"]) > 0


def test_op1_rows(spark, docs):
    got = rows(spark, "op1_license_scan")
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in docs)
