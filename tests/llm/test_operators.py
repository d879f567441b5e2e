"""Operators against brute force on small tables with nulls, empty and repeated rows and clashing columns."""

import hashlib
import pickle
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dwellscope.llm import decontaminate, exact_dedup, license_scan, near_dedup, pii, quality, substring_dedup, toxicity, warc
from dwellscope.llm.common import shared_dir, spread_join

SCHEMA = "doc_id long, text string, score double, key long, rid long, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(150)) for _ in range(6)]
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, base[0]), (6, base[0]), (7, base[0].upper()), (7, base[0].upper()), (None, base[1])]
    for i, b in enumerate(base):
        ws = b.split()
        ws[rng.randrange(150)] = "changed"
        out.append((20 + i, " ".join(ws)))
        out.append((40 + i, base[i - 1][:300] + " " + b[100:700] + "é" * i))
    out.append((60, "ab " * 3000))
    return out


def test_exact(spark, rows):
    got = exact_dedup.exact_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[key] if i is not None]
        assert r["group_size"] == len(groups[key]) and r["keep_id"] == (max(ids) if ids else None)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def test_fingerprints_combine():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    a, b = data[:60_000], data[60_000:120_000]
    assert exact_dedup.combine(exact_dedup.chunk_hash(a[:30_000]), exact_dedup.chunk_hash(a[30_000:]), 30_000) == exact_dedup.chunk_hash(a)
    assert exact_dedup.fingerprint(a + b) != exact_dedup.fingerprint(b + a)


def test_exact_with_collisions_and_huge_texts(spark, rows):
    """Weak fields make texts of one length collide; a low bound sends texts through the parallel chunks."""
    rows = rows + [(100, "aaaa"), (101, "bbbb"), (102, "aaaA"), (103, "cccc"), (104, "x" * 70_000), (105, "X" * 70_000), (106, "x" * 69_999 + "y")]
    want = sorted(map(str, exact_dedup.exact_duplicates(table(spark, rows)).collect()))
    weak = ((2, 1), (2, 1))
    assert len({exact_dedup.fingerprint(t, weak) for t in (b"aaaa", b"bbbb", b"cccc")}) == 1
    assert sorted(map(str, exact_dedup.exact_duplicates(table(spark, rows), fields=weak).collect())) == want
    assert sorted(map(str, exact_dedup.exact_duplicates(table(spark, rows), huge=100).collect())) == want


def test_near(spark, rows):
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, frozenset([tuple(w)] if 0 < len(w) < 2 else zip(w, w[1:], strict=False)))
    ids = sorted(i for i in sets if i is not None)
    comp = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            for j in ids:
                n = len(sets[i] & sets[j])
                if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"]) == (comp[r["doc_id"]], len(sets[r["doc_id"]]))


def test_substring(spark, rows):
    got = {(r["doc_id"], r["n_bytes"]): r for r in substring_dedup.without_repeats(table(spark, rows)).collect()}
    count = {}
    for _, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 399):
            count[b[s : s + 400]] = count.get(b[s : s + 400], 0) + 1
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 399):
            if count[b[s : s + 400]] > 1:
                gone[s : s + 400] = [True] * 400
        r = got[i, len(b)]
        assert r["kept"] == bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert r["n_spans"] == sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))


def test_substring_large_groups(spark, rows):
    want = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.without_repeats(table(spark, rows)).collect())
    by_digest = substring_dedup.without_repeats(table(spark, rows), sizes=substring_dedup.Sizes(large=0))
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in by_digest.collect()) == want


def brute_cut(texts, window):
    """What is left of each text, and how much goes, by looking at each window."""
    count = Counter(t[s : s + window] for t in texts for s in range(len(t) - window + 1))
    for t in texts:
        gone = [False] * len(t)
        for s in range(len(t) - window + 1):
            if count[t[s : s + window]] > 1:
                gone[s : s + window] = [True] * window
        yield "".join(c for c, g in zip(t, gone, strict=True) if not g), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))


@pytest.mark.parametrize("sizes", [{"piece": 500}, {"window": 40, "gram": 20, "piece": 64}, {"window": 40, "gram": 20, "large": 0}])
def test_substring_piece_borders(spark, sizes):
    z = substring_dedup.Sizes(**sizes)
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [letters(n * z.window // 400) for n in (400, 420, 450, 500, 600, 900)]
    rows = [(i, letters(rng.randrange(900)) + p + letters(rng.randrange(900))) for i, p in enumerate(shared * 6)]
    # periodic texts have an anchor at each byte; a passage may repeat within one text only
    rows += [(100, "a" * 3000), (101, "xyz" * 700), (102, letters(300) + "ab" * 500 + letters(50)), (103, "".join(2 * [letters(z.window + 3)])), (104, ""), (105, "a" * (z.window - 1))]
    got = {r["doc_id"]: (bytes(r["kept"]).decode(), r["n_removed"], r["n_spans"]) for r in substring_dedup.without_repeats(table(spark, rows), sizes=z).collect()}
    for (i, _), want in zip(rows, brute_cut([t for _, t in rows], z.window), strict=True):
        assert got[i] == want, i


def test_substring_periodic_text_gives_few_rows():
    cols, (s, e) = substring_dedup.text_anchors(b"ab" * 100_000)
    assert len(cols[0]) < 10 and len(s) == 1 and e[0] - s[0] > 199_000


def test_substring_empty_table(spark):
    assert substring_dedup.without_repeats(table(spark, [])).count() == 0


def test_spread_join(spark):
    left = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"))
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    right = counts.where("k % 2 = 1").select("k", (F.col("k") * 2).alias("v"))
    want = sorted(map(tuple, left.join(right, "k").select("id", "v").collect()))
    assert sorted(map(tuple, spread_join(left, right, ["k"], counts).select("id", "v").collect())) == want
    assert spread_join(left, right, ["k"], counts, "left").count() == 5000


def test_decontaminate_blocks(spark):
    words = "a b c d e f g h i j k l m n".split()
    docs = table(spark, [(1, "x " + " ".join(words) + " y"), (2, "Short ITEM here"), (3, None), (4, "nothing"), (2, "Short ITEM here")])
    bench = spark.createDataFrame([(1, " ".join(words[:12])), (2, "short item"), (3, None), (None, "x"), (2, "short item")], "item_id long, text string")
    one = sorted((r["doc_id"], r["n_hit"], r["clean_text"]) for r in decontaminate.decontaminated(docs, bench).collect())
    assert one == [(1, 12, "x  m n y"), (2, 2, " here"), (2, 2, " here"), (3, 0, ""), (4, 0, "nothing")]
    assert sorted((r["doc_id"], r["n_hit"], r["clean_text"]) for r in decontaminate.decontaminated(docs, bench, max_bytes=8).collect()) == one
    assert decontaminate.scan(docs, bench.limit(0)).where("size(items) > 0").count() == 0


def test_decontaminate_against_brute_force(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    bench = [(i, text(rng.choice([2, 5, 12, 30]))) for i in range(12)] + [(20, text(9000)), (21, "unique words only here")]
    docs = [(i, text(rng.randrange(60))) for i in range(40)] + [(50, bench[12][1][3000:9000]), (51, None), (52, "!!")]
    found = decontaminate.scan(table(spark, docs), spark.createDataFrame(bench, "item_id long, text string"))
    blocks = decontaminate.scan(table(spark, docs), spark.createDataFrame(bench, "item_id long, text string"), max_bytes=4000)
    seen = {}
    for i, t in bench:
        ws = t.split()
        n = min(10, len(ws))
        for k in range(len(ws) - n + 1):
            seen.setdefault(tuple(ws[k : k + n]), set()).add(i)
    want = {}
    for i, t in docs:
        ws, hit, items = (t or "").replace("!", "").split(), set(), set()
        for n in {len(w) for w in seen}:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in seen:
                    hit |= set(range(k, k + n))
                    items |= seen[tuple(ws[k : k + n])]
        want[i] = (len(ws), len(hit), sorted(items))
    for result in (found, blocks):
        assert {r["doc_id"]: (r["n_words"], sum(r["spans"][1::2]) - sum(r["spans"][::2]), sorted(r["items"])) for r in result.collect()} == want


def test_windows_memory():
    """The broadcast stays within about four times the words' bytes."""
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(50_000)}" for _ in range(200_000))
    assert len(pickle.dumps(decontaminate.Windows([(1, text)]))) < 5 * len(text)


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>"), (2, None, "<p>"), (3, "u", None), (4, "u", ""), (2, None, "<p>")], "page_id long, url string, html string")
    path = shared_dir(spark)
    warc.write_archive(pages, path)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, path).collect())
    assert got == [(1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]
    assert all(r["record"].startswith(b"WARC/1.1\r\n") for r in warc.record_bytes(spark, path).collect())
    empty = shared_dir(spark)
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_warc_damaged_payload(spark):
    pages = spark.createDataFrame([(1, "u", "<p>"), (2, "u", "<q>")], "page_id long, url string, html string")
    path, other = shared_dir(spark), shared_dir(spark)
    warc.write_archive(pages, path)
    swapped = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.min("payload").over(Window.partitionBy(F.lit(1))))
    swapped.write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, other).collect()


def test_pii(spark):
    text = "é😀a@b.co 4111-1111-1111-1111 x 999.1.1.1 10.0.0.1 +49 (0)30 123456-7"
    r = {x["doc_id"]: x for x in pii.personal_data(table(spark, [(1, text), (2, None), (3, "9" * 50_000)])).collect()}
    assert [(x["s"], x["e"]) for x in r[1]["email"]] == [(2, 8)] and len(r[1]["card"]) == 1 and [x["m"] for x in r[1]["ip"]] == ["10.0.0.1"] and len(r[1]["phone"]) == 1
    assert all(not r[i][k] for i in (2, 3) for k in ("email", "ip", "card", "phone", "context"))


def test_pii_learns_contexts(spark):
    rows = [(i, f"word contact: user{i}@mail.example and more") for i in range(30)] + [(99, "then contact: QX-99812-Z here"), (98, "then other QX-99812-Y here")]
    found = {r["doc_id"]: [x["m"] for x in r["context"]] for r in pii.personal_data(table(spark, rows)).collect()}
    assert found[99] == ["QX-99812-Z"] and found[98] == []


def test_pii_pattern_does_not_support_itself(spark):
    rows = [(i, f"more about user{i}@mail.example and") for i in range(5)] + [(100 + i, f"more about AB-10{i:02}-X and") for i in range(10)]
    # nor do two patterns with the same instances support one another
    rows += [(200 + i, f"then near host{i}@mail.example and") for i in range(5)] + [(300 + i, f"then near AB-10{i:02}-X and") for i in range(10)]
    assert all(not r["context"] for r in pii.personal_data(table(spark, rows)).collect())


def test_pii_found_values_support_other_patterns(spark):
    rows = [(i, f"word contact: user{i}@mail.example and more") for i in range(150)]
    for i in range(7):
        rows += [(200 + i, f"word contact: QX-9981{i}-Z and"), (300 + i, f"then badge: QX-9981{i}-Z and"), (400 + i, f"some pass: KV-5521{i}-B and")]
    rows += [(500 + i, f"then badge: KV-5521{i}-B and") for i in (0,)] + [(600, "once other KV-55219-B and")]
    found = {r["doc_id"]: [x["m"] for x in r["context"]] for r in pii.personal_data(table(spark, rows)).collect()}
    assert found[300] == ["QX-99810-Z"] and found[500] == ["KV-55210-B"]
    assert found[401] == [] and found[600] == []


def test_classifiers_without_labels(spark, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    assert {r["score"] for r in quality.quality_scores(docs, labels).collect()} == {0.5}
    assert {r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()} == {0.0}


def test_licenses(spark):
    docs = table(spark, [(1, "text\nReleased under the MIT License."), (2, None), (3, "some plain words\n\nmore of them")])
    got = {r["doc_id"]: (r["n_paragraphs"], r["families"]) for r in license_scan.licenses(docs).collect()}
    assert got == {1: (2, "MIT"), 2: (0, ""), 3: (2, "")}


def test_licenses_wrapped_and_several_in_a_line(spark):
    mit = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the Software), to deal"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    docs = table(spark, [(1, "x\n\n" + mit), (2, bsd), (3, "Released under the MIT License. Licensed under the Apache License, Version 2.0.\nmore"), (4, mit.replace("\n", "\n\n"))])
    got = {r["doc_id"]: (r["n_paragraphs"], r["n_licensed"], r["families"]) for r in license_scan.licenses(docs).collect()}
    assert got == {1: (3, 1, "MIT"), 2: (3, 1, "BSD-3-Clause"), 3: (2, 1, "Apache-2.0,MIT"), 4: (2, 0, "")}


def test_licenses_that_differ_in_few_words(spark):
    head = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    work = "This work is licensed under the GNU {}General Public License, version {}."
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    texts = [
        (head.format("", ";", 2), "GPL-2.0"), (head.format("", ",", 3), "GPL-3.0"), (head.format("Affero ", ",", 3), "AGPL-3.0"),
        (work.format("", 1), "GPL-1.0"), (work.format("", 2), "GPL-2.0"), (work.format("", 3), "GPL-3.0"), (work.format("Lesser ", 3), "LGPL-3.0"), (work.format("Lesser ", 2.1), "LGPL-2.1"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        (cc.format(""), "CC-BY-4.0"), (cc.format("-NonCommercial"), "CC-BY-NC-4.0"), (cc.format("-NoDerivatives"), "CC-BY-ND-4.0"),
        (work.format("", 4), ""), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", ""),
    ]
    got = {r["doc_id"]: r["families"] for r in license_scan.licenses(table(spark, [(i, t) for i, (t, _) in enumerate(texts)])).collect()}
    assert got == {i: f for i, (_, f) in enumerate(texts)}


def test_licenses_are_found_by_the_regression(spark):
    """Every paragraph is scored: a notice whose name is damaged is found, and none where no window proposes its family."""
    rng = random.Random(8)
    filler = lambda n: [rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(n)]
    mit = "Permission is herby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    bsd = "Redistribution or use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    docs = [" ".join(filler(k) + [t] + filler(k)) for t in (mit, bsd) for k in (0, 9, 50, 20_000)]
    got = license_scan.licenses(table(spark, [*enumerate(docs), (8, mit[:60]), (9, mit + "\n\nx\n" + bsd)])).collect()
    assert {r["doc_id"]: (r["n_licensed"], r["families"]) for r in got} == {**{i: (1, "MIT" if i < 4 else "BSD-3-Clause") for i in range(8)}, 8: (0, ""), 9: (2, "BSD-3-Clause,MIT")}
    model = license_scan.Model(["some words of the corpus"])
    text = "Released under the MIT License."
    assert [f for _, f, _ in license_scan._named(model, [[text]])[0]] == ["MIT"]
    model.bias[license_scan.FAMILIES.index("MIT")] = -1e6
    assert license_scan._named(model, [[text]]) == [[]]


def test_license_windows():
    """Windows have the probabilities of their words; anything up to half a window lies whole in one; sections are seamless."""
    rng = random.Random(9)
    model = license_scan.Model(["some words of the corpus"])
    vocabulary = [w for _, t in license_scan.TEMPLATES for w in license_scan.words(t)]
    docs = [[rng.choice(vocabulary) for _ in range(n)] for n in (1, 2, 4, 5, 8, 9, 33, 300, license_scan.SECTION + 500)]
    for d, got in zip(docs, model.proposed(docs), strict=True):
        want = {}
        for k, w in enumerate(license_scan.WINDOWS):
            if k and len(d) <= w // 2:
                continue
            for s in range(0, max(1, len(d) - w // 2), w // 2):
                if len(d) > 1000 and not license_scan.SECTION - 400 < s < license_scan.SECTION + 300:
                    continue
                (p,) = model.probabilities([d[s : s + w]])
                for f in range(1, len(p)):
                    want.setdefault((s, min(s + w, len(d))), {})[f] = p[f] / (p[f] + p[0])
        have = {(f, s, e) for f, x in got.items() for s, e in x}
        for (s, e), p in want.items():
            assert all((f, s, e) in have for f in p if p[f] > 0.501) and not any((f, s, e) in have for f in p if p[f] < 0.499), (len(d), s, e)


def test_license_blocks():
    texts = ["a" * 10, "b" * (license_scan.BLOCK_CHARS + 5), "c", "d" * license_scan.BLOCK_CHARS, "e"]
    blocks = list(license_scan._blocks(texts))
    assert [x for b in blocks for x in b] == texts
    assert all(len(b) == 1 or sum(map(len, b)) <= license_scan.BLOCK_CHARS for b in blocks)
    assert list(license_scan._blocks([])) == []


def test_license_sample_is_bounded_and_distinct(spark):
    docs = spark.createDataFrame([(i, "same line\n" + f"line {i}\n\n") for i in range(300)], "doc_id long, text string")
    got = license_scan._sample(docs, 20)
    assert len(got) == len(set(got)) == 20
    assert got == license_scan._sample(docs.repartition(7), 20)
    assert license_scan._sample(docs.limit(0), 20) == []
