"""The pipeline's stages against plain Python on a small table."""

import random

import pytest

import corpus_pipeline as cp
from dwellscope.llm import exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, rid long, score double"
WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["$$$", "!!!", "click", "zz"]) for _ in range(80))
    base = [good() for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.upper()) for i, t in enumerate(base[:4])] + [(200, base[5] + " extra"), (201, None), (202, ""), (203, base[6])]
    rows += [(203, base[7] + " w1 w2"), (300, " ".join(f"b{i}" for i in range(30)) + " " + good()), (None, good())]
    rows += [(1000 + i, good()) for i in range(120)] + [(2000 + i, bad()) for i in range(120)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 0.5) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 2000), 0) for i, _ in rows if i and i >= 1000], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(30))), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def test_run(spark, folder):
    path, rows = folder
    got = {r["doc_id"] for r in cp.run(spark, path).collect()}
    assert not any(i and i >= 2000 for i in got)  # the bad ones go
    assert not got & {0, 1, 2, 3} and {100, 101, 102, 103} <= got  # of exact copies the largest id stays
    assert 5 in got and 200 not in got  # of near copies the smallest
    assert 300 in got and None in got


def test_stages_keep_columns_and_their_own_texts(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
    # two rows share an id: the one whose text equals that of a larger id goes, the other stays
    twice = spark.createDataFrame([(1, "one two"), (1, "three four"), (2, "ONE two")], "doc_id long, text string")
    assert sorted(map(tuple, cp.exact_filter(spark, twice, path).collect())) == [(1, "three four"), (2, "ONE two")]
    long = " ".join(WORDS[:60])
    near = spark.createDataFrame([(5, long), (6, long + " more"), (7, long + " again"), (7, "quite another text of some words"), (8, "quite another text of some words or so")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in cp.near_filter(spark, near, path).collect()) == [5, 7, 7, 8]


def test_cut_spans_take_effect(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id = 300")
    (row,) = cp.decontaminate_spans(spark, docs, path).collect()
    assert "b1 b2" not in row["text"] and row["n_chars"] == len(row["text"]) and row["text"].strip()


def test_near_recall_at_the_threshold(spark):
    """Pairs at a similarity from 0.8 to 0.85: all are linked."""
    rng = random.Random(9)
    rows, wanted = [], 0
    while wanted < 150:
        ws = [f"{rng.randrange(10**6)}" for _ in range(rng.choice([20, 40, 90]))]
        other = ws[:]
        for _ in range(rng.randrange(1, 6)):
            other[rng.randrange(len(ws))] = "changed"
        a, b = (set(zip(x, x[1:], strict=False)) for x in (ws, other))
        if 80 <= 100 * len(a & b) / len(a | b) <= 85:
            rows += [(2 * wanted, " ".join(ws)), (2 * wanted + 1, " ".join(other))]
            wanted += 1
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(wanted)) == wanted


def test_near_hot_bucket(spark):
    """Many classes in one bucket, found in blocks."""
    common = [f"c{i}" for i in range(300)]
    rows = [(i, " ".join(common + [f"x{i}", f"y{i}"])) for i in range(60)] + [(100, "alone here")]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(60)} == {0} and got[100] == 100
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trained_classifiers_on_held_out_rows(spark):
    """op2 and op5 at sf0.01, against the labels that they never see."""
    import os

    from dwellscope.llm import quality, toxicity

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    for query, key, least in ((quality.op5_quality, "quality", 0.8), (toxicity.op2_toxicity, "toxic", 0.8)):
        rows = [(r["score"], labels[r["doc_id"]][key], r["predicted"]) for r in query(spark, path).collect() if r["held_out"] and r["doc_id"] in labels]
        right = sum(p == y for _, y, p in rows) / len(rows)
        assert right >= least and all(0 <= s <= 1 for s, _, _ in rows), key


def test_classifiers_without_a_class(spark):
    from dwellscope.llm import quality, toxicity

    docs = spark.createDataFrame([(i, f"word {i}") for i in range(20)] + [(30, None), (31, "")], "doc_id long, text string")
    one = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        assert {r["score"] for r in scores(docs, one).collect()} == {1.0} and scores(docs.limit(0), one).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, one.limit(0)).collect()} == {0.5}
