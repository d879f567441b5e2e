"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellscope.llm import decontaminate, exact_dedup, near_dedup, quality, tokenizer
from dwellscope.llm.common import table, written

#: Near duplicates of the pipeline: words of a shingle, percent of similarity.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Documents that score lower, more likely bad than good, are rejected.
MIN_QUALITY = 0.5


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _only(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose id (null included) and text hash are in ``found``; rows that share an id stand each for its own text."""
    wanted = found.select(F.col("doc_id").alias("__id"), F.col("rid").alias("__digest")).distinct()
    marked = docs.withColumn("__own", F.xxhash64(_text()))
    return marked.join(wanted.hint("shuffle_hash"), marked["doc_id"].cast("long").eqNullSafe(wanted["__id"]) & (marked["__own"] == wanted["__digest"]), "left_semi").drop("__own")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of the input tables; documents under MIN_QUALITY go.

    Null and empty texts have the score of empty text; repeated rows share their score; an empty table stays empty.
    """
    scores = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), to_score=docs)
    return _only(docs, scores.where(F.col("score") >= MIN_QUALITY))


def exact_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the row with the largest id stays; rows of that id with the same text become one."""
    found = exact_dedup.exact_duplicates(docs)
    return _only(docs, found.where("kept")).dropDuplicates(["doc_id", "text"])


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; documents without words stay.

    An id that several different texts share names none of them, so such rows are not searched and stay.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64(_text()).alias("__t"))
    shared = written(spark, rows.groupBy("__id").agg(F.min("__t").alias("a"), F.max("__t").alias("b")).where("a <> b").select("__id"))
    mine = docs["doc_id"].cast("long").eqNullSafe(shared["__id"])
    some = not shared.isEmpty()
    found = near_dedup.near_duplicates(docs.join(shared, mine, "left_anti") if some else docs, n_words=NEAR_WORDS, percent=NEAR_PERCENT)
    out = _only(docs, found.where("kept"))
    return out.unionByName(docs.join(shared, mine, "left_semi")) if some else out


def decontaminate_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that stand in a benchmark window are cut out; documents of which no word is left go, others (null and empty ones too) stay. n_chars follows the text."""
    clean = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    hit = written(spark, clean.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"), "clean_text", (F.col("n_hit") < F.col("n_words")).alias("__left")).dropDuplicates(["__id", "__text"]))
    joined = docs.join(hit.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(hit["__id"]) & (docs["text"] == hit["__text"]), "left").where(F.coalesce(hit["__left"], F.lit(True)))
    changed = {"text": F.coalesce(hit["clean_text"], docs["text"])}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit["clean_text"].isNull(), docs["n_chars"]).otherwise(F.length(hit["clean_text"])).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return tokenizer.round_trip_digests(docs, tokenizer.default_model())


STAGES = [
    ("quality", quality_filter),
    ("exact dedup", exact_filter),
    ("near dedup", near_filter),
    ("decontamination", decontaminate_spans),
    ("tokenizer", tokenize),
]

#: The stages learn or search; no SQL for run() as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
