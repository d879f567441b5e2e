"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base patterns (e-mail, IPv4 address, payment card, telephone number) give seed
entities. The word before each seed, and before every other identifier-like
token (one with digits), is a lexical pattern. Patterns and instances form a
bipartite graph that is scored in rounds: a pattern's score is the mean score
of the instances it introduces; seeds score 1, other instances as the best
pattern trusted before this one, or 0 without any. A pattern that introduces at
least ``min_seeds`` different instances of score ``min_score`` or more (seeds or
found in earlier rounds) and has that score itself is trusted from then on, with that score; rounds end when no pattern is added. The
identifier-like tokens of trusted patterns are reported as ``context`` spans
beside the base ones.

Positions are code points, ends exclusive. Matches are found by splitting and
extracting with the same expression; those that fail a check (address parts,
Luhn sum, number of digits) are dropped and not retried.

Instances are tokens of MIN_LENGTH characters or more without blanks and with a
digit. The word before a match is read from the CONTEXT_CHARS characters before
it: of a longer word only its end counts.

Defined cases: an empty table gives no rows; null and empty texts have no spans;
texts of any length are searched whole; repeated rows are each reported (their
values count once, as instances are different values); without seeds no pattern
is trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts, written

# The base patterns, written so that the JVM needs no backtracking over long
# runs: a match starts at a run's start or where the match before it ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: An identifier-like token: no blanks, a digit in it.
_TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
KINDS = (("email", _EMAIL, "@"), ("ip", _IP, "."), ("card", _CARD, None), ("phone", _PHONE, "+"))
CONTEXT_CHARS, MIN_LENGTH = 40, 6
MIN_SEEDS, MIN_SCORE = 5, 0.8


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    rev = F.reverse(_digits(m))
    twice = F.translate(rev, "0123456789", "0246813579")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(rev)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, F.substring(twice, i, F.lit(1))).otherwise(F.substring(rev, i, F.lit(1))).cast("int")
    )
    return F.when(F.length(rev).between(13, 19), total % 10 == 0).otherwise(False)


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _checked(kind: str) -> Column:
    return F.filter(kind, lambda x: _VALID[kind](x["m"]))


def _named(kind: str) -> Column:
    """kind:start:end of each span of column ``kind``."""
    return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


_SPANS = "array<struct<s:int,e:int,m:string>>"


def _located(pieces: Column, hits: Column) -> Column:
    """(start, end, match) of each hit; pieces are what stands between the hits."""
    pairs = F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(hits)), lambda p: F.length(p)).alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc, x):
        s = acc["at"] + x["gap"]
        e = s + F.length(x["hit"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("m")))).alias("out"))

    return F.when(F.size(hits) > 0, F.aggregate(pairs, start, step)["out"]).otherwise(F.array().cast(_SPANS))


def _matches(df: DataFrame, name: str, pattern: str, needs: str | None) -> DataFrame:
    """Column ``name``: all matches with their places; texts without the needed character are not searched."""
    text = F.col("text")
    can = text.contains(needs) if needs else text.rlike("[0-9]")
    none = F.array().cast("array<string>")
    df = df.withColumn("__hits", F.when(can, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("__pieces", F.when(F.size("__hits") > 0, F.split(text, pattern, -1)).otherwise(none))
    return df.withColumn(name, _located(F.col("__pieces"), F.col("__hits"))).drop("__hits", "__pieces")


def _context(start: Column) -> Column:
    """The word before a place: lower case, digits as 9; empty at the text's start."""
    before = F.substring(F.col("text"), F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS)))
    return F.regexp_replace(F.lower(F.regexp_extract(before, r"(\S++)\s*+$", 1)), "[0-9]", "9")


def extracted(docs: DataFrame) -> DataFrame:
    """row, doc_id, one array (s, e, m) for each kind, and seeds and candidates (s, e, m, pattern) of each document row."""
    df = texts(docs)
    for name, pattern, needs in KINDS:
        df = _matches(df, name, pattern, needs)
        df = df.withColumn(name, _checked(name))
    df = _matches(df, "token", _TOKEN, None)
    base = F.concat(*[F.col(k) for k, _, _ in KINDS])
    df = df.withColumn("__base", base)
    free = F.filter("token", lambda t: (F.length(t["m"]) >= MIN_LENGTH) & ~F.exists("__base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    named = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), _context(x["s"]).alias("pattern"))
    return df.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        *[F.col(k) for k, _, _ in KINDS],
        F.transform("__base", named).alias("seeds"),
        F.transform(free, named).alias("candidates"),
    )


def trusted_patterns(found: DataFrame, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """(pattern, score) of the patterns that introduce personal data, from the pattern-instance graph of all documents."""
    spark = found.sparkSession
    rows = found.select(F.explode("seeds").alias("x"), F.lit(1.0).alias("seed")).unionByName(found.select(F.explode("candidates").alias("x"), F.lit(0.0).alias("seed")))
    edges = rows.where("x.pattern <> ''").groupBy(F.col("x.pattern").alias("pattern"), F.sha2(F.lower("x.m"), 256).alias("value")).agg(F.max("seed").alias("score"))
    edges = written(spark, edges)
    enough = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_seeds)
    scored = written(spark, edges.join(enough, "pattern").select("pattern", "value", "score"))  # patterns with too few instances can never be trusted
    trusted = None
    while True:
        # no pattern here is trusted yet, so none adds to the scores of its own instances
        means = scored.groupBy("pattern").agg(F.avg("score").alias("p"), F.sum((F.col("score") >= min_score).cast("int")).alias("support"))
        new = written(spark, means.where((F.col("p") >= min_score) & (F.col("support") >= min_seeds)).select("pattern", "p"))
        trusted = new if trusted is None else trusted.unionByName(new)
        if new.isEmpty():
            return trusted.withColumnRenamed("p", "score")
        gains = scored.join(new, "pattern").groupBy("value").agg(F.max("p").alias("gain"))
        rest = scored.join(new, "pattern", "left_anti").join(gains, "value", "left")
        scored = written(spark, rest.select("pattern", "value", F.greatest("score", F.coalesce("gain", F.lit(0.0))).alias("score")))


def personal_data(docs: DataFrame) -> DataFrame:
    """row, doc_id, email, ip, card, phone, context: arrays of (s, e, m) for each document row."""
    found = written(docs.sparkSession, extracted(docs))
    good = trusted_patterns(found)
    added = found.select("row", F.explode("candidates").alias("x")).withColumn("pattern", F.col("x.pattern")).join(good, "pattern")
    added = added.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("x.s", "x.e", "x.m"))).alias("extra"))
    return found.join(added, "row", "left").select("row", "doc_id", *[F.col(k) for k, _, _ in KINDS], F.coalesce("extra", F.array().cast(_SPANS)).alias("context"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    named = {k: _named(k) for k in ("email", "ip", "card", "phone", "context")}
    base = F.concat(*[named[k] for k, _, _ in KINDS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k, _, _ in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, named["context"]), ",").alias("spans"),
    )
