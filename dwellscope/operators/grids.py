"""Further grids of links and zones around stops; each returns a lazily planned DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Metres under which a bin joins its neighbour.
SLIVER = 1.0


def _inner(span: Column, step: Column, shift: Column) -> Column:
    """Edges shift, shift + step, ... that lie at least a sliver inside the span."""
    every = F.transform(F.sequence(F.lit(0), F.ceil(span / step).cast("int")), lambda i: shift + i * step)
    return F.filter(every, lambda x: (x >= SLIVER) & (x <= span - SLIVER))


def _numbered(df: DataFrame) -> DataFrame:
    """A row for each bin from the edges (and zones) of each link, seg_idx along the pattern."""
    bins = df.select("pattern_uid", "link_idx", "edges", "zones", F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("k", "lo"))
    order = W.partitionBy("pattern_uid").orderBy("link_idx", "k")
    return bins.select("pattern_uid", "link_idx", "k", "lo", F.element_at("edges", F.col("k") + 2).alias("hi"), F.get("zones", F.col("k")).alias("zone"), (F.row_number().over(order) - 1).alias("seg_idx"))


def fixed_grid(links: DataFrame, length: float, phase: float = 0.0) -> DataFrame:
    """Bins of ``length`` metres from the phase on; the first and last bin of a link take what is left."""
    inner = _inner(F.col("len_m"), F.lit(float(length)), F.lit(phase % length))
    return _numbered(links.withColumn("edges", F.concat(F.array(F.lit(0.0)), inner, F.array("len_m"))).withColumn("zones", F.lit(None).cast("array<string>")))


def stops_grid(links: DataFrame, length: float, phase: float = 0.0) -> DataFrame:
    """Links with ``head`` and ``tail`` metres: these are bins of their own (zone stop), an equal grid lies between (running).

    Head and tail count to 0.1 m; under a sliver they vanish; if they leave less than a sliver, the link is one stop bin.
    """
    df = links.withColumn("h", F.round(F.greatest("head", F.lit(0.0)), 1)).withColumn("t", F.round(F.greatest("tail", F.lit(0.0)), 1))
    df = df.withColumn("a", F.when(F.col("h") >= SLIVER, F.col("h")).otherwise(0.0)).withColumn("b", F.when(F.col("t") >= SLIVER, F.col("len_m") - F.col("t")).otherwise(F.col("len_m")))
    span = F.col("b") - F.col("a")
    df = df.withColumn("step", span / F.greatest(F.lit(1), F.rint(span / length).cast("int")))
    shift = F.lit(phase / length) * F.col("step")
    mid = F.transform(_inner(span, F.col("step"), shift - F.floor(shift / F.col("step")) * F.col("step")), lambda x: x + F.col("a"))
    edges = F.array_distinct(F.concat(F.array(F.lit(0.0), F.col("a")), mid, F.array("b", "len_m")))
    whole = F.col("len_m") - F.col("h") - F.col("t") < SLIVER
    df = df.withColumn("edges", F.when(whole, F.array(F.lit(0.0), F.greatest("len_m", F.lit(0.0)))).otherwise(edges))
    last = F.size("edges") - 2
    zones = F.transform(F.sequence(F.lit(0), last), lambda i: F.when(whole | ((i == 0) & (F.col("a") > 0)) | ((i == last) & (F.col("b") < F.col("len_m"))), "stop").otherwise("running"))
    return _numbered(df.withColumn("zones", zones))


def tagged(segments: DataFrame, stops: DataFrame, up_m: float, down_m: float) -> DataFrame:
    """Zone of segments (pattern_uid, x0_m, x1_m): stop where they overlap the reach of any stop of the pattern.

    A pattern's stops (tens) become one array, so segments are not multiplied.
    """
    reach = stops.groupBy("pattern_uid").agg(F.collect_list("s_m").alias("at"))
    near = F.exists("at", lambda s: (F.col("x0_m") < s + down_m) & (F.col("x1_m") > s - up_m))
    return segments.join(reach, "pattern_uid", "left").withColumn("zone", F.when(near, "stop").otherwise("running")).drop("at")


def zoned_links(links: DataFrame, overrides: DataFrame | None, default: tuple[float, float] = (30.0, 60.0)) -> DataFrame:
    """Links with ``head`` (metres after their first stop) and ``tail`` (before their last): the row of their own pattern, else
    the median over the patterns of their key, else the default (before, after).

    ``overrides`` has pattern_uid, link_idx, link_key, head, tail.
    """
    up, down = default
    if overrides is None:
        return links.withColumn("head", F.lit(float(down))).withColumn("tail", F.lit(float(up)))
    own = overrides.select("pattern_uid", "link_idx", F.col("head").alias("h0"), F.col("tail").alias("t0"))
    key = overrides.groupBy("link_key").agg(F.percentile("head", F.lit(0.5)).alias("h1"), F.percentile("tail", F.lit(0.5)).alias("t1"))
    out = links.join(own, ["pattern_uid", "link_idx"], "left").join(key, "link_key", "left")
    return out.withColumn("head", F.coalesce("h0", "h1", F.lit(float(down)))).withColumn("tail", F.coalesce("t0", "t1", F.lit(float(up)))).drop("h0", "h1", "t0", "t1")


def with_geometry(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Segments with ``geometry``, their part of the link's line (taken to be as long as the link)."""
    import pyarrow as pa

    from .geometry import cut

    kind = pa.list_(pa.list_(pa.float64()))

    def run(batches):
        for batch in batches:
            cols = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("__line", "__len", "offset_m", "len_m")]
            lines = [cut(line, a, a + m, nominal=whole).tolist() if line else None for line, whole, a, m in zip(*cols, strict=True)]
            kept = batch.drop_columns(["__line", "__len"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lines, kind)], names=[*kept.schema.names, "geometry"])

    joined = segments.join(links.select("pattern_uid", "link_idx", F.col("geometry").alias("__line"), F.col("len_m").alias("__len")), ["pattern_uid", "link_idx"])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema)
    return joined.select(*segments.columns, "__line", "__len").mapInArrow(run, ddl + ", geometry array<array<double>>")
