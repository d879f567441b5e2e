"""Command line: run, tune, hotspots, inspect, compare, sensitivity-table."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from dwellscope import run as api
from dwellscope.config import Config
from dwellscope.sources import sinks


def _period(text: str) -> tuple[str, str]:
    first, sep, last = text.partition("..")
    if not sep:
        raise argparse.ArgumentTypeError("a period is YYYY-MM-DD..YYYY-MM-DD")
    return first, last


def _settings(args, path: str | None = None) -> Config:
    cfg = Config.from_toml(path or args.config)
    if args.segment_m:
        cfg = replace(cfg, params=replace(cfg.params, segment_m=args.segment_m))
    return replace(cfg, select=replace(cfg.select, dates=args.dates)) if args.dates else cfg


def _run(spark, args):
    out = api.run(spark, _settings(args), hotspots=not args.no_hotspots, log=args.say)
    doc = api.save(out, args.out, args.title, not args.no_html)
    if not args.no_png:
        sinks.figures(doc, args.out)


def _tune(spark, args):
    pre = api.prepare(spark, _settings(args), args.say)
    table, best, ok = api.tune(pre, tuple(float(x) for x in args.lengths.split(",")), args.bootstrap)
    print(sinks.markdown_table(table, 3))
    print(f"recommended: {best:g} m" + ("" if ok else " (default: no length passed)"))
    if args.out:
        table.write.mode("overwrite").parquet(f"{args.out}/tune.parquet")
    if args.sensitivity:
        print(sinks.markdown_table(api.sensitivity(pre), 3))


def _hotspots(spark, args):
    out = api.run(spark, _settings(args), log=args.say)
    rows = out.hotspots.orderBy("direction_id", "rank")
    print(sinks.markdown_table(rows.select("direction_id", "rank", "from_stop", "to_stop", "kind", "criterion", "peak_hour", "excess_s_per_passage"), 1))
    if args.out:
        if args.out.endswith(".csv"):
            rows.withColumn("hours", F.array_join("hours", " ")).withColumn("peak_hours", F.array_join("peak_hours", " ")).coalesce(1).write.mode("overwrite").csv(args.out, header=True)
        elif args.out.endswith(".parquet"):
            rows.write.mode("overwrite").parquet(args.out)


def _inspect(spark, args):
    for name, df in api.inspect(api.prepare(spark, _settings(args), args.say)).items():
        print(f"## {name}\n{sinks.markdown_table(df.select(*[F.array_join(c, ' ').alias(c) if k.startswith('array') else F.col(c) for c, k in df.dtypes]))}\n")


def _compare(spark, args):
    out = api.run_compare(spark, _settings(args), args.a, args.b, args.bootstrap)
    api.save_compare(out, args.out)
    rows = out.changes.orderBy("direction_id", "rank")
    print(sinks.markdown_table((rows.limit(args.top) if args.top else rows).select("direction_id", "rank", "sign", "from_m", "to_m", "peak_hour", "delta_s"), 1))


def _sensitivity(spark, args):
    table = None
    for path in args.configs:
        cfg = _settings(args, path)
        one = api.sensitivity(api.prepare(spark, cfg, args.say), n_draws=args.bootstrap).withColumn("line", F.lit(cfg.select.route))
        table = one if table is None else table.unionByName(one)
    text = sinks.markdown_table(table, 3)
    print(text)
    if args.out:
        table.write.mode("overwrite").parquet(f"{args.out}/sensitivity_table.parquet")
        sinks.write_text(text, f"{args.out}/sensitivity_table.md")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="dwellscope")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name, fn, out=None, many=False):
        p = verbs.add_parser(name)
        p.add_argument("configs" if many else "config", nargs="+" if many else None)
        p.add_argument("--segment-m", type=float)
        p.add_argument("--dates")
        p.add_argument("-q", "--quiet", action="store_true")
        p.add_argument("-o", "--out", default=out)
        p.set_defaults(fn=fn)
        return p

    p = verb("run", _run, "out")
    p.add_argument("--title")
    for flag in ("--no-html", "--no-png", "--no-hotspots"):
        p.add_argument(flag, action="store_true")
    p = verb("tune", _tune)
    p.add_argument("--lengths", default="10,15,20,30,40,50,75,100")
    p.add_argument("--bootstrap", type=int, default=100)
    p.add_argument("--sensitivity", action="store_true")
    verb("hotspots", _hotspots)
    verb("inspect", _inspect)
    p = verb("compare", _compare, "out_compare")
    p.add_argument("--a", type=_period, required=True)
    p.add_argument("--b", type=_period, required=True)
    p.add_argument("--bootstrap", type=int)
    p.add_argument("--top", type=int, default=20)
    p = verb("sensitivity-table", _sensitivity, many=True)
    p.add_argument("--bootstrap", type=int, default=100)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    args.say = (lambda s: None) if args.quiet else (lambda s: print(s, file=sys.stderr))
    args.fn(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
