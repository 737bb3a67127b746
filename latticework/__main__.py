"""Command line: ``python -m latticework encode | query | entropy | median | blocks | stats``."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from .api import PARTS, ROUTES, GridStore
from .sources import netcdf, nrrd


def numbers(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(","))


def table(spark: SparkSession, own: argparse.Namespace) -> DataFrame:
    """The rows to encode: a Parquet table, or a volume with its axes as columns."""
    if own.format == "parquet":
        return spark.read.parquet(own.table)
    (nrrd if own.format == "nrrd" else netcdf).register(spark)
    options = {k: v for k, v in (("variable", own.variable), ("slab", own.slab)) if v}
    return spark.read.format(own.format).options(**options).load(own.table)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="latticework")
    commands = parser.add_subparsers(dest="command", required=True)
    make = commands.add_parser("encode", help="bin a table's rows, encode and store them")
    make.add_argument("table", help="a Parquet table, or a volume")
    make.add_argument("--format", choices=["parquet", "nrrd", "netcdf"], default="parquet")
    make.add_argument("--variable", help="of a NetCDF volume: one, or several with commas between")
    make.add_argument("--slab", help="of a NetCDF volume: ranges of dimensions, such as t=0:1,z=12:13")
    make.add_argument("--budget", type=int, help="store coefficients in two tiers too, with so many values in the hot one")
    make.add_argument("store")
    make.add_argument("--coords", nargs="+", required=True, help="an SQL expression per axis")
    make.add_argument("--value", required=True, help="an SQL expression")
    make.add_argument("--dims", type=numbers, required=True)
    make.add_argument("--n-bins", type=int, default=8)
    make.add_argument("--compression", default="zstd")
    make.add_argument("--level", type=int, help="of gzip or zstd")
    make.add_argument("--contour", action="store_true", help="shares of all bins in the cells between neighbours, by interpolation")
    make.add_argument("--only", choices=PARTS, nargs="+", default=list(PARTS), help="what to store; bins always are")
    ask = commands.add_parser("query", help="histograms of boxes (lo, hi]")
    ask.add_argument("store")
    which = ask.add_mutually_exclusive_group(required=True)
    which.add_argument("--box", nargs=2, type=numbers, action="append", metavar=("LO", "HI"))
    which.add_argument("--random", type=int, help="so many boxes, at places that are the same every time")
    ask.add_argument("--window", type=int, default=1, help="edge of random boxes")
    ask.add_argument("--route", choices=ROUTES, default="coefs")
    ask.add_argument("--bins", nargs=2, type=int, metavar=("FIRST", "LAST"), help="the weight of these bins together, by two lookups a coefficient")
    for name in ("entropy", "median"):
        field = commands.add_parser(name, help=f"{name} over a sliding window")
        field.add_argument("store")
        field.add_argument("--radius", type=int, default=1)
        field.add_argument("--groups", type=int, default=0)
    blocks = commands.add_parser("blocks", help="a statistic of every block of a level")
    blocks.add_argument("store")
    blocks.add_argument("--level", type=int, default=2)
    blocks.add_argument("--stat", choices=["mean", "stddev", "entropy", "count"], default="entropy")
    commands.add_parser("stats", help="size of the store").add_argument("store")
    for sub in commands.choices.values():
        sub.add_argument("--out", help="write the result as Parquet instead of showing it")
        sub.add_argument("--times", action="store_true", help="print the seconds of each phase as JSON on the error stream")
    own = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("latticework").getOrCreate()
    began, phases = time.time(), {}
    if own.command == "encode":
        rows = table(spark, own)
        phases["open"] = time.time() - began
        grid = GridStore.encode(rows, [F.expr(c) for c in own.coords], F.expr(own.value), own.dims, own.n_bins, own.store, own.compression, own.level, own.contour, tuple(own.only), own.budget)
        phases["encode"] = time.time() - began - phases["open"]
        result = grid.statistics() if "coefs" in own.only else grid.bins.groupBy("bin").agg(F.sum("w").alias("w"))
    else:
        grid = GridStore(spark, own.store)
        if own.command == "query":
            boxes = grid.random_boxes(own.window, own.random) if own.random else grid.boxes(*own.box)
            if own.bins:
                result = grid.region_intervals(boxes.withColumns({"b0": F.lit(own.bins[0]), "b1": F.lit(own.bins[1])})).orderBy("qid")
            else:
                result = grid.region_histogram(boxes, own.route).orderBy("qid", "bin")
        elif own.command in ("entropy", "median"):
            result = getattr(grid, f"{own.command}_field")(own.radius, own.groups)
        else:
            result = grid.block_statistics(own.level, own.stat) if own.command == "blocks" else grid.statistics()
    last = time.time()
    if own.out:
        result.write.mode("overwrite").parquet(own.out)
    else:
        result.show(64, truncate=False)
    if own.times:
        print(json.dumps({k: round(v, 3) for k, v in (phases | {"answer": time.time() - last}).items()}), file=sys.stderr)


if __name__ == "__main__":
    main()
