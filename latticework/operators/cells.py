"""Cells, their histograms, and histograms of whole grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import binning
from ..plans.spec import GridSpec


def cells(df: DataFrame, coords: list[Column], value: Column) -> DataFrame:
    """(x0 .., value) of each row."""
    return df.select(*(c.cast("int").alias(f"x{d}") for d, c in enumerate(coords)), value.alias("value"))


def cell_histogram(points: DataFrame, axes: list[str], bin_: Column, weight: Column | None = None) -> DataFrame:
    """(x.., bin, w): weight (1: a whole number) of each cell and bin. Rows without a bin (null values) or without a coordinate count nowhere."""
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return points.withColumn("bin", bin_).dropna(subset=["bin", *axes]).groupBy(*axes, "bin").agg(w.alias("w"))


def multi_bin_histogram(points: DataFrame, axes: list[str], bins: Column) -> DataFrame:
    """As cell_histogram for values that map to many bins: an array of structs (bin, w)."""
    return points.select(*axes, F.explode(bins).alias("b")).groupBy(*axes, F.col("b.bin").alias("bin")).agg(F.sum("b.w").alias("w"))


def histogram(hist: DataFrame) -> DataFrame:
    """(bin, w) of the whole grid."""
    return hist.groupBy("bin").agg(F.sum("w").alias("w"))


def linear_histogram(points: DataFrame, spec: GridSpec) -> DataFrame:
    """Cell histogram by linear bins of the spec's range."""
    return cell_histogram(points, spec.axes, binning.bin_linear(F.col("value"), spec.vmin, spec.vmax, spec.n_bins))


def corners(field: DataFrame, dims: int) -> DataFrame:
    """(x.., c0 ..) of each cell whose 2^D corners are there: values at x - 1 and x along each axis, gathered by one aggregation."""
    axes = [f"x{d}" for d in range(dims)]
    n = 1 << dims
    sides = F.array(*(F.lit(i) for i in range(n)))
    # the value at p is corner i of the cell whose upper corner is p + 1 where bit d of i is 0
    spread = field.select(*axes, "value", F.explode(sides).alias("side"))
    to = [(F.col(f"x{d}") + 1 - F.shiftright(F.col("side"), d).bitwiseAND(F.lit(1))).cast("int").alias(f"x{d}") for d in range(dims)]
    grouped = spread.select(*to, "value", "side").groupBy(*axes)
    found = grouped.agg(F.count(F.lit(1)).alias("n"), *(F.max(F.when(F.col("side") == i, F.col("value"))).alias(f"c{i}") for i in range(n)))
    return found.filter(F.col("n") == n).drop("n")
