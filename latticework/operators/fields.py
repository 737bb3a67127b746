"""Statistics of histograms, and fields of them over sliding boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.binning import entropy_term
from ..plans.spec import GridSpec
from . import sat


def stat_mean(bin_: str = "bin", v: str = "w") -> Column:
    return F.sum(F.col(bin_) * F.col(v)) / F.sum(v)


def stat_stddev(bin_: str = "bin", v: str = "w") -> Column:
    """Of the population, from sums."""
    mean = stat_mean(bin_, v)
    return F.sqrt(F.greatest(F.sum(F.col(bin_) * F.col(bin_) * F.col(v)) / F.sum(v) - mean * mean, F.lit(0.0)))


def stat_entropy(v: str = "w") -> Column:
    """In bits; values that aren't positive add nothing."""
    return (F.log(F.sum(v).cast("double")) - F.sum(entropy_term(F.col(v).cast("double"))) / F.sum(v)) / math.log(2.0)


def stat_count(v: str = "w") -> Column:
    """Bins that aren't empty."""
    return F.count(F.when(F.col(v) != 0, 1))


STATISTICS = {"mean": stat_mean, "stddev": stat_stddev, "entropy": stat_entropy, "count": stat_count}


def grouped_bins(hist: DataFrame, spec: GridSpec, groups: int) -> tuple[DataFrame, int, int]:
    """hist with bin as one of ``groups`` groups of floor(n / groups) bins (0: every bin); bins that are left over are dropped. Also groups and bins a group."""
    groups = groups or spec.n_bins
    each = spec.n_bins // groups
    kept = hist.filter(F.col("bin") < each * groups).withColumn("bin", F.floor(F.col("bin") / each).cast("int"))
    return kept.groupBy(*spec.axes, "bin").agg(F.sum("w").alias("w")), groups, each


def _windows(hist: DataFrame, spec: GridSpec, left: tuple[int, ...], right: tuple[int, ...], groups: int) -> tuple[DataFrame, int, int]:
    kept, groups, each = grouped_bins(hist, spec, groups)
    full = sat.dense(kept, GridSpec(spec.dims, groups))
    return sat.box_sums(full, spec.axes, ["bin"], left, right), groups, each


def entropy_field(hist: DataFrame, spec: GridSpec, left: tuple[int, ...], right: tuple[int, ...], groups: int = 0) -> DataFrame:
    """(x.., v): entropy of the box (x + left, x + right], of 0 to 1 (1: all groups alike); 0 at the border and for empty boxes."""
    sums, groups, _ = _windows(hist, spec, left, right, groups)
    total = F.sum("w").cast("double")
    v = (F.log(total) - F.sum(entropy_term(F.col("w").cast("double"))) / total) / math.log(groups) if groups > 1 else F.lit(0.0)
    out = sums.groupBy(*spec.axes).agg(F.when(F.sum("w") > 0, v).otherwise(F.lit(0.0)).alias("v"))
    return sat.clamp_border(out, spec, left, right)


def median_field(hist: DataFrame, spec: GridSpec, left: tuple[int, ...], right: tuple[int, ...], groups: int = 0) -> DataFrame:
    """(x.., v): the bin at which half of the box is reached, interpolated within the group from its lower edge; 0 at the border and for empty boxes."""
    sums, _, each = _windows(hist, spec, left, right, groups)
    cell = Window.partitionBy(*spec.axes)
    upto = cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    p = F.col("w") / F.sum("w").over(cell)
    sums = sums.withColumns({"p": p, "cum": F.coalesce(F.sum("w").over(upto), F.lit(0)) / F.sum("w").over(cell)})
    here = (F.col("cum") <= 0.5) & (F.col("cum") + F.col("p") > 0.5)
    v = F.max(F.when(here, each * (F.col("bin") + (0.5 - F.col("cum")) / F.col("p"))))
    return sat.clamp_border(sums.groupBy(*spec.axes).agg(F.coalesce(v, F.lit(0.0)).alias("v")), spec, left, right)


def statistic_field(hist: DataFrame, spec: GridSpec, left: tuple[int, ...], right: tuple[int, ...], stat: str) -> DataFrame:
    """(x.., v): a statistic of STATISTICS over the sliding box; 0 at the border and for empty boxes."""
    sums, _, _ = _windows(hist, spec, left, right, 0)
    out = sums.groupBy(*spec.axes).agg(F.when(F.sum("w") > 0, STATISTICS[stat]().cast("double")).otherwise(F.lit(0.0)).alias("v"))
    return sat.clamp_border(out, spec, left, right)


def time_histogram(hist: DataFrame, lo: tuple[int, ...], hi: tuple[int, ...], time: str) -> DataFrame:
    """(t, bin, h) of a fixed box (lo, hi] over the other axes, for each step (t - 1, t]."""
    kept = hist
    for d, (a, b) in enumerate(zip(lo, hi, strict=True)):
        kept = kept.filter((F.col(f"x{d}") > a) & (F.col(f"x{d}") <= b))
    return kept.filter(F.col(time) > 0).groupBy(F.col(time).alias("t"), "bin").agg(F.sum("w").alias("h"))
