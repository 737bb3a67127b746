"""A stored grid: its spec, cell histogram, summed-area tables and coefficients under one path, with the usual questions as methods."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import binning
from .operators import cells, fields, intervals, rays, sat, tree, udf, wavelet
from .plans.spec import GridSpec
from .sources import store, tiers


PARTS = ("bins", "coefs", "sat")
ROUTES = ("coefs", "lookup", "tiers", "sat", "bins")


class GridStore:
    """Read from what ``encode`` has written. Every answer is a DataFrame; nothing is computed before it is asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.parquet(f"{self.path}/spec").first()
        self.spec = GridSpec(tuple(row["dims"]), row["n_bins"], row["vmin"], row["vmax"])

    @classmethod
    def encode(
        cls,
        df: DataFrame,
        coords: list[Column],
        value: Column,
        dims: tuple[int, ...],
        n_bins: int,
        path: str,
        compression: str = "zstd",
        level: int | None = None,
        contour: bool = False,
        parts: tuple[str, ...] = PARTS,
        budget: int | None = None,
    ) -> GridStore:
        """Bins a value over its range, aggregates and stores. Later runs need no second look at the data's range.

        Each row goes to its linear bin. With contour the rows are a field instead, averaged per cell, and every unit cell between 2^D neighbours has the
        shares of its values in all bins. parts: which of bins, coefs and sat to store (bins always are). budget: coefficients are stored in two tiers as well,
        with so many values in the hot one (0 is a tier of none).
        """
        points = cells.cells(df, coords, value)
        if contour:
            points = points.dropna().groupBy(*(f"x{d}" for d in range(len(dims)))).agg(F.avg("value").alias("value"))
        spec = GridSpec(tuple(dims), n_bins).with_range(points, "value")
        spark = df.sparkSession
        spec.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")
        if contour and spec.vmin is not None:
            hist = binning.contour_spectrum(cells.corners(points, len(dims)), len(dims), n_bins, spec.vmin, spec.vmax)
        else:
            hist = cells.linear_histogram(points, spec)
        store.write_bins(hist, f"{path}/bins", spec.axes, compression=compression, level=level)
        hist = store.read_bins(spark, f"{path}/bins")
        if "coefs" in parts:
            store.write_coefs(wavelet.encode(hist, spec), f"{path}/coefs", compression, level)
            if budget is not None:
                tiers.TieredStore.write(store.read_store(spark, f"{path}/coefs"), f"{path}/tiers", spec, budget, compression, level).close()
        if "sat" in parts:
            store.write_sat(sat.sat(hist, spec), f"{path}/sat", compression, level)
        return cls(spark, path)

    @property
    def bins(self) -> DataFrame:
        return store.read_bins(self.spark, f"{self.path}/bins")

    @property
    def coefs(self) -> DataFrame:
        return store.read_store(self.spark, f"{self.path}/coefs")

    @property
    def sat(self) -> DataFrame:
        return store.read_store(self.spark, f"{self.path}/sat")

    def size(self) -> tuple[int, ...]:
        return self.spec.dims

    def levels(self) -> tuple[int, ...]:
        return tuple(self.spec.levels(d) for d in range(len(self.spec.dims)))

    def n_bins(self) -> int:
        return self.spec.n_bins

    def boxes(self, *pairs: tuple[tuple[int, ...], tuple[int, ...]]) -> DataFrame:
        """Boxes (lo, hi] numbered from 0."""
        n = len(self.spec.dims)
        names = ", ".join(["qid int", *(f"lo{d} int" for d in range(n)), *(f"hi{d} int" for d in range(n))])
        return self.spark.createDataFrame([(i, *lo, *hi) for i, (lo, hi) in enumerate(pairs)], names)

    def random_boxes(self, window: int, count: int) -> DataFrame:
        """Boxes of one edge at places that are the same every time."""
        return sat.random_boxes(self.spark, self.spec, window, count)

    @cached_property
    def tiered(self) -> tiers.TieredStore:
        """The coefficients in two tiers, of a store that was encoded with a budget; the hot one stays in memory until ``tiered.close()``."""
        return tiers.TieredStore(self.spark, f"{self.path}/tiers", self.spec)

    def region_histogram(self, boxes: DataFrame, route: str = "coefs") -> DataFrame:
        """(qid, bin, h): from all coefficients with the coarse ones sent to every task (coefs), from the folders and row groups that the boxes need (lookup: for few
        boxes), from two tiers under a budget (tiers), from summed-area tables (sat) or from cells (bins)."""
        if route == "coefs":
            return wavelet.region_sums(self.coefs, boxes, self.spec, stored=True)
        if route == "lookup":
            found = store.lookup(self.coefs, wavelet.wanted(boxes, self.spec))
            return found.groupBy("qid", "bin").agg(F.sum(F.col("ic") * F.col("s")).alias("h")).filter("h <> 0")
        if route == "tiers":
            return self.tiered.region_sums(boxes)
        return sat.region_sums(self.sat, boxes, self.spec) if route == "sat" else sat.region_brute(self.bins, boxes, self.spec)

    def region_intervals(self, boxes: DataFrame) -> DataFrame:
        """(qid, h) of boxes with a range of bins each (b0, b1), by two lookups a coefficient."""
        return intervals.region_intervals(wavelet.bin_cumsum(self.coefs, self.spec), boxes, self.spec)

    def pick(self, asked: DataFrame) -> DataFrame:
        """(ray, k0 .., t): the deepest block with data that each ray (ray, o0 .., v0 ..) meets first."""
        return rays.pick(asked, tree.build(self.coefs, self.spec), self.spec)

    def coef_sparse(self, levels: tuple[int, ...], place: tuple[int, ...]) -> DataFrame:
        return wavelet.coef_sparse(self.coefs, levels, place)

    def bin_aggregate(self, lo: int, hi: int) -> DataFrame:
        """(x.., s): the summed-area table of a range of bins."""
        return wavelet.decode_bins(self.coefs, self.spec, lo, hi)

    def region_sum(self, lo: int, hi: int, left: tuple[int, ...], right: tuple[int, ...]) -> DataFrame:
        """(x.., v): weight of a range of bins in the sliding box, 0 at the border."""
        summed = sat.box_sums(sat.dense(self.bins.filter(F.col("bin").between(lo, hi)), self.spec), self.spec.axes, ["bin"], left, right)
        field = summed.groupBy(*self.spec.axes).agg(F.sum("w").cast("double").alias("v"))
        return sat.clamp_border(field, self.spec, left, right)

    def entropy_field(self, radius: int = 1, groups: int = 0) -> DataFrame:
        n = len(self.spec.dims)
        return fields.entropy_field(self.bins, self.spec, (-radius,) * n, (radius,) * n, groups)

    def median_field(self, radius: int = 1, groups: int = 0) -> DataFrame:
        n = len(self.spec.dims)
        return fields.median_field(self.bins, self.spec, (-radius,) * n, (radius,) * n, groups)

    def block_statistics(self, level: int, stat: str) -> DataFrame:
        """(k.., v) over blocks of edge 2^level."""
        return wavelet.block_values(self.coefs, self.spec, level).groupBy(*(f"k{d}" for d in range(len(self.spec.dims)))).agg(fields.STATISTICS[stat]().alias("v"))

    def apply_filter(self, function: Callable[[np.ndarray], float], left: tuple[int, ...], right: tuple[int, ...], batched: bool = False) -> DataFrame:
        return udf.apply_filter(self.bins, self.spec, function, left, right, batched)

    def statistics(self) -> DataFrame:
        return wavelet.compression(self.coefs, self.spec)
