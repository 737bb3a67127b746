"""Stored coefficients in two tiers under a budget of values: the most populated wavelets hot, held in executors' memory, the others cold, read by folder when needed.

A wavelet (a level along every axis) goes hot as a whole. Greedily, the one with the fullest coefficient first, each is taken that still fits the budget.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import wavelet
from ..plans.spec import GridSpec
from .manifest import Manifests
from .store import _writer, address_order, narrowed


def number(spec: GridSpec) -> Column:
    """A wavelet's number: its levels as digits."""
    return reduce(lambda a, b: a * F.lit(b[1]) + b[0], [(F.col(f"l{d}"), spec.levels(d)) for d in range(1, len(spec.dims))], F.col("l0")).cast("int")


def chosen(coefs: DataFrame, spec: GridSpec, budget: int) -> list[int]:
    """Numbers of the wavelets that fit a budget of values. One row a wavelet comes to the driver: the product of the axes' levels at most."""
    places = coefs.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"))
    sizes = places.groupBy(number(spec).alias("wavelet")).agg(F.max("n").alias("most"), F.sum("n").alias("values")).collect()
    hot, used = [], 0
    for r in sorted(sizes, key=lambda r: (-r["most"], r["wavelet"])):
        if used + r["values"] <= budget:
            hot.append(r["wavelet"])
            used += r["values"]
    return hot


class TieredStore:
    """Coefficients (l.., k.., bin, ic) in ``path`` as ``write`` has left them. ``close`` gives the hot tier's memory back."""

    def __init__(self, spark: SparkSession, path: str, spec: GridSpec):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec
        self.hot_wavelets: list[int] = Manifests(spark, f"{self.path}/manifests").read()["hot"]
        self.stored = spark.read.parquet(f"{self.path}/tiers").withColumn("wavelet", F.col("wavelet").cast("int"))
        self.hot = self.stored.filter("tier = 'hot'").persist(StorageLevel.MEMORY_AND_DISK) if self.hot_wavelets else None

    @classmethod
    def write(cls, coefs: DataFrame, path: str, spec: GridSpec, budget: int, compression: str = "zstd", level: int | None = None) -> TieredStore:
        """Stores coefs with a budget of so many values for the hot tier (0: none; a value has eight bytes and its address in memory)."""
        keys = address_order(spec.keys)
        hot = chosen(coefs, spec, budget)
        tier = F.when(F.col("wavelet").isin(hot), "hot").otherwise("cold") if hot else F.lit("cold")
        rows = coefs.withColumn("wavelet", number(spec)).withColumn("tier", tier).repartitionByRange("wavelet", *keys).sortWithinPartitions("wavelet", *keys)
        _writer(rows, compression, level).partitionBy("tier", "wavelet").parquet(f"{path.rstrip('/')}/tiers")
        log = Manifests(coefs.sparkSession, f"{path.rstrip('/')}/manifests")
        log.commit({"hot": sorted(hot), "budget": budget}, log.read().get("version", -1))
        return cls(coefs.sparkSession, path, spec)

    def lookup(self, addresses: DataFrame) -> DataFrame:
        """Coefficients at addresses (l.., k.., and what else each carries). Addresses of hot wavelets meet the hot tier only; of the cold one those folders and row groups are
        read that the others name, none if there are no others."""
        asked = addresses.withColumn("wavelet", number(self.spec))
        out = []
        if self.hot is not None:
            out.append(self.hot.join(asked.filter(F.col("wavelet").isin(self.hot_wavelets)), ["wavelet", *self.spec.keys]))
            asked = asked.filter(~F.col("wavelet").isin(self.hot_wavelets))
        if self.spec.n_wavelets > len(self.hot_wavelets):
            out.append(narrowed(self.stored.filter("tier = 'cold'"), asked, "wavelet").join(asked, ["wavelet", *self.spec.keys]))
        names = [*addresses.columns, "bin", "ic"]
        return reduce(DataFrame.unionByName, [x.select(*names) for x in out])

    def region_sums(self, boxes: DataFrame) -> DataFrame:
        """(qid, bin, h) of boxes (lo, hi]."""
        found = self.lookup(wavelet.wanted(boxes, self.spec))
        return found.groupBy("qid", "bin").agg(F.sum(F.col("ic") * F.col("s")).alias("h")).filter("h <> 0")

    def close(self) -> None:
        if self.hot is not None:
            self.hot.unpersist()
