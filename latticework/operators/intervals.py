"""Ranges of bins by two lookups: sparse running sums over bins, and a lower-bound (as-of) join into them.

A coefficient's running sum is stored at its own bins only. The sum of bins lo to hi is the running sum at the last stored bin not above hi, less that at the last one
below lo. So a box and a range of bins fetch two values of each coefficient they touch, not all bins between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.spec import GridSpec
from . import wavelet


def as_of(stored: DataFrame, asked: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """asked (keys.., at; distinct) with the value of the last stored row of equal keys whose ``at`` isn't above; without one there is no row.

    Both sides are sorted together by key. A key's rows are bounded by the distinct values of ``at``, however many lookups stand behind a row of asked.
    """
    there = stored.join(asked.select(*keys).distinct(), keys, "left_semi").select(*keys, at, value, F.lit(False).alias("ask"))
    both = there.unionByName(asked.select(*keys, at, F.lit(None).cast(stored.schema[value].dataType).alias(value), F.lit(True).alias("ask")))
    run = Window.partitionBy(*keys).orderBy(at, "ask").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn(value, F.last(value, ignorenulls=True).over(run))
    return last.filter(F.col("ask") & F.col(value).isNotNull()).drop("ask")


def region_intervals(summed: DataFrame, boxes: DataFrame, spec: GridSpec) -> DataFrame:
    """(qid, h) of boxes (qid, lo0 .., hi0 .., b0, b1): the weight of bins b0 to b1 inside (lo, hi]; 0 where there is none. summed: wavelet.bin_cumsum, stored or not.

    qid must be distinct. Bounds may lie outside the bins; of an empty range (b1 < b0) it is 0.
    """
    edge = F.explode(F.array(F.struct(F.col("b1").cast("int").alias("bin"), F.lit(1).alias("side")), F.struct((F.col("b0") - 1).cast("int").alias("bin"), F.lit(-1).alias("side"))))
    edges = boxes.filter("b1 >= b0").select("qid", edge.alias("e")).select("qid", "e.bin", "e.side").filter("bin >= 0")
    asked = wavelet.wanted(boxes, spec).join(edges, "qid")
    found = as_of(summed, asked.select(*spec.keys, "bin").distinct(), spec.keys, "bin", "cum")
    sums = asked.join(found, [*spec.keys, "bin"]).groupBy("qid").agg(F.sum(F.col("cum") * F.col("s") * F.col("side")).alias("h"))
    return boxes.select("qid").join(sums, "qid", "left").select("qid", F.coalesce("h", F.lit(0.0)).alias("h"))
