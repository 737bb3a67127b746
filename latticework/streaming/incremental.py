"""Incremental encoding: coefficients are sums, so a stream of cells updates them batch by batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import binning
from ..plans.spec import GridSpec


def contributions(hist: DataFrame, spec: GridSpec) -> DataFrame:
    """(l.., k.., bin, ic) of each row alone, without aggregation: all axes at once, as a stream takes one aggregation only."""
    out = hist.withColumnRenamed("w", "ic")
    for d in range(len(spec.dims)):
        out = out.withColumn("b", F.explode(binning.haar_levels(f"x{d}", spec.levels(d), True))).filter("b.f <> 0")
        out = out.withColumns({f"l{d}": F.col("b.l"), f"k{d}": F.col("b.k"), "ic": F.col("ic") * F.col("b.f")}).drop("b")
    return out.select(*spec.keys, "bin", "ic")


def encode_stream(points: DataFrame, spec: GridSpec) -> DataFrame:
    """A streaming table of coefficients from a stream of rows (x.., bin): for output mode complete or update."""
    return contributions(points.withColumn("w", F.lit(1).cast("long")), spec).groupBy(*spec.keys, "bin").agg(F.sum("ic").alias("ic"))


def merge_batches(points: DataFrame, spec: GridSpec, path: str, checkpoint: str):
    """A query that appends every micro-batch's sums to ``path`` under its batch number; a batch that is tried again replaces itself.

    Sums add up over batches: ``merged`` reads them. Restarting goes on from the checkpoint, and no batch counts twice.
    """
    from ..operators import cells, wavelet

    def store(batch: DataFrame, number: int) -> None:
        hist = cells.cell_histogram(batch, spec.axes, F.col("bin"))
        wavelet.encode(hist, spec).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def merged(stored: DataFrame, spec: GridSpec) -> DataFrame:
    return stored.groupBy(*spec.keys, "bin").agg(F.sum("ic").alias("ic")).filter("ic <> 0")


def store_updates(table: DataFrame, path: str, checkpoint: str):
    """A query that writes what each micro-batch changes of a running aggregation to ``path`` under its number; a batch that is tried again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return table.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def latest(stored: DataFrame, spec: GridSpec) -> DataFrame:
    """The coefficients that store_updates has written, as their last batch left them."""
    return stored.groupBy(*spec.keys, "bin").agg(F.max_by("ic", "batch").alias("ic")).filter("ic <> 0")


def store_cells(points: DataFrame, spec: GridSpec, path: str, checkpoint: str):
    """A query that appends every cell to ``path`` when it first comes, however many rows and bins it has: a stateful deduplication by cell, and the file sink's exactly-once log."""
    cells = points.select(*spec.axes).dropDuplicates(spec.axes)
    return cells.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def complete(points: DataFrame, spec: GridSpec) -> DataFrame:
    """(l.., k.., seen, expected, done): how many of the cells under each coefficient have come; done ones can't change any more.

    points has one row per cell (of cells with many rows or bins, the distinct ones; of a stream, what store_cells has written). Cells beyond the data count as having come.
    """
    out = points.select(*spec.axes).withColumn("n", F.lit(1))
    for d in range(len(spec.dims)):
        out = out.withColumn("b", F.explode(binning.haar_levels(f"x{d}", spec.levels(d), True))).withColumns({f"l{d}": F.col("b.l"), f"k{d}": F.col("b.k")}).drop("b")
    seen = out.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("seen"))
    expected = []
    for d, n in enumerate(spec.dims):
        w = F.pow(F.lit(2.0), spec.levels(d) - F.greatest(F.col(f"l{d}"), F.lit(1))).cast("long")
        expected.append(F.least(F.lit(n).cast("long"), (F.col(f"k{d}") + 1) * w) - F.col(f"k{d}") * w)
    seen = seen.withColumn("expected", reduce(lambda a, b: a * b, expected))
    return seen.withColumn("done", F.col("seen") >= F.col("expected"))
