"""Buffered flushes of coefficients: sorted runs, merged into larger ones, behind a manifest.

A micro-batch is flushed as one run, range-partitioned and sorted by address. When ``fan`` runs of a level are there they are merged into one of the next level, so n
batches leave fewer than fan * log_fan(n) runs and a value is rewritten log_fan(n) times. What is current is named by the last manifest alone: readers of an older
snapshot keep their runs until ``vacuum``, a flush that died leaves only orphans, and a batch that is tried again is known by its number.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import cells, wavelet
from ..plans.spec import GridSpec
from ..sources.manifest import Manifests


class RunStore:
    """Coefficients (l.., k.., bin, ic) in ``path``, added to by batches."""

    def __init__(self, spark: SparkSession, path: str, spec: GridSpec, fan: int = 4):
        self.spark, self.path, self.spec, self.fan = spark, path.rstrip("/"), spec, fan
        self.manifests = Manifests(spark, f"{self.path}/manifests")

    def _write(self, coefs: DataFrame, level: int) -> dict:
        name = f"{level}-{uuid.uuid4().hex}"
        keys = [*self.spec.keys, "bin"]
        coefs.select(*keys, "ic").repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{self.path}/runs/{name}")
        return {"name": name, "level": level}

    def _read(self, runs: list[dict]) -> DataFrame:
        """The runs' coefficients, with equal addresses added up if there are several runs."""
        schema = ", ".join(f"{k} int" for k in [*self.spec.keys, "bin"]) + ", ic long"
        tables = [self.spark.read.schema(schema).parquet(f"{self.path}/runs/{r['name']}") for r in runs]
        if not tables:
            return self.spark.createDataFrame([], schema)
        if len(tables) == 1:
            return tables[0]
        added = reduce(DataFrame.union, tables).groupBy(*self.spec.keys, "bin").agg(F.sum("ic").alias("ic"))
        return added.filter("ic <> 0")

    def append(self, coefs: DataFrame, batch: int) -> None:
        """Flushes a batch's coefficients as a run and merges full levels. A batch whose number isn't above the last one's has been flushed before and changes nothing."""
        now = self.manifests.read()
        if batch <= now.get("batch", -1):
            return
        runs = [*now.get("runs", []), self._write(coefs, 0)]
        level = 0
        while len(same := [r for r in runs if r["level"] == level]) >= self.fan:
            runs = [r for r in runs if r["level"] != level] + [self._write(self._read(same), level + 1)]
            level += 1
        self.manifests.commit({"batch": batch, "runs": runs}, now.get("version", -1))

    def runs(self, version: int | None = None) -> list[dict]:
        return self.manifests.read(version).get("runs", [])

    def read(self, version: int | None = None) -> DataFrame:
        """The coefficients as of a snapshot, the last by default."""
        return self._read(self.runs(version))

    def vacuum(self, keep: int = 1) -> int:
        """Forgets all but the last ``keep`` snapshots and deletes runs that none of these has; gives their number. Not while a batch is being flushed."""
        versions = self.manifests.versions()
        for version in versions[:-keep]:
            self.manifests.forget(version)
        held = {r["name"] for v in versions[-keep:] for r in self.runs(v)}
        gone = [name for name in self.manifests.children(f"{self.path}/runs") if name not in held]
        for name in gone:
            self.manifests.delete(f"{self.path}/runs/{name}")
        return len(gone)


def flush_stream(points: DataFrame, store: RunStore, checkpoint: str):
    """A query writer that flushes every micro-batch of (x.., bin) rows to the store; start it."""

    def flush(batch: DataFrame, number: int) -> None:
        hist = cells.cell_histogram(batch, store.spec.axes, F.col("bin"))
        store.append(wavelet.encode(hist, store.spec), number)

    return points.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True)
