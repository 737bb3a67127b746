"""Coefficients streamed out as they become final: each is emitted once, when the last cell under it has come, and its state is freed.

A stream of cells (every cell of the grid once, empty ones too) is projected and reduced by batch in numpy, so that of a coefficient high up in the tree, which all
cells touch, a batch hands on one row. Keyed state then holds how many of its cells a coefficient has seen, and its sums; at the number expected the sums go out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import packed
from ..plans.spec import GridSpec

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def whole_cells(hist: DataFrame, spec: GridSpec) -> DataFrame:
    """(x.., bins): a row for every cell of the grid, with an array of its (bin, w); empty where hist has none."""
    arrays = hist.groupBy(*spec.axes).agg(F.collect_list(F.struct(F.col("bin").cast("int").alias("bin"), F.col("w").cast("long").alias("w"))).alias("bins"))
    return spec.lattice(hist.sparkSession).join(arrays, spec.axes, "left").withColumn("bins", F.coalesce("bins", F.array().cast(arrays.schema["bins"].dataType)))


def expected(address: int, spec: GridSpec) -> int:
    """Cells of the data under a coefficient (a key without bin)."""
    out = 1
    for d, step in enumerate(packed.strides(spec, 1)):
        place = address // step % spec.padded(d)
        level = int(place).bit_length()
        width = spec.support(d, level)
        k = place - (1 << (level - 1)) if level else 0
        out *= min(spec.dims[d], (k + 1) * width) - k * width
    return out


def partial_sums(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """(address, seen, bins, sums): of each batch of (x.., bins), the cells under each coefficient and what they add to its bins."""
    steps, one = packed.strides(spec, spec.n_bins), packed.strides(spec, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.zeros(batch.num_rows, np.int64)
            for d, step in enumerate(one):
                cell += batch.column(d).to_numpy().astype(np.int64) * step
            lists = batch.column(len(one))
            flat, sizes = lists.flatten(), np.diff(np.asarray(lists.offsets))
            keys = np.repeat(cell, sizes) * spec.n_bins + flat.field("bin").to_numpy().astype(np.int64)
            address, seen = packed.projected(cell, np.ones(len(cell), np.int64), spec, one, weighed=False)
            keys, sums = packed.projected(keys, flat.field("w").to_numpy().astype(np.int64), spec, steps)
            keys, sums = keys[sums != 0], sums[sums != 0]
            cuts = np.append(np.searchsorted(keys // spec.n_bins, address), len(keys)).astype(np.int32)
            bins = pa.ListArray.from_arrays(pa.array(cuts), pa.array((keys % spec.n_bins).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(address), pa.array(seen), bins, pa.ListArray.from_arrays(pa.array(cuts), pa.array(sums))], names=["address", "seen", "bins", "sums"]
            )

    return cells.select(*spec.axes, "bins").mapInArrow(run, "address long, seen long, bins array<int>, sums array<long>")


class _Final(StatefulProcessor):
    """Adds up a coefficient's rows; emits and forgets it when all its cells have come."""

    def __init__(self, spec: GridSpec):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "seen long, bins array<int>, sums array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else (0, [], [])
        seen, total = held[0], dict(zip(held[1], held[2], strict=True))
        for part in rows:
            seen += int(part["seen"].sum())
            for bins, sums in zip(part["bins"], part["sums"], strict=True):
                for b, s in zip(bins, sums, strict=True):
                    total[int(b)] = total.get(int(b), 0) + int(s)
        total = {b: s for b, s in total.items() if s}
        whole = expected(int(key[0]), self.spec)
        if seen > whole:
            raise ValueError(f"coefficient {key[0]} has seen {seen} of {whole} cells: a cell has come twice")
        if seen < whole:
            self.held.update((seen, list(total), list(total.values())))
            return
        self.held.clear()
        yield pd.DataFrame({"address": np.full(len(total), key[0]), "bin": np.array(list(total), "int32"), "ic": np.array(list(total.values()), "int64")})

    def close(self) -> None:
        pass


def final_coefficients(cells: DataFrame, spec: GridSpec, repeats: bool = False) -> DataFrame:
    """A stream of (l.., k.., bin, ic), in append mode: every coefficient that isn't 0 once, when its last cell has come. cells: a stream of whole_cells.

    Cells beyond the data count as having come. A cell must come once: one that comes again before its coefficients are final is an error, and after that it begins
    coefficients anew that never become final. With repeats the first of a cell's rows counts and others are passed over, for a state of one row a cell that stays. State is as large as what is open: a coefficient's bins, at most all of them. Start it with ``rocks``.
    """
    cells = cells.dropDuplicates(spec.axes) if repeats else cells
    out = partial_sums(cells, spec).groupBy("address").transformWithStateInPandas(_Final(spec), "address long, bin int, ic long", "append", "none")
    return out.select(*packed.place_columns("address", spec, 1), "bin", "ic")


@contextmanager
def rocks(spark: SparkSession):
    """Queries started within keep their state in RocksDB, as keyed state needs; the session's own setting returns afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def store_final(cells: DataFrame, spec: GridSpec, path: str, checkpoint: str, repeats: bool = False):
    """Starts a query that appends final coefficients to Parquet at ``path``, each exactly once over restarts (the sink's log and the checkpoint), and returns it."""
    with rocks(cells.sparkSession):
        sink = final_coefficients(cells, spec, repeats).writeStream.outputMode("append").format("parquet").option("path", path)
        return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
