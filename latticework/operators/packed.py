"""Encoding with packed keys: a coefficient's address and bin are one 64-bit number, and batches are projected and reduced in numpy before one shuffle.

A cell (x0, x1, .., bin) is a number of mixed radix over the padded extents and the bins. A coefficient's place along an axis (0, 1, then 2^(l - 1) + k) has the same
range as a coordinate along it, so projecting an axis replaces one digit and keeps the radix. Tasks reduce what they have projected, over many batches, and give
each key once or few times; the shuffle carries two numbers a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import binning
from ..plans.spec import GridSpec

#: Rows that are projected at once, and reduced rows that a task holds before it gives them away.
AT_ONCE, HELD = 1 << 15, 1 << 20


def strides(spec: GridSpec, bins: int) -> list[int]:
    """What one step along each axis adds to a key; the bin is the last digit. Keys must fit 63 bits."""
    out, step = [], bins
    for d in reversed(range(len(spec.dims))):
        out.append(step)
        step *= spec.padded(d)
    if step >= 1 << 63:
        raise ValueError("addresses and bins don't fit 63 bits")
    return out[::-1]


def reduced(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of each."""
    if not len(keys):
        return keys, sums
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(sums[order], first)


def projected(keys: np.ndarray, sums: np.ndarray, spec: GridSpec, steps: list[int], weighed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Keys of cells as keys of coefficients, one axis after the other; weighed: by the Haar projection, else every coefficient over a cell gets its sum as it is."""
    keys, sums = reduced(keys, sums)
    for d, step in enumerate(steps):
        digit, parts = (keys // step) % spec.padded(d), []
        for level in range(spec.levels(d)):
            width = 1 << (spec.levels(d) - level)
            place = np.zeros_like(digit) if level == 0 else (1 << (level - 1)) + digit // width
            moved, own = keys + (place - digit) * step, sums
            if weighed:
                rest = digit % width
                factor = width // 2 - rest if level == 0 else np.where(rest < width // 2, -rest, rest - width)
                some = factor != 0
                moved, own = moved[some], (own * factor)[some]
            parts.append((moved, own))
        keys, sums = reduced(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    return keys, sums


def packed_cells(batch: pa.RecordBatch, spec: GridSpec, steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of a batch (x0 .., bin, w) without nulls."""
    keys = batch.column(len(steps)).to_numpy().astype(np.int64)
    for d, step in enumerate(steps):
        keys += batch.column(d).to_numpy().astype(np.int64) * step
    return keys, batch.column(len(steps) + 1).to_numpy()


def place_columns(key: str, spec: GridSpec, bins: int) -> list[Column]:
    """The columns l0 .., k0 .. of a column of keys."""
    at = [binning.address(F.expr(f"({key} div {step}) % {spec.padded(d)}")) for d, step in enumerate(strides(spec, bins))]
    return [level.alias(f"l{d}") for d, (level, _) in enumerate(at)] + [k.cast("int").alias(f"k{d}") for d, (_, k) in enumerate(at)]


def encode(hist: DataFrame, spec: GridSpec) -> DataFrame:
    """What wavelet.encode gives: (l0 .., k0 .., bin, ic) of (x0 .., bin, w); hist may hold a cell and bin many times. Whole or fractional weights; rows with a null have no part."""
    steps, kind = strides(spec, spec.n_bins), "double" if hist.schema["w"].dataType.simpleString() in ("double", "float") else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["key", "ic"])

        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64 if kind == "long" else float)
        for batch in batches:
            cells, weights = packed_cells(batch, spec, steps)
            for lo in range(0, len(cells), AT_ONCE):
                new = projected(cells[lo : lo + AT_ONCE], weights[lo : lo + AT_ONCE], spec, steps)
                keys, sums = reduced(np.concatenate([keys, new[0]]), np.concatenate([sums, new[1]]))
                if len(keys) > HELD:
                    yield given(keys, sums)
                    keys, sums = keys[:0], sums[:0]
        if len(keys):
            yield given(keys, sums)

    rows = hist.select(*spec.axes, "bin", F.col("w").cast(kind)).dropna()
    added = rows.mapInArrow(run, f"key long, ic {kind}").groupBy("key").agg(F.sum("ic").alias("ic")).filter("ic <> 0")
    return added.select(*place_columns("key", spec, spec.n_bins), (F.col("key") % spec.n_bins).cast("int").alias("bin"), "ic")
