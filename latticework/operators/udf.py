"""User-defined filters, statistics and binnings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.spec import GridSpec
from . import sat


def apply_filter(
    hist: DataFrame, spec: GridSpec, function: Callable[[np.ndarray], float], left: tuple[int, ...], right: tuple[int, ...], batched: bool = False
) -> DataFrame:
    """(x.., v): a function of the box's histogram at every cell. The box is (x + left, x + right], its corners clamped to the grid.

    A lower corner clamped to 0 leaves out the grid's first plane, an upper one ends at the last, so the sums are window sums over cells whose first planes are
    emptied. Cells' histograms go through the function in Arrow batches: one array of bins at a time, or (batched) all of a batch as rows of one array.
    """
    inside = reduce(lambda a, b: a & b, [F.col(a) > 0 for a in spec.axes])
    full = sat.dense(hist, spec).withColumn("w", F.when(inside, F.col("w")).otherwise(F.lit(0)))
    sums = sat.box_sums(full, spec.axes, ["bin"], left, right)
    arrays = sums.groupBy(*spec.axes).agg(F.array_sort(F.collect_list(F.struct("bin", "w"))).alias("b"))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = np.stack(part.to_numpy()).astype(float) if len(part) else np.zeros((0, spec.n_bins))
            yield pd.Series(np.asarray(function(rows) if batched else [float(function(row)) for row in rows], float))

    udf = F.pandas_udf(run, "double")
    return arrays.select(*spec.axes, udf(F.transform("b", lambda x: x["w"].cast("double"))).alias("v"))


def statistic(function: Callable[[np.ndarray, np.ndarray], float]) -> Callable[..., Column]:
    """An aggregate of columns (bin, value) from a function of two arrays."""

    def run(bins: pd.Series, values: pd.Series) -> float:
        return float(function(bins.to_numpy(float), values.to_numpy(float)))

    run.__annotations__ = {"bins": pd.Series, "values": pd.Series, "return": float}
    return F.pandas_udf(run, "double")


def binning(function: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Callable[[DataFrame, str], DataFrame]:
    """A table function from a user's binning: of a table and the name of its column of values it gives the other columns with (bin, w), a row for each bin of each row.

    The function gets a batch of values as an array (null: NaN) and returns three arrays: which value a pair belongs to, its bin, its weight; values without a pair have no
    row. The table function is made for the table it is given, whose columns it passes on, and runs on Arrow batches of it where they are, without a shuffle.
    """

    def run(rows: DataFrame, value: str) -> DataFrame:
        keep = [f for f in rows.schema.fields if f.name != value]
        taken = {f.name for f in keep} & {"bin", "w"}
        if taken:
            raise ValueError(f"the table has columns named {taken} already")
        shape = T.StructType([*keep, T.StructField("bin", T.IntegerType()), T.StructField("w", T.DoubleType())])

        class Binned:
            def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
                values = table.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
                owner, bins, weights = (np.asarray(x) for x in function(values))
                others = {f.name: table.column(f.name).take(pa.array(owner.astype(np.int64))) for f in keep}
                yield pa.table(others | {"bin": pa.array(bins.astype(np.int32)), "w": pa.array(weights.astype(float))})

        return F.arrow_udtf(Binned, returnType=shape)(rows.asTable())

    return run
