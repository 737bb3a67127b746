"""From values to bins, and index arithmetic, as columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def bin_linear(value: Column, vmin: Column | float | None, vmax: Column | float | None, n_bins: int) -> Column:
    """floor(n (v - min) / (max - min)) of the clamped value, at most n - 1; 0 if all values are the same. In double precision throughout.

    Null and NaN have no bin (null), nor has any value where the range is unknown (None or null: a table without values).
    """
    lo, hi = (x if isinstance(x, Column) else F.lit(x).cast("double") for x in (vmin, vmax))
    v = value.cast("double")
    clamped = F.greatest(lo, F.least(hi, v))
    bin_ = F.when(hi == lo, 0).otherwise(F.least(F.floor(n_bins * (clamped - lo) / (hi - lo)).cast("int"), F.lit(n_bins - 1)))
    return F.when(v.isNotNull() & ~F.isnan(v) & lo.isNotNull() & hi.isNotNull(), bin_)


def bin_identity(value: Column) -> Column:
    return value.cast("int")


def bin_direction(u: Column, v: Column, n_bins: int, missing_u: float | None = None, missing_v: float | None = None) -> Column:
    """0 for missing vectors (null or the sentinel), 1 for zero length, else 2 + the linear bin of the angle over [-pi, pi]."""
    gone = u.isNull() | v.isNull()
    if missing_u is not None:
        gone = gone | (u == missing_u)
    if missing_v is not None:
        gone = gone | (v == missing_v)
    angle = F.atan2(v + 0.0, u + 0.0)
    step = F.floor(n_bins * (angle + math.pi) / (2 * math.pi)).cast("int")
    return F.when(gone, 0).when((u == 0) & (v == 0), 1).otherwise(2 + F.least(F.lit(n_bins - 1), step))


def index_to_sub(index: Column, dims: tuple[int, ...]) -> list[Column]:
    """Coordinates of a flat index, the first axis fastest."""
    out, rest = [], index.cast("long")
    for n in dims:
        out.append((rest % n).cast("int"))
        rest = F.floor(rest / n)
    return out


def sub_to_index(subs: list[Column], dims: tuple[int, ...]) -> Column:
    out, step = F.lit(0).cast("long"), 1
    for sub, n in zip(subs, dims, strict=True):
        out = out + sub.cast("long") * step
        step *= n
    return out


def entropy_term(h: Column) -> Column:
    """h ln h, 0 where h isn't positive."""
    return F.when(h > 0, h * F.log(h)).otherwise(F.lit(0.0))


def clamp_negative(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0))


def haar_levels(p: str, n_levels: int, forward: bool) -> Column:
    """Array over all levels of structs (l, k, f): the coefficient over coordinate p and, forward, its integer projection, else its weight in the prefix sum.

    Backward weights hold both normalisations (1 / padded length at level 0, else +-1 / support), powers of two, so that sums of whole coefficients are exact.
    """
    c = F.col(p).cast("long")
    out = []
    for level in range(n_levels):
        w = 1 << (n_levels - level)
        q, half = c % w, w // 2
        if forward:
            f = (half - q) if level == 0 else F.when(q < half, -q).otherwise(q - w)
        else:
            f = F.lit(1.0 / half) if level == 0 else F.when(q < half, F.lit(1.0 / w)).otherwise(F.lit(-1.0 / w))
        out.append(F.struct(F.lit(level).alias("l"), F.floor(c / w).cast("int").alias("k"), f.alias("f")))
    return F.array(*out)


def displayed(level: Column) -> Column:
    """Length of a level's basis function relative to whole numbers: sqrt(2^(l - 1)), 1 at level 0."""
    return F.when(level >= 1, F.sqrt(F.pow(F.lit(2.0), level - 1))).otherwise(F.lit(1.0))


def global_index(level: Column, k: Column) -> Column:
    """A coefficient's place in the global order: 0, 1, then 2^(l - 1) + k."""
    return F.when(level == 0, F.lit(0).cast("long")).otherwise(F.pow(F.lit(2.0), level - 1).cast("long") + k)


def address(index: Column) -> tuple[Column, Column]:
    """(level, k) of a place in the global order."""
    level = F.when(index == 0, 0).otherwise(F.length(F.bin(index)))
    return level.cast("int"), F.when(index == 0, index).otherwise(index - F.pow(F.lit(2.0), F.length(F.bin(index)) - 1).cast("long")).cast("long")


def below(values: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Share of a simplex (segment, triangle, tetrahedron) in which a linear function with these vertex values (last axis) is below each t, by the
    closed form of each piece between sorted vertices. Equal vertices make a piece empty, so nothing is divided by zero. Of a constant simplex nothing is below its value."""
    v = np.sort(values, axis=-1)
    a, z = v[..., :1], v[..., -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        if v.shape[-1] == 2:
            pieces = [(t - a) / (z - a)]
        elif v.shape[-1] == 3:
            b = v[..., 1:2]
            pieces = [(t - a) ** 2 / ((b - a) * (z - a)), 1 - (z - t) ** 2 / ((z - a) * (z - b))]
        elif v.shape[-1] == 4:
            b, c = v[..., 1:2], v[..., 2:3]
            middle = (t - a) ** 2 / ((z - a) * (c - a)) + (t - a) * (t - b) * (c - t) / ((z - a) * (c - b) * (c - a)) + (t - b) ** 2 * (z - t) / ((z - b) * (c - b) * (z - a))
            pieces = [(t - a) ** 3 / ((b - a) * (c - a) * (z - a)), middle, 1 - (z - t) ** 3 / ((z - a) * (z - b) * (z - c))]
        else:
            raise ValueError("grids of one to three axes")
    out = np.where(t > z, 1.0, 0.0)
    for i, piece in enumerate(pieces):
        out = np.where((t > v[..., i : i + 1]) & (t <= v[..., i + 1 : i + 2]), piece, out)
    return np.clip(out, 0.0, 1.0)


def contour_spectrum(corners: DataFrame, dims: int, n_bins: int, vmin: float, vmax: float) -> DataFrame:
    """(x.., bin, w): how much of each unit cell has values in each bin, by linear interpolation on simplices.

    corners: x.. and c0 .. c{2^D - 1}, the values at the cell's corners (bit d of the number: upper side along axis d). Each cell is cut along the
    diagonals that all orders of the axes give (2 triangles, 6 tetrahedra); along every odd coordinate the cell is mirrored, so that neighbours fit.
    """
    axes = [f"x{d}" for d in range(dims)]
    edges = vmin + (vmax - vmin) * np.arange(n_bins + 1) / n_bins
    orders = list(permutations(range(dims)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values = part[[f"c{i}" for i in range(1 << dims)]].to_numpy(float)
            where = part[axes].to_numpy(int)
            flip = sum((where[:, d] & 1) << d for d in range(dims))
            total = np.zeros((len(part), n_bins))
            for order in orders:
                path = [0]
                for d in order:
                    path.append(path[-1] | 1 << d)
                simplex = np.stack([values[np.arange(len(part)), flip ^ i] for i in path], axis=1)
                flat = simplex.max(axis=1) <= simplex.min(axis=1)
                under = below(simplex, np.broadcast_to(edges, (len(part), n_bins + 1)))
                under[:, -1] = 1.0  # the last bin holds its upper edge
                share = np.diff(under, axis=1)
                one = np.clip(np.searchsorted(edges, simplex[:, 0], "right") - 1, 0, n_bins - 1)
                share[flat] = np.eye(n_bins)[one[flat]]
                sums = share.sum(axis=1, keepdims=True)
                total += np.where(sums > 0, share / np.where(sums > 0, sums, 1), np.eye(n_bins)[one]) / len(orders)
            row, bins = np.nonzero(total)
            yield pd.DataFrame({a: where[row, d].astype("int32") for d, a in enumerate(axes)} | {"bin": bins.astype("int32"), "w": total[row, bins]})

    return corners.mapInPandas(run, ", ".join(f"{a} int" for a in axes) + ", bin int, w double")
