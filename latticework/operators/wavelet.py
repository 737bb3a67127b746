"""The wavelet store: whole-number Haar coefficients of the summed-area tables, made by aggregation and read by equality joins.

A coefficient is a weighted sum over the cells under it, and the weight is a product over axes. So encoding goes axis by axis: fan out to the levels of one
axis, aggregate, go on. Coefficients stay whole numbers (``ic``) where weights are; both normalisations are folded into the weights of queries,
which are powers of two, so that decoded sums are exact.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import binning
from ..plans.spec import GridSpec
from .sat import box_corners, sat


def encode(hist: DataFrame, spec: GridSpec) -> DataFrame:
    """(l0 .., k0 .., bin, ic) of a cell histogram; zeros are left out, those of a single axis at once."""
    out = hist.withColumnRenamed("w", "ic")
    done: list[str] = []
    for d in range(len(spec.dims)):
        rest = [f"x{e}" for e in range(d + 1, len(spec.dims))]
        fanned = out.select(*done, *rest, "bin", "ic", F.explode(binning.haar_levels(f"x{d}", spec.levels(d), True)).alias("b")).filter("b.f <> 0")
        done += [f"l{d}", f"k{d}"]
        fanned = fanned.select(*done[:-2], F.col("b.l").alias(f"l{d}"), F.col("b.k").alias(f"k{d}"), *rest, "bin", (F.col("ic") * F.col("b.f")).alias("ic"))
        out = fanned.groupBy(*done, *rest, "bin").agg(F.sum("ic").alias("ic"))
    return out.select(*spec.keys, "bin", "ic").filter("ic <> 0")


def coefficient(spec: GridSpec) -> Column:
    """The orthonormal coefficient of ic."""
    scale = reduce(lambda a, b: a * b, [binning.displayed(F.col(f"l{d}")) for d in range(len(spec.dims))])
    return F.col("ic") * scale / spec.size**0.5


def thresholded(coefs: DataFrame, spec: GridSpec, eps: float | None = None) -> DataFrame:
    """Coefficients larger than eps (None: half the spec's threshold, which drops nothing but rounding)."""
    return coefs.filter(F.abs(coefficient(spec)) > (spec.threshold / 2 if eps is None else eps))


def basis(points: DataFrame, spec: GridSpec, keep: list[str]) -> DataFrame:
    """(keep.., l0 .., k0 .., s): the coefficients over each point x0 .. and their weights in its prefix sum."""
    out, weight = points.withColumn("s", F.lit(1.0)), "s"
    for d in range(len(spec.dims)):
        out = out.withColumn("b", F.explode(binning.haar_levels(f"x{d}", spec.levels(d), False)))
        out = out.withColumns({f"l{d}": F.col("b.l"), f"k{d}": F.col("b.k"), weight: F.col(weight) * F.col("b.f")}).drop("b")
    return out.select(*keep, *spec.keys, "s")


def point_sums(coefs: DataFrame, points: DataFrame, spec: GridSpec) -> DataFrame:
    """(qid, bin, s): prefix sums at points (qid, x0 ..)."""
    joined = coefs.join(basis(points, spec, ["qid"]), spec.keys)
    return joined.groupBy("qid", "bin").agg(F.sum(F.col("ic") * F.col("s")).alias("s")).filter("s <> 0")


def wanted(boxes: DataFrame, spec: GridSpec, merge: bool = True) -> DataFrame:
    """(qid, l0 .., k0 .., s): the coefficients that boxes look up, and their weights. With merge, a box's corners share theirs, and what cancels is left out."""
    corners = box_corners(boxes, len(spec.dims))
    out = basis(corners, spec, ["qid", "sign"]).withColumn("s", F.col("s") * F.col("sign"))
    if not merge:
        return out.select("qid", *spec.keys, "s")
    return out.groupBy("qid", *spec.keys).agg(F.sum("s").alias("s")).filter("s <> 0")


def coarse_levels(spec: GridSpec, most: int = 1 << 16) -> list[tuple[int, ...]]:
    """Levels of the wavelets with the fewest places that together have ``most`` (place, bin) values at most: a bound on their coefficients, whatever the data."""
    every = sorted((reduce(lambda a, b: a * b, (1 << max(0, n - 1) for n in at)), at) for at in product(*(range(spec.levels(d)) for d in range(len(spec.dims)))))
    out, total = [], 0
    for places, at in every:
        total += places * spec.n_bins
        if total > most:
            break
        out.append(at)
    return out


def region_sums(coefs: DataFrame, boxes: DataFrame, spec: GridSpec, merge: bool = True, stored: bool = False) -> DataFrame:
    """(qid, bin, h) of boxes (lo, hi].

    Every box looks up the coarsest coefficients, which are few however many cells there are. Where coefs are stored (so that reading them twice is cheap), these are
    sent to all tasks, within the bound of coarse_levels, and only lookups of finer ones are shuffled to their addresses.
    """
    asked = wanted(boxes, spec, merge)
    few = coarse_levels(spec)
    levels = [f"l{d}" for d in range(len(spec.dims))]
    if not stored or len(few) == spec.n_wavelets:
        joined = coefs.join(asked, spec.keys)
    else:
        number = lambda: reduce(lambda a, b: a * 64 + b, [F.col(c) for c in levels])
        coarse = number().isin([reduce(lambda a, b: a * 64 + b, at) for at in few])
        joined = asked.filter(coarse).join(F.broadcast(coefs.filter(coarse)), spec.keys).unionByName(coefs.filter(~coarse).join(asked.filter(~coarse), spec.keys))
    return joined.groupBy("qid", "bin").agg(F.sum(F.col("ic") * F.col("s")).alias("h")).filter("h <> 0")


def coef_sparse(coefs: DataFrame, levels: tuple[int, ...], place: tuple[int, ...]) -> DataFrame:
    """(bin, ic) of one address; on the stored table the levels prune partitions."""
    at = [F.col(f"l{d}") == v for d, v in enumerate(levels)] + [F.col(f"k{d}") == v for d, v in enumerate(place)]
    return coefs.filter(reduce(lambda a, b: a & b, at)).select("bin", "ic")


def coef_full(coefs: DataFrame, spec: GridSpec, levels: tuple[int, ...], place: tuple[int, ...]) -> DataFrame:
    """(bin, ic) of one address on every bin, 0 where nothing is stored."""
    every = coefs.sparkSession.range(spec.n_bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(coef_sparse(coefs, levels, place), "bin", "left").select("bin", F.coalesce("ic", F.lit(0)).alias("ic"))


def decode_bins(coefs: DataFrame, spec: GridSpec, lo: int, hi: int, padded: bool = False) -> DataFrame:
    """(x0 .., s): the summed-area table of bins lo to hi together, one axis after the other; inside the data's extents unless padded."""
    out = coefs.filter(F.col("bin").between(lo, hi)).groupBy(*spec.keys).agg(F.sum("ic").cast("double").alias("s"))
    done: list[str] = []
    for d in range(len(spec.dims)):
        n = spec.padded(d) if padded else spec.dims[d]
        axis = out.sparkSession.range(n).select(F.col("id").cast("int").alias(f"x{d}"))
        axis = axis.select(f"x{d}", F.explode(binning.haar_levels(f"x{d}", spec.levels(d), False)).alias("b"))
        axis = axis.select(f"x{d}", F.col("b.l").alias(f"l{d}"), F.col("b.k").alias(f"k{d}"), F.col("b.f").alias("f"))
        done.append(f"x{d}")
        rest = [f"{c}{e}" for c in "lk" for e in range(d + 1, len(spec.dims))]
        out = out.join(axis, [f"l{d}", f"k{d}"]).groupBy(*done, *rest).agg(F.sum(F.col("s") * F.col("f")).alias("s"))
    return out


def bin_cumsum(coefs: DataFrame, spec: GridSpec) -> DataFrame:
    """coefs with cum, the running sum over bins of each coefficient: a range of bins then takes two lookups."""
    run = Window.partitionBy(*spec.keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return coefs.withColumn("cum", F.sum("ic").over(run))


def bin_difference(summed: DataFrame, spec: GridSpec) -> DataFrame:
    """The inverse of bin_cumsum."""
    before = F.lag("cum").over(Window.partitionBy(*spec.keys).orderBy("bin"))
    return summed.withColumn("ic", F.col("cum") - F.coalesce(before, F.lit(0)))


def pool_sizes(coefs: DataFrame, spec: GridSpec) -> DataFrame:
    """(l0 .., n_places, n_values) of each wavelet."""
    levels = [f"l{d}" for d in range(len(spec.dims))]
    places = coefs.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"))
    return places.groupBy(*levels).agg(F.count(F.lit(1)).alias("n_places"), F.sum("n").alias("n_values"))


def compression(coefs: DataFrame, spec: GridSpec) -> DataFrame:
    """One row: n_values, ratio (dense values per kept one), overhead (kept values per cell)."""
    total = 1
    for n in spec.dims:
        total *= n
    return coefs.agg(F.count(F.lit(1)).alias("n_values")).select(
        "n_values", (F.lit(total * spec.n_bins) / F.col("n_values")).alias("ratio"), (F.col("n_values") / F.lit(total)).alias("overhead")
    )


def fetches(boxes: DataFrame, spec: GridSpec) -> DataFrame:
    """(least, most, mean) coefficient addresses that boxes look up after merging."""
    wanted = basis(box_corners(boxes, len(spec.dims)), spec, ["qid", "sign"]).groupBy("qid", *spec.keys).agg(F.sum(F.col("s") * F.col("sign")).alias("s"))
    each = wanted.filter("s <> 0").groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def outside(coefs: DataFrame, spec: GridSpec, extents: tuple[int, ...] | None = None) -> DataFrame:
    """Coefficients whose support begins beyond the data, or beyond other extents; of the data encode makes none."""
    beyond = [F.col(f"k{d}") * F.pow(F.lit(2.0), spec.levels(d) - F.greatest(F.col(f"l{d}"), F.lit(1))) >= n for d, n in enumerate(extents or spec.dims)]
    return coefs.filter(reduce(lambda a, b: a | b, beyond))


def block_values(coefs: DataFrame, spec: GridSpec, level: int) -> DataFrame:
    """(k0 .., bin, w): sizes of the coefficients over the blocks of edge 2^level. Empty for level 0, which has no blocks."""
    at = [F.col(f"l{d}") == spec.levels(d) - level for d in range(len(spec.dims))]
    if level == 0:
        at.append(F.lit(False))
    return coefs.filter(reduce(lambda a, b: a & b, at)).select(*(f"k{d}" for d in range(len(spec.dims))), "bin", F.abs("ic").alias("w"))


def haar_scanlines(values: DataFrame, key: str, position: str, value: str, length: int, inverse: bool = False) -> DataFrame:
    """(key, position, value): orthonormal Haar transform of each key's scanline of a power of two of values, or its inverse.

    A scanline is a group, as long as one padded axis of the grid: that bounds a group, whatever the number of cells or rows.
    """
    import numpy as np
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros(length)
        line[part[position].to_numpy()] = part[value].to_numpy()
        half = 2 ** -0.5
        if inverse:
            out, n = line[:1], 1
            while n < length:
                detail = line[n : 2 * n]
                out = np.stack([(out + detail) * half, (out - detail) * half], axis=1).ravel()
                n *= 2
        else:
            out, smooth = np.zeros(length), line
            while len(smooth) > 1:
                n = len(smooth) // 2
                out[n : 2 * n] = (smooth[0::2] - smooth[1::2]) * half
                smooth = (smooth[0::2] + smooth[1::2]) * half
            out[0] = smooth[0]
        return pd.DataFrame({key: part[key].iloc[0], position: np.arange(length, dtype="int32"), value: out})

    kind = values.schema[key].dataType.simpleString()
    return values.groupBy(key).applyInPandas(run, f"{key} {kind}, {position} int, {value} double")


def dense_encode(hist: DataFrame, spec: GridSpec) -> DataFrame:
    """What encode gives, by the dense route: the summed-area tables of all bins over all axes, then every scanline transformed, one axis after the other.

    Beyond the data the sums stay, up to a power of two along each axis.
    """
    out = sat(hist, spec).withColumn("s", F.col("s").cast("double"))
    for d, axis in enumerate(spec.axes):
        if spec.padded(d) > spec.dims[d]:
            beyond = F.explode(F.sequence(F.lit(spec.dims[d]), F.lit(spec.padded(d) - 1)))
            out = out.unionByName(out.filter(F.col(axis) == spec.dims[d] - 1).withColumn(axis, beyond))
    for d, axis in enumerate(spec.axes):
        sizes = {a: spec.padded(e) for e, a in enumerate(spec.axes) if e != d} | {"bin": spec.n_bins}
        line, rest, others = F.lit(0).cast("long"), F.col("line"), []
        for name, n in reversed(sizes.items()):
            line = line * n + F.col(name)
        for name, n in sizes.items():
            others.append((rest % n).cast("int").alias(name))
            rest = F.floor(rest / n)
        out = haar_scanlines(out.select(line.alias("line"), axis, "s"), "line", axis, "s", spec.padded(d)).select(axis, *others, "s")
    at = [binning.address(F.col(axis).cast("long")) for axis in spec.axes]
    out = out.select(*(level.cast("int").alias(f"l{d}") for d, (level, _) in enumerate(at)), *(k.cast("int").alias(f"k{d}") for d, (_, k) in enumerate(at)), "bin", "s")
    return out.withColumn("ic", F.lit(1)).select(*spec.keys, "bin", F.round(F.col("s") / coefficient(spec)).cast("long").alias("ic")).filter("ic <> 0")
