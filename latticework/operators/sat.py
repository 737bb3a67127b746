"""Summed-area tables, box queries and sliding boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.spec import GridSpec


def dense(hist: DataFrame, spec: GridSpec) -> DataFrame:
    """hist on every cell and bin of the grid, 0 where there is none."""
    keys = [*spec.axes, "bin"]
    return spec.lattice(hist.sparkSession, spec.n_bins).join(hist, keys, "left").select(*keys, F.coalesce("w", F.lit(0)).alias("w"))


def sat(hist: DataFrame, spec: GridSpec) -> DataFrame:
    """(x.., bin, s): per bin the sum over all cells up to x along every axis. One running sum per axis on the dense grid.

    A task holds lines of one axis, so its memory is bounded by the grid's longest axis, not by its cells or rows.
    """
    out = dense(hist, spec).withColumnRenamed("w", "s")
    for axis in spec.axes:
        others = [a for a in spec.axes if a != axis]
        run = Window.partitionBy(*others, "bin").orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("s", F.sum("s").over(run))
    return out


def point_sums(table: DataFrame, position: tuple[int, ...]) -> DataFrame:
    """(bin, s) at one position of a SAT."""
    return table.filter(reduce(lambda a, b: a & b, [F.col(f"x{d}") == p for d, p in enumerate(position)])).select("bin", "s")


def box_corners(boxes: DataFrame, dims: int) -> DataFrame:
    """(qid, x.., sign) of the corners of boxes (lo, hi]; corners at -1 add nothing and are left out, equal ones are merged."""
    out = boxes
    for d in range(dims):
        both = F.array(F.struct(F.col(f"hi{d}").alias("x"), F.lit(1).alias("s")), F.struct(F.col(f"lo{d}").alias("x"), F.lit(-1).alias("s")))
        out = out.withColumn(f"c{d}", F.explode(both))
    sign = reduce(lambda a, b: a * b, [F.col(f"c{d}.s") for d in range(dims)])
    out = out.select("qid", *(F.col(f"c{d}.x").alias(f"x{d}") for d in range(dims)), sign.alias("sign"))
    out = out.filter(reduce(lambda a, b: a & b, [F.col(f"x{d}") >= 0 for d in range(dims)]))
    return out.groupBy("qid", *(f"x{d}" for d in range(dims))).agg(F.sum("sign").alias("sign")).filter("sign <> 0")


def region_sums(table: DataFrame, boxes: DataFrame, spec: GridSpec) -> DataFrame:
    """(qid, bin, h) of boxes (lo, hi] from a SAT: signed sums over its corners. Boxes: (qid, lo0 .., hi0 ..); any number, joined by position."""
    picked = table.join(box_corners(boxes, len(spec.dims)), spec.axes)
    return picked.groupBy("qid", "bin").agg(F.sum(F.col("s") * F.col("sign")).alias("h"))


def region_brute(hist: DataFrame, boxes: DataFrame, spec: GridSpec, tiles: int = 4096) -> DataFrame:
    """(qid, bin, h) by adding up the cells inside each box. The grid is cut into tiles over all axes, about ``tiles`` of them; a box is dealt out to the tiles it
    touches, cells meet it by their tile, and all axes filter. So a box makes as many rows as it touches tiles, and a tile's cells meet that tile's boxes only."""
    per_axis = max(1, round(tiles ** (1 / len(spec.dims))))
    edges = [-(-n // per_axis) for n in spec.dims]
    names = [f"t{d}" for d in range(len(spec.dims))]
    dealt = boxes.filter(reduce(lambda a, b: a & b, [F.col(f"hi{d}") > F.col(f"lo{d}") for d in range(len(spec.dims))]))
    for d, edge in enumerate(edges):
        first, last = F.floor((F.greatest(F.col(f"lo{d}"), F.lit(-1)) + 1) / edge), F.floor(F.least(F.col(f"hi{d}"), F.lit(spec.dims[d] - 1)) / edge)
        dealt = dealt.filter(first <= last).withColumn(f"t{d}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    placed = hist.withColumns({f"t{d}": F.floor(F.col(f"x{d}") / edge).cast("int") for d, edge in enumerate(edges)})
    inside = [(F.col(f"x{d}") > F.col(f"lo{d}")) & (F.col(f"x{d}") <= F.col(f"hi{d}")) for d in range(len(spec.dims))]
    joined = placed.join(dealt, names).filter(reduce(lambda a, b: a & b, inside))
    return joined.groupBy("qid", "bin").agg(F.sum("w").alias("h"))


def region_filter(hist: DataFrame, lo: tuple[int, ...], hi: tuple[int, ...]) -> DataFrame:
    """(bin, h) of one box (lo, hi], by a filter on cells; Spark moves it below the aggregation that made them."""
    inside = [(F.col(f"x{d}") > a) & (F.col(f"x{d}") <= b) for d, (a, b) in enumerate(zip(lo, hi, strict=True))]
    return hist.filter(reduce(lambda a, b: a & b, inside)).groupBy("bin").agg(F.sum("w").alias("h"))


def random_boxes(spark: SparkSession, spec: GridSpec, window: int, count: int, first: int = 0) -> DataFrame:
    """(qid, lo0 .., hi0 ..) of ``count`` boxes of edge ``window`` (an axis' length less 1 at most) at places that a hash of their number names: the same every time."""
    out = [(F.col("id") + first).cast("int").alias("qid")]
    for d, n in enumerate(spec.dims):
        edge = min(window, n - 1)
        base = edge + (F.col("id") * (2654435761 + 40503 * d) + 12345 * (d + 1)) % 2147483647 % (n - edge)
        out += [(base - edge).cast("int").alias(f"lo{d}"), base.cast("int").alias(f"hi{d}")]
    return spark.range(count).select(*out)


def box_sums(values: DataFrame, axes: list[str], group: list[str], left: tuple[int, ...], right: tuple[int, ...], value: str = "w") -> DataFrame:
    """Sum of value over x + left < cell <= x + right along every axis, at each row; rows must hold every cell at which a result is wanted."""
    for d, axis in enumerate(axes):
        others = [a for a in axes if a != axis]
        frame = Window.partitionBy(*others, *group).orderBy(axis).rangeBetween(left[d] + 1, right[d])
        values = values.withColumn(value, F.coalesce(F.sum(value).over(frame), F.lit(0)))
    return values


def inside_border(spec: GridSpec, left: tuple[int, ...], right: tuple[int, ...]) -> Column:
    """Whether x + left and x + right lie in the grid along every axis."""
    return reduce(lambda a, b: a & b, [(F.col(f"x{d}") + left[d] >= 0) & (F.col(f"x{d}") + right[d] < n) for d, n in enumerate(spec.dims)])


def clamp_border(field: DataFrame, spec: GridSpec, left: tuple[int, ...], right: tuple[int, ...], value: str = "v") -> DataFrame:
    """0 where the box would leave the grid; no row is dropped."""
    return field.withColumn(value, F.when(inside_border(spec, left, right), F.col(value)).otherwise(F.lit(0.0)))


def clamp_to_datasize(field: DataFrame, spec: GridSpec) -> DataFrame:
    """Only rows inside the data's extents."""
    return field.filter(reduce(lambda a, b: a & b, [F.col(f"x{d}") < n for d, n in enumerate(spec.dims)]))


def viewer_boxes(queries: DataFrame, spec: GridSpec) -> DataFrame:
    """Boxes from location and size (loc0 .., size0 ..), both corners clamped to the grid."""
    out = [F.col("qid")]
    for d, n in enumerate(spec.dims):
        clamp = lambda c, top=n - 1: F.greatest(F.lit(0), F.least(F.lit(top), c)).cast("int")
        out += [clamp(F.col(f"loc{d}")).alias(f"lo{d}"), clamp(F.col(f"loc{d}") + F.col(f"size{d}")).alias(f"hi{d}")]
    return queries.select(*out)
