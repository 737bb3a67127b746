"""The block tree over the diagonal wavelets: nodes, distributions, distances, selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.spec import GridSpec

#: Bits of a node's selection state.
ASSIGNED, BY_PATH, BY_HISTOGRAM = 1, 2, 4


def _places(spec: GridSpec) -> list[str]:
    return [f"k{d}" for d in range(len(spec.dims))]


def node_pdfs(coefs: DataFrame, spec: GridSpec) -> DataFrame:
    """(level, k0 .., bin, p): distribution of each node, from the coefficients of the same level along every axis."""
    diagonal = coefs.filter(reduce(lambda a, b: a & b, [F.col(f"l{d}") == F.col("l0") for d in range(len(spec.dims))]))
    node = Window.partitionBy("level", *_places(spec))
    return diagonal.select(F.col("l0").alias("level"), *_places(spec), "bin", "ic").select(
        "level", *_places(spec), "bin", (F.col("ic") / F.sum("ic").over(node)).alias("p")
    )


def node_cdfs(pdfs: DataFrame, spec: GridSpec) -> DataFrame:
    """(level, k0 .., bin, c) on every bin."""
    keys = ["level", *_places(spec)]
    bins = F.explode(F.sequence(F.lit(0), F.lit(spec.n_bins - 1)))
    full = pdfs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "p"))).alias("m")).select(*keys, "m", bins.alias("bin"))
    run = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("c", F.sum(F.coalesce(F.col("m")[F.col("bin")], F.lit(0.0))).over(run)).drop("m")


def parent(spec: GridSpec) -> list[Column]:
    """A node's parent's place: half its own; the root's only child is at 0 like it."""
    return [F.when(F.col("level") <= 1, 0).otherwise(F.floor(F.col(k) / 2)).cast("int").alias(k) for k in _places(spec)]


def build(coefs: DataFrame, spec: GridSpec) -> DataFrame:
    """(level, k0 .., dist, lo0 .., hi0 ..) of every node: root mean square of the difference of its distribution function to its parent's (1 if the
    parent is empty, 0 for the root), and its extent in padded coordinates."""
    keys = ["level", *_places(spec)]
    cdfs = node_cdfs(node_pdfs(coefs, spec), spec)
    above = cdfs.select((F.col("level") + 1).alias("level"), *(F.col(k).alias(f"u{k}") for k in _places(spec)), "bin", F.col("c").alias("cu"))
    own = cdfs.select(*keys, "bin", "c", *(c.alias(f"u{k}") for c, k in zip(parent(spec), _places(spec), strict=True)))
    joined = own.join(above, ["level", "bin", *(f"u{k}" for k in _places(spec))], "left")
    dist = F.when(F.col("level") == 0, 0.0).otherwise(F.coalesce(F.sqrt(F.avg((F.col("c") - F.col("cu")) ** 2)), F.lit(1.0)))
    nodes = joined.groupBy(*keys).agg(dist.alias("dist"))
    for d in range(len(spec.dims)):
        width = spec.padded(d) / F.pow(F.lit(2.0), F.greatest(F.col("level") - 1, F.lit(0)))
        nodes = nodes.withColumns({f"lo{d}": (F.col(f"k{d}") * width).cast("int"), f"hi{d}": ((F.col(f"k{d}") + 1) * width).cast("int")})
    return nodes


def polylines(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """(level, k0 .., dist0, dist1): the segment from each node's parent's distance to its own."""
    up = nodes.select((F.col("level") + 1).alias("level"), *(F.col(k).alias(f"u{k}") for k in _places(spec)), F.col("dist").alias("dist0"))
    own = nodes.filter("level > 0").select("level", *_places(spec), *(c.alias(f"u{k}") for c, k in zip(parent(spec), _places(spec), strict=True)), F.col("dist").alias("dist1"))
    return own.join(up, ["level", *(f"u{k}" for k in _places(spec))], "left").select("level", *_places(spec), "dist0", "dist1")


def level_max_prob(pdfs: DataFrame, lo: int, hi: int) -> DataFrame:
    """(level, p): the largest share of a bin in the range, over a level's nodes."""
    return pdfs.filter(F.col("bin").between(lo, hi)).groupBy("level").agg(F.max("p").alias("p"))


def select_by_hist(pdfs: DataFrame, spec: GridSpec, level: int, ranges: DataFrame) -> DataFrame:
    """(k0 ..) of a level's nodes whose share of every bin lies in its range. ranges: (bin, lo, hi), a row for each bin that counts, joined as Spark sees fit."""
    keys = _places(spec)
    own = pdfs.filter(F.col("level") == level)
    met = own.join(ranges, "bin").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("there"), F.sum(F.col("p").between(F.col("lo"), F.col("hi")).cast("int")).alias("good"), F.sum((F.col("lo") <= 0).cast("int")).alias("zero")
    )
    nodes = own.select(*keys).distinct().join(met, keys, "left").na.fill(0, ["there", "good", "zero"])
    need = ranges.agg(F.count(F.lit(1)).alias("all"), F.sum(((F.col("lo") <= 0) & (F.col("hi") >= 0)).cast("int")).alias("may"))
    absent = ranges.filter("lo <= 0 and hi >= 0").select("bin")
    may = own.join(absent, "bin").groupBy(*keys).agg(F.count(F.lit(1)).alias("used"))
    nodes = nodes.join(may, keys, "left").na.fill(0, ["used"]).join(F.broadcast(need))  # one row
    # bins that a node lacks are fine if 0 is in their range
    return nodes.filter((F.col("good") == F.col("there")) & (F.col("may") - F.col("used") == F.col("all") - F.col("there"))).select(*keys)


def filter_paths(nodes: DataFrame, spec: GridSpec, ranges: dict[int, tuple[float, float]]) -> DataFrame:
    """(level, k0 ..) of nodes on a path from the root to the deepest level on which every distance lies in its level's range.

    An ancestor's place is a leaf's shifted right, so whole paths are made from the leaves by arithmetic: one join counts how many of a path's nodes pass,
    whatever the depth.
    """
    keys, depth = _places(spec), spec.depth
    good = reduce(lambda a, b: a & b, [(F.col("level") != n) | F.col("dist").between(*r) for n, r in ranges.items()], F.lit(True))
    leaves = nodes.filter(F.col("level") == depth).select(*(F.col(k).alias(f"u{k}") for k in keys))
    paths = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    paths = paths.select("*", *(F.when(F.col("level") == 0, 0).otherwise(F.expr(f"shiftright(u{k}, {depth} - level)")).alias(k) for k in keys))
    met = paths.join(nodes.filter(good).select("level", *keys), ["level", *keys])
    path = Window.partitionBy(*(f"u{k}" for k in keys))
    return met.withColumn("n", F.count(F.lit(1)).over(path)).filter(F.col("n") == depth + 1).select("level", *keys).distinct()


def with_mode(nodes: DataFrame, chosen: DataFrame, keys: list[str], bit: int) -> DataFrame:
    """nodes with bit set in the column mode of the chosen ones, and cleared in the others."""
    marks = chosen.select(*keys, F.lit(True).alias("mark")).distinct()
    mode = F.coalesce(F.col("mode"), F.lit(0)) if "mode" in nodes.columns else F.lit(0)
    return nodes.join(marks, keys, "left").withColumn("mode", F.when(F.col("mark"), mode.bitwiseOR(F.lit(bit))).otherwise(mode.bitwiseAND(F.lit(~bit)))).drop("mark")


def mode_matches(bit: int) -> Column:
    return F.col("mode").bitwiseAND(F.lit(bit)) == bit


def level_distances(hist: DataFrame, spec: GridSpec) -> DataFrame:
    """(level, dist): L2 norm of the difference of the distribution functions of a level and the one before.

    hist: (x0, bin, w) of one axis; a level's histogram is the sum of its coefficients' sizes.
    """
    from . import wavelet

    sums = wavelet.encode(hist, spec).groupBy(F.col("l0").alias("level"), "bin").agg(F.sum(F.abs("ic")).alias("ic"))
    pdfs = sums.select("level", F.lit(0).alias("k0"), "bin", (F.col("ic") / F.sum("ic").over(Window.partitionBy("level"))).alias("p"))
    cdfs = node_cdfs(pdfs, GridSpec(spec.dims, spec.n_bins))
    step = F.col("c") - F.lag("c").over(Window.partitionBy("bin").orderBy("level"))
    return cdfs.withColumn("d", step).groupBy("level").agg(F.sqrt(F.sum(F.col("d") ** 2)).alias("dist")).filter("dist is not null")
