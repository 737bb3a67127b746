"""Rays through a grid: picking the nearest block of the tree, and compositing samples along rays front to back.

A ray is (ray, o0 .., v0 ..): the points o + t v with t >= 0, in the coordinates of block extents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.spec import GridSpec


def entered(rays_and_boxes: DataFrame, dims: int) -> DataFrame:
    """With t, where a ray first is in its row's box [lo, hi] (0 if it begins inside): slab by slab, the latest entry before the earliest exit. Rows that miss go."""
    first, last = [F.lit(0.0)], []
    inside = []
    for d in range(dims):
        o, v = F.col(f"o{d}"), F.col(f"v{d}")
        a, b = ((F.col(side) - o) / F.when(v != 0, v) for side in (f"lo{d}", f"hi{d}"))
        first.append(F.least(a, b))  # null where the ray runs along the slab
        last.append(F.greatest(a, b))
        inside.append((v != 0) | ((o >= F.col(f"lo{d}")) & (o <= F.col(f"hi{d}"))))
    enter = F.greatest(*first)
    leave = F.least(*last, F.lit(float("inf")))
    return rays_and_boxes.filter(reduce(lambda x, y: x & y, inside)).withColumn("t", enter).filter(F.col("t") <= leave)


def pick(rays: DataFrame, nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """(ray, k0 .., t): of the deepest blocks the one that each ray meets first, the first by place of equal ones; rays that meet none have no row.

    nodes: (level, k0 .., lo0 .., hi0 ..) as tree.build gives, all or a selection that holds every node's parent. A ray goes down level by level, from each block it meets
    to the children of that block alone, so its rows are the blocks along it, not all blocks.
    """
    places = [f"k{d}" for d in range(len(spec.dims))]
    extents = [f"{c}{d}" for c in ("lo", "hi") for d in range(len(spec.dims))]
    own = rays.columns
    whole = {f"lo{d}": F.lit(0) for d in range(len(spec.dims))} | {f"hi{d}": F.lit(spec.padded(d)) for d in range(len(spec.dims))} | {p: F.lit(0) for p in places}
    found = entered(rays.withColumns(whole), len(spec.dims))
    for level in range(1, spec.depth + 1):
        here = nodes.filter(F.col("level") == level)
        up = [(F.lit(0) if level <= 1 else F.floor(F.col(p) / 2)).cast("int").alias(f"u{p}") for p in places]
        here = here.select(*places, *extents, *up)
        above = found.select(*own, *(F.col(p).alias(f"u{p}") for p in places))
        found = entered(above.join(here, [f"u{p}" for p in places]), len(spec.dims))
    nearest = found.groupBy("ray").agg(F.min(F.struct("t", *places)).alias("hit"))
    return nearest.select("ray", *(F.col(f"hit.{p}").alias(p) for p in places), F.col("hit.t").alias("t"))


def opacity(alpha: F.Column, thickness: F.Column) -> F.Column:
    """Opacity of a stretch of a medium with an extinction: 1 - exp(-alpha * thickness)."""
    return 1 - F.exp(-alpha * thickness)


def segments(samples: DataFrame, length: int) -> DataFrame:
    """(ray, segment, c, t) of samples (ray, step, c, a): what each run of ``length`` steps gives in colour, premultiplied, and lets through of what is behind it.

    Two stretches in a row are c1 + t1 c2 and t1 t2, which is associative: a segment is composited where its samples are, in order, at most ``length`` of them; samples
    that aren't there are empty. Of several samples at one step the smaller (c, a) is in front.
    """
    line = F.array_sort(F.collect_list(F.struct("step", F.col("c").cast("double").alias("c"), F.col("a").cast("double").alias("a"))))
    grouped = samples.groupBy("ray", F.floor(F.col("step") / length).alias("segment")).agg(line.alias("line"))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(1.0).alias("t"))
    run = F.aggregate("line", start, lambda s, x: F.struct((s["c"] + s["t"] * x["a"] * x["c"]).alias("c"), (s["t"] * (1 - x["a"])).alias("t")))
    return grouped.select("ray", "segment", run.alias("s")).select("ray", "segment", "s.c", "s.t")


def composite(parts: DataFrame) -> DataFrame:
    """(ray, c, a) of segments: colour and opacity of the whole ray. Running transmittance by a window over a ray's segments, so a ray may have any number of them."""
    front = Window.partitionBy("ray").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    # the product of what is in front, by logarithms; one that lets nothing through blocks all behind it
    clear = F.coalesce(F.exp(F.sum(F.when(F.col("t") > 0, F.log("t"))).over(front)), F.lit(1.0))
    blocked = F.coalesce(F.max((F.col("t") <= 0).cast("int")).over(front), F.lit(0))
    seen = parts.withColumn("front", F.when(blocked == 0, clear).otherwise(0.0))
    return seen.groupBy("ray").agg(F.sum(F.col("front") * F.col("c")).alias("c"), (1 - F.min(F.col("front") * F.col("t"))).alias("a"))
