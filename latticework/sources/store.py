"""Stores of a grid as Parquet: histograms, summed-area tables, coefficients; and slices of volumes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.spec import GridSpec


def _writer(df: DataFrame, compression: str, level: int | None):
    """A Parquet writer with a codec and, for gzip (1 to 9) and zstd (1 to 22), its level."""
    out = df.write.mode("overwrite").option("compression", compression)
    if level is None:
        return out
    if compression not in ("gzip", "zstd"):
        raise ValueError("only gzip and zstd have levels")
    names = {"zstd": "parquet.compression.codec.zstd.level", "gzip": "zlib.compress.level"}
    gzip = ["DEFAULT_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION"]
    return out.option(names[compression], level if compression == "zstd" else gzip[level])


def address_order(keys: list[str]) -> list[str]:
    """l0, k0, l1, k1, ..: the order of stored coefficients. So a folder's row groups hold short ranges of k0, by which lookups skip them."""
    return sorted(keys, key=lambda c: (int(c[1:]), c[0] == "k"))


def write_coefs(coefs: DataFrame, path: str, compression: str = "zstd", level: int | None = None) -> None:
    """Partitioned by the levels of axis 0, range-partitioned and sorted by the whole address: tasks get equal shares whatever the levels' sizes."""
    keys = address_order([c for c in coefs.columns if c[0] in "lk" and c[1:].isdigit()])
    rows = coefs.repartitionByRange(*keys).sortWithinPartitions(*keys)
    _writer(rows, compression, level).partitionBy("l0").parquet(path)


def narrowed(stored: DataFrame, addresses: DataFrame, folder: str = "l0") -> DataFrame:
    """stored without what addresses can't be: the scan reads only folders (partitions) that they name, and of these only row groups whose range of k0 they touch.

    One row for each folder comes to the driver, its range of k0: as many as an axis has levels, or there are wavelets, whatever the number of addresses.
    """
    seen = addresses.groupBy(folder).agg(F.min("k0").alias("lo"), F.max("k0").alias("hi")).collect()
    if not seen:
        return stored.filter(F.lit(False))
    ranges = [(F.col(folder) == r[folder]) & F.col("k0").between(r["lo"], r["hi"]) for r in seen]
    return stored.filter(F.col(folder).isin([r[folder] for r in seen])).filter(reduce(lambda a, b: a | b, ranges))


def lookup(stored: DataFrame, addresses: DataFrame) -> DataFrame:
    """Stored rows at addresses (l0 .., k0 .., and what else each carries), joined by address after the scan has been narrowed."""
    keys = [c for c in addresses.columns if c[0] in "lk" and c[1:].isdigit()]
    return narrowed(stored, addresses).join(addresses, keys)


def write_sat(table: DataFrame, path: str, compression: str = "zstd", level: int | None = None) -> None:
    _writer(table.repartition("bin", "x0").sortWithinPartitions("bin", "x0"), compression, level).partitionBy("bin").parquet(path)


def write_bins(hist: DataFrame, path: str, axes: list[str], nested: bool = False, compression: str = "zstd", level: int | None = None) -> None:
    """Cell histograms, as rows or (nested) one row per cell with an array of (bin, w)."""
    out = hist.groupBy(*axes).agg(F.array_sort(F.collect_list(F.struct("bin", "w"))).alias("bins")) if nested else hist
    _writer(out, compression, level).parquet(path)


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if "bins" not in df.columns:
        return df
    axes = [c for c in df.columns if c != "bins"]
    return df.select(*axes, F.explode("bins").alias("b")).select(*axes, "b.bin", "b.w")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A stored table; partition columns come back as int."""
    df = spark.read.parquet(path)
    return df.withColumns({c: F.col(c).cast("int") for c in ("bin", "l0") if c in df.columns})


def volume_slice(volume: DataFrame, fixed: dict[str, int], keep: list[str], value: str) -> DataFrame:
    """(x0 .., value) of a slice: axes in ``fixed`` held, axes in ``keep`` renumbered x0 ..; the filter reaches the scan."""
    at = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in fixed.items()])
    return volume.filter(at).select(*(F.col(c).cast("int").alias(f"x{d}") for d, c in enumerate(keep)), F.col(value).cast("double").alias("value"))


def vector_slice(volume: DataFrame, fixed: dict[str, int], keep: list[str], u: str, v: str, missing: float | None = None) -> DataFrame:
    """(x0 .., u, v) of a slice of a volume with two components; a component that equals ``missing`` is null."""
    at = reduce(lambda a, b: a & b, [F.col(c) == x for c, x in fixed.items()])
    component = lambda c: F.col(c).cast("double") if missing is None else F.when(F.col(c) != missing, F.col(c).cast("double"))
    return volume.filter(at).select(*(F.col(c).cast("int").alias(f"x{d}") for d, c in enumerate(keep)), component(u).alias("u"), component(v).alias("v"))


def clamped_range(cells: DataFrame) -> DataFrame:
    """(vmin, vmax) with vmin not below 0."""
    return cells.agg(F.greatest(F.min("value"), F.lit(0.0)).alias("vmin"), F.max("value").alias("vmax"))


def vector_field(u: DataFrame, v: DataFrame, axes: list[str]) -> DataFrame:
    """(x.., u, v) of two component tables (x.., value), joined by position; a missing side is null."""
    return u.withColumnRenamed("value", "u").join(v.withColumnRenamed("value", "v"), axes, "full")


#: Radius and centre (the same along every axis) of the five balls of the usual test volume, in a cube of edge 64 (fixed values).
FIVE_BALLS = [(8.0, 48.0), (4.0, 24.0), (2.0, 12.0), (1.0, 6.0), (1.0, 2.0)]


def spheres(balls: DataFrame, edge: int = 64, reach: float = 3.0) -> DataFrame:
    """(x0, x1, x2, value) of every cell of a cube: the sum of Gaussian balls (c0, c1, c2, radius), each with a maximum of 1 and a sigma of 1.1 radius.

    A ball is dealt out to the cells within ``reach`` sigmas along every axis and is 0 beyond, so balls times the volume of one are added up, never balls times cells.
    """
    sigma = F.col("radius") * 1.1
    out = balls
    for d in range(3):
        first, last = (F.ceil(F.col(f"c{d}") - sigma * reach), F.floor(F.col(f"c{d}") + sigma * reach))
        first, last = F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(edge - 1)).cast("int")
        out = out.filter(first <= last).withColumn(f"x{d}", F.explode(F.sequence(first, last)))
    square = reduce(lambda a, b: a + b, [(F.col(f"x{d}") - F.col(f"c{d}")) * (F.col(f"x{d}") - F.col(f"c{d}")) for d in range(3)])
    near = out.groupBy("x0", "x1", "x2").agg(F.sum(F.exp(-square / (2 * sigma * sigma))).alias("value"))
    every = GridSpec((edge,) * 3, 1).lattice(balls.sparkSession)
    return every.join(near, ["x0", "x1", "x2"], "left").select("x0", "x1", "x2", F.coalesce("value", F.lit(0.0)).alias("value"))


def five_balls(spark: SparkSession, edge: int = 64) -> DataFrame:
    """The balls of the usual test volume, for ``spheres``, scaled to its edge."""
    scale = edge / 64
    return spark.createDataFrame([(c * scale, c * scale, c * scale, r * scale) for r, c in FIVE_BALLS], "c0 double, c1 double, c2 double, radius double")
