"""Queries over the driver's tables, one for each operator, and the DuckDB SQL that gives the same rows.

The main grid: lineitem by quantity (50) and discount (11), extended price in 8 linear bins. Its third axis is the line number (7).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import binning
from ..operators import cells, fields, hybrid, intervals, packed, rays, sat, tree, udf, wavelet
from ..sources import netcdf, nrrd, store, tiers
from ..streaming import completion, incremental, runs
from .spec import GridSpec

B = 8
LO, HI = (10, 2), (30, 8)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_BASE = """
 rng AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem),
 pts AS (SELECT CAST(l_quantity AS INTEGER) - 1 AS x0, CAST(round(l_discount * 100) AS INTEGER) AS x1, l_linenumber - 1 AS x2, l_extendedprice AS value,
   least(7, CAST(floor(8 * (l_extendedprice - mn) / (mx - mn)) AS INTEGER)) AS bin FROM lineitem, rng),
 hist AS (SELECT x0, x1, bin, count(*) AS w FROM pts GROUP BY ALL)"""
_DENSE = """,
 dense AS (SELECT a.x0, b.x1, c.bin, coalesce(w, 0) AS w FROM (SELECT CAST(range AS INTEGER) AS x0 FROM range(50)) a, (SELECT CAST(range AS INTEGER) AS x1 FROM range(11)) b,
   (SELECT CAST(range AS INTEGER) AS bin FROM range(8)) c LEFT JOIN hist h ON h.x0 = a.x0 AND h.x1 = b.x1 AND h.bin = c.bin)"""
_SAT = """,
 s1 AS (SELECT x0, x1, bin, sum(w) OVER (PARTITION BY x1, bin ORDER BY x0) AS s FROM dense),
 sat AS (SELECT x0, x1, bin, CAST(sum(s) OVER (PARTITION BY x0, bin ORDER BY x1) AS BIGINT) AS s FROM s1)"""
_COEF = """,
 f0 AS (SELECT CAST(range AS INTEGER) AS l0, CAST(pow(2, 7 - range) AS INTEGER) AS w0 FROM range(7)),
 f1 AS (SELECT CAST(range AS INTEGER) AS l1, CAST(pow(2, 5 - range) AS INTEGER) AS w1 FROM range(5)),
 coefs AS (SELECT l0, l1, CAST(x0 // w0 AS INTEGER) AS k0, CAST(x1 // w1 AS INTEGER) AS k1, bin, CAST(sum(w
   * CASE WHEN l0 = 0 THEN w0 // 2 - x0 % w0 WHEN x0 % w0 < w0 // 2 THEN -(x0 % w0) ELSE -(w0 - x0 % w0) END
   * CASE WHEN l1 = 0 THEN w1 // 2 - x1 % w1 WHEN x1 % w1 < w1 // 2 THEN -(x1 % w1) ELSE -(w1 - x1 % w1) END) AS BIGINT) AS ic
   FROM hist, f0, f1 GROUP BY ALL HAVING ic <> 0)"""
_TREE = _COEF + """,
 pdf AS (SELECT l0 AS level, k0, k1, bin, ic * 1.0e0 / sum(ic) OVER (PARTITION BY l0, k0, k1) AS p FROM coefs WHERE l0 = l1),
 node AS (SELECT DISTINCT level, k0, k1 FROM pdf),
 cdf AS (SELECT n.level, n.k0, n.k1, b.bin, sum(coalesce(p, 0)) OVER (PARTITION BY n.level, n.k0, n.k1 ORDER BY b.bin) AS c
   FROM node n, (SELECT CAST(range AS INTEGER) AS bin FROM range(8)) b LEFT JOIN pdf ON pdf.level = n.level AND pdf.k0 = n.k0 AND pdf.k1 = n.k1 AND pdf.bin = b.bin),
 nodes AS (SELECT a.level, a.k0, a.k1, CASE WHEN a.level = 0 THEN 0.0e0 ELSE coalesce(sqrt(avg((a.c - b.c) * (a.c - b.c))), 1.0e0) END AS dist
   FROM cdf a LEFT JOIN cdf b ON b.level = a.level - 1 AND b.bin = a.bin AND b.k0 = CASE WHEN a.level <= 1 THEN 0 ELSE a.k0 // 2 END
     AND b.k1 = CASE WHEN a.level <= 1 THEN 0 ELSE a.k1 // 2 END GROUP BY a.level, a.k0, a.k1)"""
_BOXES = """,
 boxes AS (SELECT CAST(range AS INTEGER) AS qid, CAST((range * 7) % 40 - 1 AS INTEGER) AS lo0, CAST((range * 3) % 8 - 1 AS INTEGER) AS lo1,
   CAST((range * 7) % 40 - 1 + 1 + range % 9 AS INTEGER) AS hi0, CAST((range * 3) % 8 + range % 3 AS INTEGER) AS hi1 FROM range(64))"""
_TABLE_BOXES = """,
 boxes AS (SELECT CAST(s_suppkey AS INTEGER) AS qid, CAST(s_suppkey * 7 % 40 - 1 AS INTEGER) AS lo0, CAST(s_suppkey * 3 % 8 - 1 AS INTEGER) AS lo1, CAST(s_suppkey * 7 % 40 + s_suppkey % 9 AS INTEGER) AS hi0,
   CAST(s_suppkey * 3 % 8 + s_suppkey % 3 AS INTEGER) AS hi1, CAST(s_suppkey % 10 - 1 AS INTEGER) AS b0, CAST(s_suppkey % 10 - 2 + s_suppkey % 5 AS INTEGER) AS b1 FROM supplier)"""
_BRUTE = "SELECT qid, bin, CAST(sum(w) AS BIGINT) AS h FROM hist JOIN boxes ON x0 > lo0 AND x0 <= hi0 AND x1 > lo1 AND x1 <= hi1 GROUP BY qid, bin"
_NEAR = """,
 near AS (SELECT a.x0, a.x1, a.bin, CAST(coalesce(sum(h.w), 0) AS BIGINT) AS w FROM dense a LEFT JOIN hist h
   ON h.bin = a.bin AND h.x0 > a.x0 - 2 AND h.x0 <= a.x0 + 2 AND h.x1 > a.x1 - 2 AND h.x1 <= a.x1 + 2 GROUP BY a.x0, a.x1, a.bin)"""
_INSIDE = "x0 >= 2 AND x0 + 2 < 50 AND x1 >= 2 AND x1 + 2 < 11"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _with(body: str, *parts: str) -> str:
    return "WITH" + _BASE + "".join(parts) + "\n" + body


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _placed(rows: DataFrame, dims: int) -> DataFrame:
    where = [F.col("l_quantity").cast("int") - 1, F.round(F.col("l_discount") * 100).cast("int"), F.col("l_linenumber") - 1]
    return cells.cells(rows, where[:dims], F.col("l_extendedprice"))


def points(spark: SparkSession, sf_dir: str, dims: int = 2) -> DataFrame:
    return _placed(lineitem(spark, sf_dir), dims)


def grid(spark: SparkSession, sf_dir: str, dims: int = 2) -> tuple[GridSpec, DataFrame]:
    """The spec with its value range, and the cell histogram."""
    rows = points(spark, sf_dir, dims)
    spec = GridSpec((50, 11, 7)[:dims], B).with_range(rows, "value")
    return spec, cells.linear_histogram(rows, spec)


def coefs(spark: SparkSession, sf_dir: str) -> tuple[GridSpec, DataFrame]:
    spec, hist = grid(spark, sf_dir)
    return spec, wavelet.encode(hist, spec)


def boxes(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    cols = {"qid": i, "lo0": i * 7 % 40 - 1, "lo1": i * 3 % 8 - 1, "hi0": i * 7 % 40 + i % 9, "hi1": i * 3 % 8 + i % 3}
    return spark.range(64).select(*(c.cast("int").alias(k) for k, c in cols.items()))


def table_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box and a range of bins for each supplier; some boxes and some ranges are empty, some reach beyond the grid's lower corner."""
    i = F.col("s_suppkey")
    cols = {"qid": i, "lo0": i * 7 % 40 - 1, "lo1": i * 3 % 8 - 1, "hi0": i * 7 % 40 + i % 9, "hi1": i * 3 % 8 + i % 3, "b0": i % 10 - 1, "b1": i % 10 - 2 + i % 5}
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(*(c.cast("int").alias(k) for k, c in cols.items()))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); where that is unset a temporary one on one machine, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/latticework"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Sources and sinks


@query("SELECT min(l_extendedprice) AS vmin, max(l_extendedprice) AS vmax FROM lineitem")
def value_range(spark, d):
    return points(spark, d).agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))


@query("SELECT CAST(l_quantity AS INTEGER) - 1 AS x0, CAST(round(l_discount * 100) AS INTEGER) AS x1, l_extendedprice AS value FROM lineitem WHERE l_linenumber = 3")
def scan_slice(spark, d):
    return store.volume_slice(points(spark, d, 3), {"x2": 2}, ["x0", "x1"], "value")


@query("SELECT greatest(min(l_quantity - 25), 0.0e0) AS vmin, max(l_quantity - 25) AS vmax FROM lineitem")
def slice_range(spark, d):
    return store.clamped_range(lineitem(spark, d).select((F.col("l_quantity") - 25).alias("value")))


_DEEP = "SELECT CAST(l_quantity AS INTEGER) - 1 AS x, CAST(round(l_discount * 100) AS INTEGER) AS y, CAST(l_partkey % 16 AS INTEGER) AS z, l_linenumber - 1 AS t, l_extendedprice - 30000 AS value FROM lineitem"


@query(f"SELECT x AS x0, y AS x1, greatest(value, 0.0e0) AS value FROM ({_DEEP}) WHERE t = 0 AND z = 12")
def scan_time_depth_slice(spark, d):
    """One time and one height of a volume with four axes, negative values clamped to 0."""
    rows = lineitem(spark, d).select(
        (F.col("l_quantity").cast("int") - 1).alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y"), (F.col("l_partkey") % 16).cast("int").alias("z"),
        (F.col("l_linenumber") - 1).alias("t"), (F.col("l_extendedprice") - 30000).alias("value"),
    )
    return store.volume_slice(rows, {"t": 0, "z": 12}, ["x", "y"], "value").withColumn("value", binning.clamp_negative(F.col("value")))


@query(
    """SELECT x0, x1, u, CASE WHEN (x0 + x1) % 7 <> 0 THEN v END AS v FROM (SELECT CAST(l_quantity AS INTEGER) - 1 AS x0, CAST(round(l_discount * 100) AS INTEGER) AS x1,
   CAST(sum(CAST(round(l_tax * 100) AS INTEGER) - 4) AS DOUBLE) AS u, CAST(sum(l_suppkey % 9 - 4) AS DOUBLE) AS v FROM lineitem WHERE l_linenumber = 5 GROUP BY ALL)"""
)
def scan_vector_slice(spark, d):
    """One depth of a vector volume whose missing components hold a sentinel."""
    where = [F.col("l_quantity").cast("int") - 1, F.round(F.col("l_discount") * 100).cast("int")]
    rows = lineitem(spark, d).groupBy(where[0].alias("x"), where[1].alias("y"), (F.col("l_linenumber") - 1).alias("depth")).agg(
        F.sum(F.round(F.col("l_tax") * 100).cast("int") - 4).cast("double").alias("u"), F.sum(F.col("l_suppkey") % 9 - 4).cast("double").alias("v")
    )
    volume = rows.withColumn("v", F.when((F.col("x") + F.col("y")) % 7 == 0, -9999.0).otherwise(F.col("v")))
    return store.vector_slice(volume, {"depth": 4}, ["x", "y"], "u", "v", -9999.0)


_VECTOR = """,
 vec AS (SELECT x0, x1, u, CASE WHEN (x0 + x1) % 7 <> 0 THEN v END AS v FROM (SELECT CAST(l_quantity AS INTEGER) - 1 AS x0, CAST(round(l_discount * 100) AS INTEGER) AS x1,
   CAST(sum(CAST(round(l_tax * 100) AS INTEGER) - 4) AS DOUBLE) AS u, CAST(sum(l_linenumber - 4) AS DOUBLE) AS v FROM lineitem GROUP BY ALL))"""


def _vectors(spark, d):
    where = [F.col("l_quantity").cast("int") - 1, F.round(F.col("l_discount") * 100).cast("int")]
    rows = lineitem(spark, d).select(where[0].alias("x0"), where[1].alias("x1"), (F.round(F.col("l_tax") * 100).cast("int") - 4).alias("a"), (F.col("l_linenumber") - 4).alias("b"))
    sums = rows.groupBy("x0", "x1").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    v = sums.filter((F.col("x0") + F.col("x1")) % 7 != 0).select("x0", "x1", F.col("b").alias("value"))
    return store.vector_field(sums.select("x0", "x1", F.col("a").alias("value")), v, ["x0", "x1"])


@query(_with("SELECT * FROM vec", _VECTOR))
def scan_vector_component(spark, d):
    return _vectors(spark, d)


@query(
    _with(
        "SELECT x0, x1, CASE WHEN v IS NULL THEN 0 WHEN u = 0 AND v = 0 THEN 1 ELSE 2 + least(7, CAST(floor(8 * (atan2(v, u) + pi()) / (2 * pi())) AS INTEGER)) END AS bin FROM vec",
        _VECTOR,
    )
)
def bin_vector_direction(spark, d):
    return _vectors(spark, d).select("x0", "x1", binning.bin_direction(F.col("u"), F.col("v"), B).alias("bin"))


@query(_with("SELECT * FROM hist"))
def scan_bins(spark, d):
    spec, hist = grid(spark, d)
    store.write_bins(hist, path := scratch(spark, "bins"), spec.axes, nested=True)
    return store.read_bins(spark, path)


@query(_with("SELECT * FROM sat", _DENSE, _SAT))
def scan_sat(spark, d):
    spec, hist = grid(spark, d)
    store.write_sat(sat.sat(hist, spec), path := scratch(spark, "sat"))
    return store.read_store(spark, path).select("x0", "x1", "bin", "s")


@query(_with("SELECT * FROM coefs", _COEF))
def scan_coefs(spark, d):
    spec, found = coefs(spark, d)
    store.write_coefs(found, path := scratch(spark, "coefs"))
    return store.read_store(spark, path).select(*spec.keys, "bin", "ic")


_BALL = "CAST(s_suppkey * 37 % 64 AS DOUBLE) AS c0, CAST(s_suppkey * 11 % 64 AS DOUBLE) AS c1, CAST(s_nationkey * 5 % 64 AS DOUBLE) AS c2, CAST(1 + s_suppkey % 3 AS DOUBLE) AS radius"


@query(
    f"""WITH b AS (SELECT {_BALL} FROM supplier),
 x AS (SELECT *, unnest(range(greatest(0, CAST(ceil(c0 - 3.3e0 * radius) AS BIGINT)), least(63, CAST(floor(c0 + 3.3e0 * radius) AS BIGINT)) + 1)) AS x0 FROM b),
 y AS (SELECT *, unnest(range(greatest(0, CAST(ceil(c1 - 3.3e0 * radius) AS BIGINT)), least(63, CAST(floor(c1 + 3.3e0 * radius) AS BIGINT)) + 1)) AS x1 FROM x),
 z AS (SELECT *, unnest(range(greatest(0, CAST(ceil(c2 - 3.3e0 * radius) AS BIGINT)), least(63, CAST(floor(c2 + 3.3e0 * radius) AS BIGINT)) + 1)) AS x2 FROM y),
 v AS (SELECT x0, x1, x2, sum(exp(-((x0 - c0) * (x0 - c0) + (x1 - c1) * (x1 - c1) + (x2 - c2) * (x2 - c2)) / (2 * (1.1e0 * radius) * (1.1e0 * radius)))) AS value FROM z GROUP BY ALL)
SELECT CAST(r % 64 AS INTEGER) AS x0, CAST(r // 64 % 64 AS INTEGER) AS x1, CAST(r // 4096 AS INTEGER) AS x2, round(coalesce(value, 0), 6) AS value
FROM range(262144) t(r) LEFT JOIN v ON v.x0 = r % 64 AND v.x1 = r // 64 % 64 AND v.x2 = r // 4096"""
)
def gen_spheres(spark, d):
    """A test volume with a ball for each supplier."""
    balls = spark.read.parquet(f"{d}/supplier.parquet").selectExpr(*_BALL.split(", "))
    return store.spheres(balls).withColumn("value", F.round("value", 6))


_VOLUME = "SELECT CAST(l_quantity AS INTEGER) - 1 AS x0, CAST(round(l_discount * 100) AS INTEGER) AS x1, l_linenumber - 1 AS x2, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL"
_LATTICE3 = "SELECT CAST(r % 50 AS INTEGER) AS x0, CAST(r // 50 % 11 AS INTEGER) AS x1, CAST(r // 550 AS INTEGER) AS x2 FROM range(3850) t(r)"
_FIELD3 = f"SELECT x0, x1, x2, coalesce(value, 0.0e0) AS value FROM ({_LATTICE3}) LEFT JOIN ({_VOLUME}) USING (x0, x1, x2)"


def _volume(spark, d):
    """Rows by cell of the grid with three axes, cells without any left out."""
    return points(spark, d, 3).groupBy("x0", "x1", "x2").agg(F.count(F.lit(1)).cast("double").alias("value"))


@query(_FIELD3)
def scan_nrrd(spark, d):
    """A volume written as NRRD by a data source, each task its planes, and read back by it."""
    nrrd.write_nrrd(_volume(spark, d), (50, 11, 7), path := scratch(spark, "volume") + ".nhdr", "value")
    return spark.read.format("nrrd").option("slabs", 4).load(path)


_MONTHS = """SELECT t, z, y, x, u, CASE WHEN (x + 1 + y) % 7 <> 0 THEN v END AS v FROM (SELECT CAST(l_linenumber - 1 AS INTEGER) AS t, CAST(l_partkey % 16 AS INTEGER) AS z,
   CAST(round(l_discount * 100) AS INTEGER) AS y, CAST(l_quantity AS INTEGER) - 1 AS x, CAST(sum(l_suppkey % 9 - 4) AS DOUBLE) AS u, CAST(sum(CAST(round(l_tax * 100) AS INTEGER) - 4) AS DOUBLE) AS v
   FROM lineitem GROUP BY ALL)"""


def _netcdf(spark, d) -> str:
    """A volume with time, depth and two components as NetCDF, one file a time; cells without rows and half of the second component hold the missing value."""
    at = {"t": F.col("l_linenumber") - 1, "z": F.col("l_partkey") % 16, "y": F.round(F.col("l_discount") * 100), "x": F.col("l_quantity").cast("int") - 1}
    cells_ = lineitem(spark, d).groupBy(*(c.cast("int").alias(k) for k, c in at.items())).agg(
        F.sum(F.col("l_suppkey") % 9 - 4).cast("double").alias("u"), F.sum(F.round(F.col("l_tax") * 100).cast("int") - 4).cast("double").alias("v")
    )
    volume = cells_.withColumn("v", F.when((F.col("x") + 1 + F.col("y")) % 7 != 0, F.col("v")))
    netcdf.write(volume, path := scratch(spark, "volume.nc"), {"t": 7, "z": 16, "y": 11, "x": 50}, ["u", "v"], "double", -9999.0)
    return path


@query(f"SELECT x AS x0, y AS x1, greatest(u, 0.0e0) AS value FROM ({_MONTHS}) WHERE t = 0 AND z = 12")
def scan_netcdf_slice(spark, d):
    """One time and one height of a NetCDF volume, negative values clamped to 0: the slab's bytes are read, no others."""
    netcdf.register(spark)
    slab = spark.read.format("netcdf").option("variable", "u").option("slab", "t=0:1,z=12:13").load(_netcdf(spark, d))
    return store.volume_slice(slab, {"t": 0, "z": 12}, ["x", "y"], "u").dropna().withColumn("value", binning.clamp_negative(F.col("value")))


@query(f"SELECT x AS x0, y AS x1, t AS x2, u, v FROM ({_MONTHS}) WHERE z = 4")
def scan_netcdf_vector(spark, d):
    """Two components at one depth and all times; what equals the file's missing value is null."""
    netcdf.register(spark)
    slab = spark.read.format("netcdf").option("variable", "u,v").option("slab", "z=4").load(_netcdf(spark, d))
    return store.vector_slice(slab, {"z": 4}, ["x", "y", "t"], "u", "v").filter("u is not null or v is not null")


# Binning and index arithmetic


@query(_with("SELECT x0, x1, value, bin FROM pts"))
def bin_linear(spark, d):
    rows = points(spark, d)
    spec = GridSpec((50, 11), B).with_range(rows, "value")
    return rows.withColumn("bin", binning.bin_linear(F.col("value"), spec.vmin, spec.vmax, B))


@query("SELECT l_linenumber AS bin, CAST(l_quantity AS INTEGER) - 1 AS x0, count(*) AS w FROM lineitem GROUP BY ALL")
def bin_identity(spark, d):
    rows = lineitem(spark, d).select((F.col("l_quantity").cast("int") - 1).alias("x0"), "l_linenumber")
    return cells.cell_histogram(rows, ["x0"], binning.bin_identity(F.col("l_linenumber")))


@query("SELECT o_orderkey, CAST(o_orderkey % 50 AS INTEGER) AS x0, CAST(o_orderkey // 50 % 11 AS INTEGER) AS x1, CAST(o_orderkey // 550 % 7 AS INTEGER) AS x2 FROM orders")
def index_to_sub(spark, d):
    subs = binning.index_to_sub(F.col("o_orderkey"), (50, 11, 7))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", *(c.alias(f"x{i}") for i, c in enumerate(subs)))


@query(_with("SELECT x0, x1, x2, CAST(x0 + 50 * x1 + 550 * x2 AS BIGINT) AS cell, CAST(50 * 11 * 7 AS BIGINT) AS cells FROM pts"))
def sub_to_index(spark, d):
    rows, dims = points(spark, d, 3), (50, 11, 7)
    return rows.select("x0", "x1", "x2", binning.sub_to_index([F.col(f"x{i}") for i in range(3)], dims).alias("cell"), F.lit(int(np.prod(dims))).cast("long").alias("cells"))


_LEVELS0 = "(SELECT CAST(range AS INTEGER) AS l, CAST(pow(2, 7 - range) AS INTEGER) AS w FROM range(7))"


@query(
    f"""SELECT p_partkey, l, CAST(x0 // w AS INTEGER) AS k, CAST(CASE WHEN l = 0 THEN w // 2 - x0 % w WHEN x0 % w < w // 2 THEN -(x0 % w) ELSE -(w - x0 % w) END AS BIGINT) AS f
    FROM (SELECT p_partkey, p_size - 1 AS x0 FROM part), {_LEVELS0}"""
)
def haar_project_1d(spark, d):
    axis = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") - 1).alias("x0"))
    return axis.select("p_partkey", F.explode(binning.haar_levels("x0", 7, True)).alias("b")).select("p_partkey", "b.l", "b.k", "b.f")


@query(
    f"""SELECT p_partkey, l, CAST(x0 // w AS INTEGER) AS k, CASE WHEN l = 0 THEN 1 / 64.0e0 WHEN x0 % w < w // 2 THEN 1.0e0 / w ELSE -1.0e0 / w END AS f
    FROM (SELECT p_partkey, p_size - 1 AS x0 FROM part), {_LEVELS0}"""
)
def haar_basis_1d(spark, d):
    axis = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") - 1).alias("x0"))
    return axis.select("p_partkey", F.explode(binning.haar_levels("x0", 7, False)).alias("b")).select("p_partkey", "b.l", "b.k", "b.f")


@query(
    """SELECT g, CASE WHEN g = 0 THEN 0 ELSE length(bin(g)) END AS level, CASE WHEN g = 0 THEN 0 ELSE g - CAST(pow(2, length(bin(g)) - 1) AS BIGINT) END AS k, g AS back
    FROM (SELECT o_orderkey AS g FROM orders)"""
)
def coef_addressing(spark, d):
    level, k = binning.address(F.col("g"))
    places = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("g"))
    return places.select("g", level.alias("level"), k.alias("k")).withColumn("back", binning.global_index(F.col("level"), F.col("k")))


_EXTENTS = """WITH n AS (SELECT 0 AS dim, CAST(max(l_quantity) AS INTEGER) AS n FROM lineitem UNION ALL SELECT 1, CAST(max(round(l_discount * 100)) AS INTEGER) + 1 FROM lineitem),
 e AS (SELECT dim, n, CAST(CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END AS INTEGER) AS m FROM n)"""


@query(
    f"""{_EXTENTS} SELECT dim, CAST(level AS INTEGER) AS level, CAST(pow(2, m + 1 - greatest(level, 1)) AS BIGINT) AS support, CAST(CASE WHEN level < 2 THEN 1 ELSE pow(2, level - 1) END AS BIGINT) AS coefs,
      CAST(CASE WHEN level = 0 THEN 0 ELSE pow(2, level - 1) END AS BIGINT) AS base FROM (SELECT dim, m, unnest(range(m + 1)) AS level FROM e)"""
)
def level_metadata(spark, d):
    return GridSpec.of(points(spark, d), B).level_table(spark)


@query(
    f"""{_EXTENTS}, a AS (SELECT max(n) FILTER (dim = 0) AS x0, max(n) FILTER (dim = 1) AS x1, max(m) FILTER (dim = 0) AS m0, max(m) FILTER (dim = 1) AS m1 FROM e)
    SELECT x0, x1, CAST(pow(2, m0) AS INTEGER) AS p0, CAST(pow(2, m1) AS INTEGER) AS p1, (m0 + 1) * (m1 + 1) AS n_wavelets, pow(2.0e0, -(m0 + m1) / 2.0e0) AS threshold FROM a"""
)
def decoded_size(spark, d):
    spec = GridSpec.of(points(spark, d), B)
    return spark.createDataFrame([(*spec.decoded(False), *spec.decoded(True), spec.n_wavelets, spec.threshold)], "x0 int, x1 int, p0 int, p1 int, n_wavelets int, threshold double")


@query(_with("SELECT x0, x1, bin, w, round(w * ln(w), 6) AS e, greatest(w - 20.0e0, 0) AS c FROM hist"))
def entropy_term(spark, d):
    _, hist = grid(spark, d)
    return hist.select("x0", "x1", "bin", "w", F.round(binning.entropy_term(F.col("w")), 6).alias("e"), binning.clamp_negative(F.col("w") - F.lit(20.0)).alias("c"))


# Histograms


@query(_with("SELECT * FROM hist"))
def cell_histogram(spark, d):
    return grid(spark, d)[1]


@query(_with("SELECT bin, count(*) AS w FROM pts GROUP BY bin"))
def global_histogram(spark, d):
    return cells.histogram(grid(spark, d)[1])


@query(_with("SELECT bin, CAST(sum(CASE WHEN x1 % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS w FROM pts GROUP BY bin"))
def bin_weights(spark, d):
    rows = points(spark, d)
    spec = GridSpec((50, 11), B).with_range(rows, "value")
    bin_ = binning.bin_linear(F.col("value"), spec.vmin, spec.vmax, B)
    return cells.histogram(cells.cell_histogram(rows, spec.axes, bin_, F.when(F.col("x1") % 2 == 0, 2).otherwise(1)))


def _means(spark, d):
    """A dense field: each cell's number of rows."""
    spec = GridSpec((50, 11), B)
    counts = points(spark, d).groupBy(*spec.axes).agg(F.count(F.lit(1)).alias("n"))
    return spec.lattice(spark).join(counts, spec.axes, "left").select(*spec.axes, F.coalesce("n", F.lit(0)).cast("double").alias("value"))


def _spectrum(spark, d):
    field = _means(spark, d)
    spec = GridSpec((50, 11), B).with_range(field, "value")
    return binning.contour_spectrum(cells.corners(field, 2), 2, B, spec.vmin, spec.vmax)


def _spectrum_sql(field: str, dims: int, lo: str, hi: str) -> str:
    """CTEs from a dense field (x.., value) to spec (x.., bin, w): the simplices of every cell, the share of each below every edge, and its differences by bin."""
    axes = ", ".join(f"x{d}" for d in range(dims))
    sides = ", ".join(f"max(value) FILTER (side = {i})" for i in range(1 << dims))
    up = ", ".join(f"x{d} + 1 - ((side >> {d}) & 1) AS x{d}" for d in range(dims))
    flip = " + ".join(f"((x{d} & 1) << {d})" for d in range(dims))
    orders = list(permutations(range(dims)))
    paths = ", ".join(str(tuple(sum(1 << d for d in order[:i]) for i in range(dims + 1))) for order in orders)
    names = ", ".join(f"p{i}" for i in range(dims + 1))
    t, z = "e[j + 1]", f"v[{dims + 1}]"
    up_to = lambda k: f"({t} - v[{k}])"
    down_from = lambda k: f"(v[{k}] - {t})"
    gap = lambda a, b: f"(v[{a}] - v[{b}])"
    pieces = {
        2: f"""WHEN {t} <= v[2] THEN {up_to(1)} * {up_to(1)} / ({gap(2, 1)} * {gap(3, 1)}) ELSE 1 - {down_from(3)} * {down_from(3)} / ({gap(3, 1)} * {gap(3, 2)})""",
        3: f"""WHEN {t} <= v[2] THEN {up_to(1)} * {up_to(1)} * {up_to(1)} / ({gap(2, 1)} * {gap(3, 1)} * {gap(4, 1)})
          WHEN {t} <= v[3] THEN {up_to(1)} * {up_to(1)} / ({gap(4, 1)} * {gap(3, 1)}) + {up_to(1)} * {up_to(2)} * {down_from(3)} / ({gap(4, 1)} * {gap(3, 2)} * {gap(3, 1)})
            + {up_to(2)} * {up_to(2)} * {down_from(4)} / ({gap(4, 2)} * {gap(3, 2)} * {gap(4, 1)})
          ELSE 1 - {down_from(4)} * {down_from(4)} * {down_from(4)} / ({gap(4, 1)} * {gap(4, 2)} * {gap(4, 3)})""",
    }[dims]
    return f"""
 field AS ({field}),
 edges AS (SELECT list({lo} + ({hi} - {lo}) * CAST(range AS DOUBLE) / 8 ORDER BY range) AS e FROM range(9), (SELECT min(value) AS mn, max(value) AS mx FROM field)),
 corner AS (SELECT {axes}, [{sides}] AS c FROM (SELECT {up}, side, value FROM field, (SELECT CAST(range AS INTEGER) AS side FROM range({1 << dims}))) GROUP BY {axes} HAVING count(*) = {1 << dims}),
 simplex AS (SELECT {axes}, list_sort([{", ".join(f"c[xor({flip}, p{i}) + 1]" for i in range(dims + 1))}]) AS v FROM corner, (VALUES {paths}) o({names})),
 shares AS (SELECT {axes}, bin, CASE WHEN v[1] = {z} THEN CASE WHEN bin = greatest(0, least(7, len(list_filter(e, lambda y: y <= v[1])) - 1)) THEN 1.0e0 ELSE 0.0e0 END
     ELSE u[bin + 2] - u[bin + 1] END AS share FROM (SELECT {axes}, v, e, [CASE WHEN j = 8 OR {t} > {z} THEN 1.0e0 WHEN {t} <= v[1] THEN 0.0e0 {pieces} END for j in range(9)] AS u FROM simplex, edges),
     (SELECT CAST(range AS INTEGER) AS bin FROM range(8))),
 spec AS (SELECT {axes}, CAST(bin AS INTEGER) AS bin, sum(share) / {len(orders)} AS w FROM shares GROUP BY ALL)"""


_FIELD = "SELECT a.x0, b.x1, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM (SELECT CAST(range AS INTEGER) AS x0 FROM range(50)) a CROSS JOIN (SELECT CAST(range AS INTEGER) AS x1 FROM range(11)) b LEFT JOIN (SELECT x0, x1, count(*) AS n FROM pts GROUP BY ALL) p ON p.x0 = a.x0 AND p.x1 = b.x1"
_SPECTRUM = "," + _spectrum_sql(_FIELD, 2, "mn", "mx")


@query(_with("SELECT x0, x1, bin, round(w, 6) AS w FROM spec WHERE round(w, 6) > 0", _SPECTRUM))
def bin_contour_spectrum(spark, d):
    return _spectrum(spark, d).withColumn("w", F.round("w", 6)).filter("w > 0")


@query(_with("SELECT bin, round(sum(w), 6) AS w FROM spec GROUP BY bin", _SPECTRUM))
def global_contour_spectrum(spark, d):
    return _spectrum(spark, d).groupBy("bin").agg(F.round(F.sum("w"), 6).alias("w"))


@query("WITH" + _spectrum_sql(_FIELD3, 3, "mn", "mx") + " SELECT bin, round(sum(w), 4) AS w FROM spec GROUP BY bin")
def contour_spectrum_3d(spark, d):
    spec = GridSpec((50, 11, 7), B)
    field = spec.lattice(spark).join(_volume(spark, d), spec.axes, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    spec = spec.with_range(field, "value")
    return binning.contour_spectrum(cells.corners(field, 3), 3, B, spec.vmin, spec.vmax).groupBy("bin").agg(F.round(F.sum("w"), 4).alias("w"))


def _stat_sql(expression: str) -> str:
    return _with(f"SELECT x1, {expression} AS v FROM (SELECT x1, bin, sum(w) AS w FROM hist GROUP BY x1, bin) GROUP BY x1")


def _stat(spark, d, name):
    rows = grid(spark, d)[1].groupBy("x1", "bin").agg(F.sum("w").alias("w"))
    return rows.groupBy("x1").agg(fields.STATISTICS[name]().alias("v")) if name == "count" else rows.groupBy("x1").agg(F.round(fields.STATISTICS[name](), 6).alias("v"))


@query(_stat_sql("round(sum(bin * w) * 1.0e0 / sum(w), 6)"))
def stat_mean(spark, d):
    return _stat(spark, d, "mean")


@query(_stat_sql("round(sqrt(greatest(sum(bin * bin * w) * 1.0e0 / sum(w) - (sum(bin * w) * 1.0e0 / sum(w)) * (sum(bin * w) * 1.0e0 / sum(w)), 0)), 6)"))
def stat_stddev(spark, d):
    return _stat(spark, d, "stddev")


@query(_stat_sql("round((ln(sum(w)) - sum(w * ln(w)) / sum(w)) / ln(2), 6)"))
def stat_entropy(spark, d):
    return _stat(spark, d, "entropy")


@query(_stat_sql("count(*)"))
def stat_count(spark, d):
    return _stat(spark, d, "count")


# Summed-area tables, boxes, sliding windows

_SAT_SQL = _with("SELECT * FROM sat", _DENSE, _SAT)


@query(_SAT_SQL)
def sat_table(spark, d):
    spec, hist = grid(spark, d)
    return sat.sat(hist, spec)


_POINT_SQL = _with("SELECT bin, CAST(sum(w) AS BIGINT) AS s FROM hist WHERE x0 <= 30 AND x1 <= 8 GROUP BY bin")


@query(_POINT_SQL)
def point_sums_sat(spark, d):
    spec, hist = grid(spark, d)
    return sat.point_sums(sat.sat(hist, spec), HI)


@query(_POINT_SQL)
def point_sums(spark, d):
    spec, found = coefs(spark, d)
    at = spark.range(1).select(F.lit(0).alias("qid"), F.lit(HI[0]).alias("x0"), F.lit(HI[1]).alias("x1"))
    return wavelet.point_sums(found, at, spec).select("bin", F.round("s").cast("long").alias("s"))


_ONE_SQL = _with(f"SELECT bin, CAST(sum(w) AS BIGINT) AS h FROM hist WHERE x0 > {LO[0]} AND x0 <= {HI[0]} AND x1 > {LO[1]} AND x1 <= {HI[1]} GROUP BY bin")


@query(_ONE_SQL)
def region_hist_filter(spark, d):
    """One box, straight from the rows: the flagship query. The box along axis 0 is a range of the raw column too, which the scan can prune by."""
    rows = points(spark, d)
    spec = GridSpec((50, 11), B).with_range(rows, "value")
    within = lineitem(spark, d).filter((F.col("l_quantity") >= LO[0] + 2) & (F.col("l_quantity") < HI[0] + 2))
    return sat.region_filter(cells.linear_histogram(_placed(within, 2), spec), LO, HI)


@query(_with(_BRUTE, _BOXES))
def region_hist_brute(spark, d):
    spec, hist = grid(spark, d)
    return sat.region_brute(hist, boxes(spark), spec)


_CORNER_SQL = _with(f"SELECT qid, bin, CAST(coalesce(h, 0) AS BIGINT) AS h FROM boxes CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(8)) LEFT JOIN ({_BRUTE}) USING (qid, bin)", _BOXES)


@query(_CORNER_SQL)
def region_hist_sat(spark, d):
    spec, hist = grid(spark, d)
    return sat.region_sums(sat.sat(hist, spec), boxes(spark), spec)


def _region(spark, d, merge):
    spec, found = coefs(spark, d)
    return wavelet.region_sums(found, boxes(spark), spec, merge).select("qid", "bin", F.round("h").cast("long").alias("h"))


@query(_with(_BRUTE, _BOXES))
def region_hist(spark, d):
    return _region(spark, d, True)


@query(_with(_BRUTE, _BOXES))
def region_hist_unmerged(spark, d):
    return _region(spark, d, False)


_SWEEP = """,
 boxes AS (SELECT CAST(8192 * k + range AS INTEGER) AS qid, CAST((range * 2654435761 + 12345) % 2147483647 % (50 - e0) AS INTEGER) AS lo0, CAST((range * 2654476264 + 24690) % 2147483647 % (11 - e1) AS INTEGER) AS lo1,
   lo0 + e0 AS hi0, lo1 + e1 AS hi1 FROM range(8192), (VALUES (0, 1, 1), (1, 4, 4), (2, 16, 10)) w(k, e0, e1))"""


def _sweep(spark, d):
    spec, found = coefs(spark, d)
    asked = [sat.random_boxes(spark, spec, window, 8192, 8192 * k) for k, window in enumerate((1, 4, 16))]
    return spec, found, asked[0].union(asked[1]).union(asked[2])


@query(_with(_BRUTE, _SWEEP))
def region_sweep(spark, d):
    """8192 boxes of each of three window lengths, answered together from coefficients."""
    spec, found, asked = _sweep(spark, d)
    return wavelet.region_sums(found, asked, spec).select("qid", "bin", F.round("h").cast("long").alias("h"))


@query(_with(f"SELECT * FROM ({_BRUTE}) WHERE h <> 0", _SWEEP))
def region_sweep_sat(spark, d):
    """The same boxes from summed-area tables."""
    spec, hist = grid(spark, d)
    _, _, asked = _sweep(spark, d)
    return sat.region_sums(sat.sat(hist, spec), asked, spec).filter("h <> 0")


_VIEW = """,
 boxes AS (SELECT CAST(range AS INTEGER) AS qid, CAST(greatest(0, least(49, range * 9 - 20)) AS INTEGER) AS lo0, CAST(greatest(0, least(10, range - 3)) AS INTEGER) AS lo1,
   CAST(greatest(0, least(49, range * 9 - 20 + 15)) AS INTEGER) AS hi0, CAST(greatest(0, least(10, range - 3 + 5)) AS INTEGER) AS hi1 FROM range(12))"""


@query(_with(f"SELECT qid, bin, h, max(h) OVER (PARTITION BY qid) AS most FROM ({_BRUTE})", _VIEW))
def viewer_query(spark, d):
    spec, found = coefs(spark, d)
    i = F.col("id")
    asked = spark.range(12).select(
        i.cast("int").alias("qid"), (i * 9 - 20).alias("loc0"), (i - 3).alias("loc1"), F.lit(15).alias("size0"), F.lit(5).alias("size1")
    )
    out = wavelet.region_sums(found, sat.viewer_boxes(asked, spec), spec).select("qid", "bin", F.round("h").cast("long").alias("h"))
    return out.withColumn("most", F.max("h").over(Window.partitionBy("qid")))


@query(_with("SELECT * FROM near", _DENSE, _NEAR))
def box_sum(spark, d):
    spec, hist = grid(spark, d)
    return sat.box_sums(sat.dense(hist, spec), spec.axes, ["bin"], (-2, -2), (2, 2))


@query(
    _with(
        f"""SELECT x0, x1, round(CASE WHEN {_INSIDE} AND sum(w) > 0 THEN (ln(sum(w)) - sum(CASE WHEN w > 0 THEN w * ln(w) ELSE 0 END) / sum(w)) / ln(8) ELSE 0 END, 6) AS v
        FROM near GROUP BY x0, x1""",
        _DENSE,
        _NEAR,
    )
)
def entropy_field(spark, d):
    spec, hist = grid(spark, d)
    return fields.entropy_field(hist, spec, (-2, -2), (2, 2)).withColumn("v", F.round("v", 6))


@query(
    _with(
        f""", c AS (SELECT x0, x1, bin, w * 1.0e0 / sum(w) OVER (PARTITION BY x0, x1) AS p,
          (sum(w) OVER (PARTITION BY x0, x1 ORDER BY bin) - w) * 1.0e0 / sum(w) OVER (PARTITION BY x0, x1) AS cum FROM g)
        SELECT x0, x1, round(CASE WHEN {_INSIDE} THEN coalesce(max(CASE WHEN cum <= 0.5e0 AND cum + p > 0.5e0 THEN 2 * (bin + (0.5e0 - cum) / p) END), 0) ELSE 0 END, 6) AS v
        FROM c GROUP BY x0, x1""",
        _DENSE,
        _NEAR,
        ",\n g AS (SELECT x0, x1, bin // 2 AS bin, sum(w) AS w FROM near GROUP BY x0, x1, bin // 2)",
    ).replace("\n,", ",\n")
)
def median_field(spark, d):
    spec, hist = grid(spark, d)
    return fields.median_field(hist, spec, (-2, -2), (2, 2), 4).withColumn("v", F.round("v", 6))


@query(_with(f"SELECT x0, x1, round(CASE WHEN {_INSIDE} AND sum(w) > 0 THEN sum(bin * w) * 1.0e0 / sum(w) ELSE 0 END, 6) AS v FROM near GROUP BY x0, x1", _DENSE, _NEAR))
def mean_field(spark, d):
    spec, hist = grid(spark, d)
    return fields.statistic_field(hist, spec, (-2, -2), (2, 2), "mean").withColumn("v", F.round("v", 6))


@query(
    _with(
        f"""SELECT x0, x1, round(CASE WHEN {_INSIDE} AND sum(w) > 0 THEN sqrt(greatest(sum(bin * bin * w) * 1.0e0 / sum(w) - (sum(bin * w) * 1.0e0 / sum(w)) * (sum(bin * w) * 1.0e0 / sum(w)), 0))
        ELSE 0 END, 6) AS v FROM near GROUP BY x0, x1""",
        _DENSE,
        _NEAR,
    )
)
def stddev_field(spark, d):
    spec, hist = grid(spark, d)
    return fields.statistic_field(hist, spec, (-2, -2), (2, 2), "stddev").withColumn("v", F.round("v", 6))


@query(_with(f"SELECT x0, x1, CASE WHEN {_INSIDE} THEN CAST(sum(w) AS DOUBLE) ELSE 0.0e0 END AS v FROM near GROUP BY x0, x1", _DENSE, _NEAR))
def clamp_border(spark, d):
    spec, hist = grid(spark, d)
    sums = sat.box_sums(sat.dense(hist, spec), spec.axes, ["bin"], (-2, -2), (2, 2)).groupBy(*spec.axes).agg(F.sum("w").cast("double").alias("v"))
    return sat.clamp_border(sums, spec, (-2, -2), (2, 2))


@query(_with(f"SELECT x2 AS t, bin, count(*) AS h FROM pts WHERE x0 > {LO[0]} AND x0 <= {HI[0]} AND x1 > {LO[1]} AND x1 <= {HI[1]} AND x2 > 0 GROUP BY x2, bin"))
def time_histogram(spark, d):
    _, hist = grid(spark, d, 3)
    return fields.time_histogram(hist, LO, HI, "x2")


# Wavelet store


@query(_with("SELECT * FROM coefs", _COEF))
def encode_wavelet(spark, d):
    return coefs(spark, d)[1]


@query(_with("SELECT l0, l1, k0, k1, bin, round(ic * sqrt(CASE WHEN l0 > 0 THEN pow(2, l0 - 1) ELSE 1 END) * sqrt(CASE WHEN l1 > 0 THEN pow(2, l1 - 1) ELSE 1 END) / 32, 6) AS coef FROM coefs", _COEF))
def drop_zero_coefs(spark, d):
    spec, found = coefs(spark, d)
    return wavelet.thresholded(found, spec).select(*spec.keys, "bin", F.round(wavelet.coefficient(spec), 6).alias("coef"))


@query(_with("SELECT bin, ic FROM coefs WHERE l0 = 2 AND l1 = 1 AND k0 = 1 AND k1 = 0", _COEF))
def coef_sparse(spark, d):
    return wavelet.coef_sparse(coefs(spark, d)[1], (2, 1), (1, 0))


@query(_with("SELECT l0, l1, k0, k1, bin, ic, CAST(sum(ic) OVER (PARTITION BY l0, l1, k0, k1 ORDER BY bin) AS BIGINT) AS cum, ic AS back FROM coefs", _COEF))
def bin_cumsum(spark, d):
    spec, found = coefs(spark, d)
    summed = wavelet.bin_cumsum(found, spec)
    return wavelet.bin_difference(summed.withColumnRenamed("ic", "was"), spec).select(*spec.keys, "bin", F.col("was").alias("ic"), "cum", F.col("ic").alias("back"))


def _decoded_sql(condition: str) -> str:
    return _with(f"SELECT x0, x1, CAST(sum(s) AS BIGINT) AS s FROM sat WHERE {condition} GROUP BY x0, x1", _DENSE, _SAT)


@query(_decoded_sql("bin = 3"))
def decode_bin(spark, d):
    spec, found = coefs(spark, d)
    return wavelet.decode_bins(found, spec, 3, 3).withColumn("s", F.round("s").cast("long"))


@query(_decoded_sql("bin BETWEEN 2 AND 4"))
def decode_bin_range(spark, d):
    spec, found = coefs(spark, d)
    return wavelet.decode_bins(found, spec, 2, 4).withColumn("s", F.round("s").cast("long"))


@query(_decoded_sql("bin BETWEEN 2 AND 4"))
def clamp_to_datasize(spark, d):
    spec, found = coefs(spark, d)
    return sat.clamp_to_datasize(wavelet.decode_bins(found, spec, 2, 4, padded=True), spec).withColumn("s", F.round("s").cast("long"))


@query(_with("SELECT l0, l1, count(DISTINCT k0 * 1000 + k1) AS n_places, count(*) AS n_values FROM coefs GROUP BY l0, l1", _COEF))
def pool_size(spark, d):
    spec, found = coefs(spark, d)
    return wavelet.pool_sizes(found, spec)


@query(_with("SELECT count(*) AS n_values, round(4400.0e0 / count(*), 6) AS ratio, round(count(*) / 550.0e0, 6) AS overhead FROM coefs", _COEF))
def compression_stats(spark, d):
    spec, found = coefs(spark, d)
    return wavelet.compression(found, spec).select("n_values", F.round("ratio", 6).alias("ratio"), F.round("overhead", 6).alias("overhead"))


@query(
    f"""WITH {_TABLE_BOXES.strip().removeprefix(",").strip()},
 f0 AS (SELECT CAST(range AS INTEGER) AS l0, CAST(pow(2, 7 - range) AS INTEGER) AS w0 FROM range(7)), f1 AS (SELECT CAST(range AS INTEGER) AS l1, CAST(pow(2, 5 - range) AS INTEGER) AS w1 FROM range(5)),
 c AS (SELECT qid, x0, x1, a.s * b.s AS s FROM (SELECT qid, hi0 AS x0, 1 AS s FROM boxes UNION ALL SELECT qid, lo0, -1 FROM boxes) a
   JOIN (SELECT qid, hi1 AS x1, 1 AS s FROM boxes UNION ALL SELECT qid, lo1, -1 FROM boxes) b USING (qid) WHERE x0 >= 0 AND x1 >= 0),
 k AS (SELECT qid, l0, l1, x0 // w0 AS k0, x1 // w1 AS k1, sum(s * CASE WHEN l0 = 0 THEN 2.0e0 / w0 WHEN x0 % w0 < w0 // 2 THEN 1.0e0 / w0 ELSE -1.0e0 / w0 END
   * CASE WHEN l1 = 0 THEN 2.0e0 / w1 WHEN x1 % w1 < w1 // 2 THEN 1.0e0 / w1 ELSE -1.0e0 / w1 END) AS s FROM c, f0, f1 GROUP BY ALL HAVING s <> 0)
SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT qid, count(*) AS n FROM k GROUP BY qid)"""
)
def coefficient_fetches(spark, d):
    return wavelet.fetches(table_boxes(spark, d), GridSpec((50, 11), B)).withColumn("mean", F.round("mean", 6))


@query(_with("SELECT * FROM coefs WHERE k0 * pow(2, 7 - greatest(l0, 1)) >= 30 OR k1 * pow(2, 5 - greatest(l1, 1)) >= 7", _COEF))
def out_of_domain_coefs(spark, d):
    """Of the main grid's coefficients those beyond its first 30 x 7 cells: what a store holds too much if its data ends there."""
    spec, found = coefs(spark, d)
    return wavelet.outside(found, spec, (30, 7))


@query(
    _with("SELECT k0, k1, round(sum(bin * abs(ic)) * 1.0e0 / sum(abs(ic)), 6) AS mean, round((ln(sum(abs(ic))) - sum(abs(ic) * ln(abs(ic))) / sum(abs(ic))) / ln(2), 6) AS entropy, count(*) AS n, round(sqrt(greatest(sum(bin * bin * abs(ic)) * 1.0e0 / sum(abs(ic)) - (sum(bin * abs(ic)) * 1.0e0 / sum(abs(ic))) * (sum(bin * abs(ic)) * 1.0e0 / sum(abs(ic))), 0)), 6) AS stddev FROM coefs WHERE l0 = 5 AND l1 = 3 GROUP BY k0, k1", _COEF)
)
def block_statistics(spark, d):
    spec, found = coefs(spark, d)
    values = wavelet.block_values(found, spec, 2)
    return values.groupBy("k0", "k1").agg(F.round(fields.stat_mean(), 6).alias("mean"), F.round(fields.stat_entropy(), 6).alias("entropy"), fields.stat_count().alias("n"), F.round(fields.stat_stddev(), 6).alias("stddev"))


@query("WITH n AS (SELECT p_size, count(*) AS w FROM part GROUP BY p_size) SELECT CAST(range AS INTEGER) AS x0, CAST(coalesce((SELECT sum(w) FROM n WHERE p_size <= range + 1), 0) AS DOUBLE) AS s FROM range(64)")
def idwt_1d(spark, d):
    """The inverse transform of coefficients that encode makes by aggregation: prefix sums."""
    counts = spark.read.parquet(f"{d}/part.parquet").groupBy((F.col("p_size") - 1).alias("x0")).agg(F.count(F.lit(1)).alias("w"))
    line = GridSpec((50,), 1)
    found = wavelet.encode(counts.withColumn("bin", F.lit(0)), line)
    at = binning.global_index(F.col("l0"), F.col("k0")).cast("int")
    there = found.select(F.lit(0).alias("line"), at.alias("x0"), wavelet.coefficient(line).alias("s"))
    return wavelet.haar_scanlines(there, "line", "x0", "s", 64, inverse=True).select("x0", F.round("s", 6).alias("s"))


@query(
    _with(
        "SELECT l0 AS l, k0 AS k, bin, round(ic * sqrt(CASE WHEN l0 > 0 THEN pow(2, l0 - 1) ELSE 1 END) / 8, 6) AS coef FROM coefs WHERE l1 = 0",
        _COEF.replace("FROM hist,", "FROM (SELECT x0, 15 AS x1, bin, sum(w) AS w FROM hist GROUP BY x0, bin) hist,"),  # at 15 the second axis weighs 1
    )
)
def dwt_1d(spark, d):
    """The dense route along one axis: prefix sums of every bin along axis 0, then the orthonormal transform; equal to what encode gives by aggregation."""
    spec, hist = grid(spark, d)
    line = GridSpec((50,), B)
    sums = sat.sat(hist.groupBy("x0", "bin").agg(F.sum("w").alias("w")), line)
    last = sums.filter("x0 = 49").select(F.explode(F.sequence(F.lit(50), F.lit(63))).alias("x0"), "bin", "s")  # beyond the data the sums stay
    out = wavelet.haar_scanlines(sums.select("bin", "x0", "s").union(last.select("bin", "x0", "s")), "bin", "x0", "s", 64)
    level, k = binning.address(F.col("x0").cast("long"))
    return out.select(level.alias("l"), k.cast("int").alias("k"), "bin", (F.round("s", 6) + 0.0).alias("coef")).filter("coef <> 0")


@query(_with("SELECT * FROM coefs", _COEF))
def encode_sat_dwt(spark, d):
    """The dense route over all axes and bins: summed-area tables, then scanlines transformed axis by axis."""
    spec, hist = grid(spark, d)
    return wavelet.dense_encode(hist, spec)


@query(
    _with(
        """SELECT l0, l1, k0, k1, bin, round(ic, 4) AS ic FROM enc, low WHERE abs(ic) * sqrt(CASE WHEN l0 > 0 THEN pow(2, l0 - 1) ELSE 1 END) * sqrt(CASE WHEN l1 > 0 THEN pow(2, l1 - 1) ELSE 1 END) / 32 > least / 32""",
        _SPECTRUM,
        ",\n low AS (SELECT min(w) AS least FROM spec WHERE w > 1e-9)",
        _COEF.replace("FROM hist,", "FROM (SELECT * FROM spec WHERE w > 1e-9) hist,").replace("AS BIGINT) AS ic", "AS DOUBLE) AS ic").replace(" coefs AS", " enc AS").replace("GROUP BY ALL HAVING ic <> 0", "GROUP BY ALL"),
    )
)
def encode_contour_spectrum(spark, d):
    """Coefficients of a grid with fractional weights in many bins a cell; what is below the smallest weight's threshold is dropped as rounding."""
    hist = _spectrum(spark, d).filter("w > 1e-9")
    spec = GridSpec((50, 11), B)
    least = hist.agg(F.min("w")).first()[0] or 0.0
    return wavelet.thresholded(wavelet.encode(hist, spec), spec, spec.threshold * least).withColumn("ic", F.round("ic", 4))


@query(_with("SELECT CAST(range AS INTEGER) AS bin, coalesce(ic, 0) AS ic FROM range(8) LEFT JOIN (SELECT bin, ic FROM coefs WHERE l0 = 6 AND l1 = 4 AND k0 = 3 AND k1 = 2) ON bin = range", _COEF))
def coef_full(spark, d):
    spec, found = coefs(spark, d)
    return wavelet.coef_full(found, spec, (6, 4), (3, 2))


# Block tree

_EXTENT = ", ".join(f"CAST(k{i} * {n}.0e0 / pow(2, greatest(level - 1, 0)) AS INTEGER) AS lo{i}, CAST((k{i} + 1) * {n}.0e0 / pow(2, greatest(level - 1, 0)) AS INTEGER) AS hi{i}" for i, n in ((0, 64), (1, 16)))


@query(_with(f"SELECT level, k0, k1, round(dist, 6) AS dist, {_EXTENT} FROM nodes", _TREE))
def build_tree(spark, d):
    spec, found = coefs(spark, d)
    return tree.build(found, spec).withColumn("dist", F.round("dist", 6))


@query(_with("SELECT level, k0, k1, bin, round(p, 6) AS p FROM pdf", _TREE))
def hist_to_pdf(spark, d):
    spec, found = coefs(spark, d)
    return tree.node_pdfs(found, spec).withColumn("p", F.round("p", 6))


@query(_with("SELECT level, k0, k1, bin, round(c, 6) AS c FROM cdf", _TREE))
def hist_to_cdf(spark, d):
    spec, found = coefs(spark, d)
    return tree.node_cdfs(tree.node_pdfs(found, spec), spec).withColumn("c", F.round("c", 6))


@query(_with("SELECT level, round(sum(dist), 6) AS total, round(max(dist), 6) AS most FROM nodes GROUP BY level", _TREE))
def cdf_distance(spark, d):
    spec, found = coefs(spark, d)
    return tree.build(found, spec).groupBy("level").agg(F.round(F.sum("dist"), 6).alias("total"), F.round(F.max("dist"), 6).alias("most"))


@query(_with("SELECT level, round(max(p), 6) AS p FROM pdf WHERE bin BETWEEN 1 AND 5 GROUP BY level", _TREE))
def level_max_prob(spark, d):
    spec, found = coefs(spark, d)
    return tree.level_max_prob(tree.node_pdfs(found, spec), 1, 5).withColumn("p", F.round("p", 6))


@query(_with("SELECT pdf.level, k0, k1, bin, round(p / m, 6) AS share FROM pdf JOIN (SELECT level, max(p) AS m FROM pdf GROUP BY level) USING (level)", _TREE))
def level_histogram(spark, d):
    spec, found = coefs(spark, d)
    pdfs = tree.node_pdfs(found, spec)
    return pdfs.join(tree.level_max_prob(pdfs, 0, B - 1).withColumnRenamed("p", "m"), "level").select("level", "k0", "k1", "bin", F.round(F.col("p") / F.col("m"), 6).alias("share"))


@query(
    _with(
        """SELECT a.level, a.k0, a.k1, round(b.dist, 6) AS dist0, round(a.dist, 6) AS dist1 FROM nodes a LEFT JOIN nodes b ON b.level = a.level - 1
        AND b.k0 = CASE WHEN a.level <= 1 THEN 0 ELSE a.k0 // 2 END AND b.k1 = CASE WHEN a.level <= 1 THEN 0 ELSE a.k1 // 2 END WHERE a.level > 0""",
        _TREE,
    )
)
def polylines(spark, d):
    spec, found = coefs(spark, d)
    return tree.polylines(tree.build(found, spec), spec).select("level", "k0", "k1", F.round("dist0", 6).alias("dist0"), F.round("dist1", 6).alias("dist1"))


@query(
    _with(
        """SELECT k0, k1 FROM (SELECT n.k0, n.k1, bool_and(coalesce(p, 0) BETWEEN lo AND hi) AS good FROM node n CROSS JOIN (VALUES (0, 0.0e0, 0.13e0), (1, 0.12e0, 0.9e0), (7, 0.0e0, 0.14e0)) r(bin, lo, hi)
        LEFT JOIN pdf ON pdf.level = n.level AND pdf.k0 = n.k0 AND pdf.k1 = n.k1 AND pdf.bin = r.bin WHERE n.level = 3 GROUP BY n.k0, n.k1) WHERE good""",
        _TREE,
    )
)
def select_by_hist(spark, d):
    spec, found = coefs(spark, d)
    ranges = spark.createDataFrame([(0, 0.0, 0.13), (1, 0.12, 0.9), (7, 0.0, 0.14)], "bin int, lo double, hi double")
    return tree.select_by_hist(tree.node_pdfs(found, spec), spec, 3, ranges)


_PATHS = """,
 good AS (SELECT level, k0, k1 FROM nodes WHERE level NOT IN (3, 4) OR dist BETWEEN 0.02e0 AND 0.35e0),
 leaf AS (SELECT d.k0, d.k1 FROM good d JOIN good c ON c.level = 3 AND c.k0 = d.k0 // 2 AND c.k1 = d.k1 // 2 JOIN good b ON b.level = 2 AND b.k0 = d.k0 // 4 AND b.k1 = d.k1 // 4
   JOIN good a ON a.level = 1 JOIN good r ON r.level = 0 WHERE d.level = 4),
 kept AS (SELECT DISTINCT CAST(n AS INTEGER) AS level, CAST(CASE WHEN n = 0 THEN 0 ELSE k0 >> (4 - n) END AS INTEGER) AS k0, CAST(CASE WHEN n = 0 THEN 0 ELSE k1 >> (4 - n) END AS INTEGER) AS k1
   FROM leaf, (SELECT CAST(range AS INTEGER) AS n FROM range(5)))"""


def _paths(spark, d):
    spec, found = coefs(spark, d)
    nodes = tree.build(found, spec)
    return nodes, tree.filter_paths(nodes, spec, {3: (0.02, 0.35), 4: (0.02, 0.35)})


@query(_with("SELECT * FROM kept", _TREE, _PATHS))
def filter_paths(spark, d):
    return _paths(spark, d)[1]


@query(_with("SELECT n.level, n.k0, n.k1, CASE WHEN kept.level IS NOT NULL THEN 2 ELSE 0 END AS mode FROM node n LEFT JOIN kept ON kept.level = n.level AND kept.k0 = n.k0 AND kept.k1 = n.k1", _TREE, _PATHS))
def mode_bitmask(spark, d):
    nodes, kept = _paths(spark, d)
    marked = tree.with_mode(nodes.select("level", "k0", "k1"), kept, ["level", "k0", "k1"], tree.BY_PATH)
    return marked.withColumn("mode", F.when(tree.mode_matches(tree.BY_PATH), F.col("mode")).otherwise(0))


_TIME = """
 rng AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem),
 h AS (SELECT l_linenumber - 1 AS x, least(7, CAST(floor(8 * (l_extendedprice - mn) / (mx - mn)) AS INTEGER)) AS bin, count(*) AS w FROM lineitem, rng GROUP BY ALL),
 f AS (SELECT CAST(range AS INTEGER) AS l, CAST(pow(2, 4 - range) AS INTEGER) AS u FROM range(4)),
 c AS (SELECT l, x // u AS k, bin, abs(sum(w * CASE WHEN l = 0 THEN u // 2 - x % u WHEN x % u < u // 2 THEN -(x % u) ELSE -(u - x % u) END)) AS ic FROM h, f GROUP BY ALL),
 p AS (SELECT l, bin, sum(ic) * 1.0e0 / sum(sum(ic)) OVER (PARTITION BY l) AS p FROM c GROUP BY l, bin),
 d AS (SELECT l, bin, sum(coalesce(p, 0)) OVER (PARTITION BY l ORDER BY bin) AS c FROM f CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(8)) LEFT JOIN p USING (l, bin))"""


@query(f"WITH {_TIME} SELECT a.l AS level, round(sqrt(sum((a.c - b.c) * (a.c - b.c))), 6) AS dist FROM d a JOIN d b ON b.l = a.l - 1 AND a.bin = b.bin GROUP BY a.l")
def level_distance_l2(spark, d):
    spec, hist = grid(spark, d, 3)
    line = GridSpec((7,), B)
    along = hist.groupBy(F.col("x2").alias("x0"), "bin").agg(F.sum("w").alias("w"))
    return tree.level_distances(along, line).withColumn("dist", F.round("dist", 6))


# User-defined functions

_CLAMPED = """,
 near AS (SELECT a.x0, a.x1, a.bin, CAST(coalesce(sum(h.w), 0) AS BIGINT) AS w FROM dense a LEFT JOIN hist h ON h.bin = a.bin AND h.x0 > greatest(a.x0 - 2, 0) AND h.x0 <= least(a.x0 + 2, 49)
   AND h.x1 > greatest(a.x1 - 2, 0) AND h.x1 <= least(a.x1 + 2, 10) GROUP BY a.x0, a.x1, a.bin)"""


@query(_with("SELECT x0, x1, round(CASE WHEN sum(w) > 0 THEN sum(bin * w) * 1.0e0 / sum(w) ELSE 0 END, 6) AS v FROM near GROUP BY x0, x1", _DENSE, _CLAMPED))
def apply_filter(spark, d):
    spec, hist = grid(spark, d)

    def means(h: np.ndarray) -> np.ndarray:
        return h @ np.arange(h.shape[1]) / np.maximum(h.sum(axis=1), 1)

    return udf.apply_filter(hist, spec, means, (-2, -2), (2, 2), batched=True).withColumn("v", F.round("v", 6))


@query(_stat_sql("round(sqrt(sum(CAST(w AS DOUBLE) * w)) / sum(w), 6)"))
def statistic_functor(spark, d):
    concentration = udf.statistic(lambda bins, values: np.sqrt((values * values).sum()) / values.sum())
    rows = grid(spark, d)[1].groupBy("x1", "bin").agg(F.sum("w").alias("w"))
    return rows.groupBy("x1").agg(concentration(F.col("bin"), F.col("w")).alias("v")).withColumn("v", F.round("v", 6))


@query("SELECT l_linenumber AS x0, bin, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT l_linenumber, CAST(l_quantity AS INTEGER) % 8 AS bin, 0.75e0 AS w FROM lineitem UNION ALL SELECT l_linenumber, (CAST(l_quantity AS INTEGER) + 1) % 8, 0.25e0 FROM lineitem) GROUP BY ALL")
def user_binning(spark, d):
    """A table function that shares each row out between two bins, a batch at a time."""

    def shares(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = values.astype(np.int64)
        return np.tile(np.arange(len(whole)), 2), np.concatenate([whole % 8, (whole + 1) % 8]), np.repeat([0.75, 0.25], len(whole))

    rows = lineitem(spark, d).select(F.col("l_linenumber").alias("x0"), "l_quantity")
    return udf.binning(shares)(rows, "l_quantity").groupBy("x0", "bin").agg(F.sum("w").alias("w"))


# Streaming

_STREAM_SQL = """WITH h AS (SELECT CAST(user_id % 16 AS INTEGER) AS x0, CAST(event_id % 8 AS INTEGER) AS x1, CAST(length(event_type) % 4 AS INTEGER) AS bin, count(*) AS w FROM events GROUP BY ALL),
 f0 AS (SELECT CAST(range AS INTEGER) AS l0, CAST(pow(2, 5 - range) AS INTEGER) AS w0 FROM range(5)), f1 AS (SELECT CAST(range AS INTEGER) AS l1, CAST(pow(2, 4 - range) AS INTEGER) AS w1 FROM range(4))
SELECT l0, l1, CAST(x0 // w0 AS INTEGER) AS k0, CAST(x1 // w1 AS INTEGER) AS k1, bin, CAST(sum(w
   * CASE WHEN l0 = 0 THEN w0 // 2 - x0 % w0 WHEN x0 % w0 < w0 // 2 THEN -(x0 % w0) ELSE -(w0 - x0 % w0) END
   * CASE WHEN l1 = 0 THEN w1 // 2 - x1 % w1 WHEN x1 % w1 < w1 // 2 THEN -(x1 % w1) ELSE -(w1 - x1 % w1) END) AS BIGINT) AS ic FROM h, f0, f1 GROUP BY ALL HAVING ic <> 0"""


def _events(spark, d, dealt: str, files: int = 4) -> DataFrame:
    """events as a stream of files, one to a micro-batch."""
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        (F.col("user_id") % 16).cast("int").alias("x0"), (F.col("event_id") % 8).cast("int").alias("x1"), (F.length("event_type") % 4).cast("int").alias("bin")
    )
    rows.repartition(files).write.mode("overwrite").parquet(dealt)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(dealt)


@query(_STREAM_SQL)
def streaming_encode(spark, d):
    """Micro-batches merged into stored sums by foreachBatch."""
    spec, where = GridSpec((16, 8), 4), scratch(spark, "stream")
    incremental.merge_batches(_events(spark, d, f"{where}/in"), spec, f"{where}/sums", f"{where}/state").start().awaitTermination()
    return incremental.merged(spark.read.parquet(f"{where}/sums"), spec)


@query(_STREAM_SQL)
def streaming_update(spark, d):
    """One running aggregation over the stream; each micro-batch stores what it changes."""
    spec, where = GridSpec((16, 8), 4), scratch(spark, "stream")
    table = incremental.encode_stream(_events(spark, d, f"{where}/in"), spec)
    incremental.store_updates(table, f"{where}/sums", f"{where}/state").start().awaitTermination()
    return incremental.latest(spark.read.parquet(f"{where}/sums"), spec)


@query(
    """WITH c AS (SELECT DISTINCT CAST(user_id % 16 AS INTEGER) AS x0, CAST(event_id % 8 AS INTEGER) AS x1 FROM events),
 f0 AS (SELECT CAST(range AS INTEGER) AS l0, CAST(pow(2, 6 - range) AS INTEGER) AS w0 FROM range(6)), f1 AS (SELECT CAST(range AS INTEGER) AS l1, CAST(pow(2, 4 - range) AS INTEGER) AS w1 FROM range(4))
SELECT l0, l1, CAST(x0 // w0 AS INTEGER) AS k0, CAST(x1 // w1 AS INTEGER) AS k1, count(*) AS seen, CAST((least(20, (x0 // w0 + 1) * least(w0, 32)) - x0 // w0 * least(w0, 32)) * least(w1, 8) AS BIGINT) AS expected,
   count(*) >= (least(20, (x0 // w0 + 1) * least(w0, 32)) - x0 // w0 * least(w0, 32)) * least(w1, 8) AS done FROM c, f0, f1 GROUP BY l0, l1, w0, w1, x0 // w0, x1 // w1"""
)
def complete_in_stream(spark, d):
    """Which coefficients are final after a stream of cells with many rows and bins each, on a grid of which a part has no rows yet."""
    spec, where = GridSpec((20, 8), 4), scratch(spark, "stream")
    arriving = _events(spark, d, f"{where}/in")
    incremental.store_cells(arriving, spec, f"{where}/cells", f"{where}/state").start().awaitTermination()
    return incremental.complete(spark.read.parquet(f"{where}/cells"), spec)


@query(
    """WITH c AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) - 1 AS x0 FROM lineitem), f AS (SELECT CAST(range AS INTEGER) AS l0, CAST(pow(2, 7 - range) AS INTEGER) AS w FROM range(7))
    SELECT l0, CAST(x0 // w AS INTEGER) AS k0, count(*) AS seen, CAST(least(60, (x0 // w + 1) * least(w, 64)) - x0 // w * least(w, 64) AS BIGINT) AS expected,
      count(*) >= least(60, (x0 // w + 1) * least(w, 64)) - x0 // w * least(w, 64) AS done FROM c, f GROUP BY l0, w, x0 // w"""
)
def complete_on_count(spark, d):
    """On an axis of 60, of which lineitem fills 50."""
    rows = lineitem(spark, d).select((F.col("l_quantity").cast("int") - 1).alias("x0")).distinct()
    return incremental.complete(rows, GridSpec((60,), B))


@query(_STREAM_SQL)
def streaming_runs(spark, d):
    """Micro-batches flushed as sorted runs, merged four to one, read by the last snapshot."""
    spec, where = GridSpec((16, 8), 4), scratch(spark, "stream")
    kept = runs.RunStore(spark, f"{where}/runs", spec, 3)
    runs.flush_stream(_events(spark, d, f"{where}/in", 7), kept, f"{where}/state").start().awaitTermination()
    return kept.read()


@query(_STREAM_SQL)
def streaming_final(spark, d):
    """Coefficients emitted once each, when the last cell under them has come; cells come in shuffled order."""
    spec, where = GridSpec((16, 8), 4), scratch(spark, "stream")
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        (F.col("user_id") % 16).cast("int").alias("x0"), (F.col("event_id") % 8).cast("int").alias("x1"), (F.length("event_type") % 4).cast("int").alias("bin")
    )
    whole = completion.whole_cells(cells.cell_histogram(rows, spec.axes, F.col("bin")), spec)
    whole.repartition(4, F.xxhash64("x0", "x1")).write.parquet(f"{where}/in")
    arriving = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    completion.store_final(arriving, spec, f"{where}/out", f"{where}/state").awaitTermination()
    return spark.read.schema(", ".join(f"{k} int" for k in [*spec.keys, "bin"]) + ", ic long").parquet(f"{where}/out")


# Stores and lookups


@query(_with("SELECT * FROM coefs", _COEF))
def encode_packed(spark, d):
    """Encoding by packed keys, straight from rows: projected and reduced in tasks, one shuffle of two numbers a row."""
    rows = points(spark, d)
    spec = GridSpec((50, 11), B).with_range(rows, "value")
    binned = rows.select(*spec.axes, binning.bin_linear(F.col("value"), spec.vmin, spec.vmax, B).alias("bin"), F.lit(1).cast("long").alias("w"))
    return packed.encode(binned, spec)


@query(_with(_BRUTE, _TABLE_BOXES))
def region_stored(spark, d):
    """A box for each supplier from stored coefficients: the scan reads the folders and row groups that the boxes need."""
    spec, found = coefs(spark, d)
    store.write_coefs(found, path := scratch(spark, "coefs"))
    asked = wavelet.wanted(table_boxes(spark, d), spec)
    sums = store.lookup(store.read_store(spark, path), asked).groupBy("qid", "bin").agg(F.sum(F.col("ic") * F.col("s")).alias("h"))
    return sums.select("qid", "bin", F.round("h").cast("long").alias("h")).filter("h <> 0")


@query(_with(f"SELECT budget, qid, bin, h FROM ({_BRUTE}), (VALUES ('none'), ('half'), ('all')) b(budget)", _TABLE_BOXES))
def region_budget(spark, d):
    """The same from two tiers, with no value in memory, half of them, and all."""
    spec, found = coefs(spark, d)
    store.write_coefs(found, path := scratch(spark, "coefs"))
    found = store.read_store(spark, path)
    n, out = found.count(), []
    for name, budget in (("none", 0), ("half", n // 2), ("all", n)):
        kept = tiers.TieredStore.write(found, scratch(spark, f"tiers-{name}"), spec, budget)
        sums = kept.region_sums(table_boxes(spark, d)).select(F.lit(name).alias("budget"), "qid", "bin", F.round("h").cast("long").alias("h"))
        sums.write.parquet(path := scratch(spark, f"budget-{name}"))
        kept.close()
        out.append(spark.read.schema(sums.schema).parquet(path))
    return out[0].union(out[1]).union(out[2])


@query(_with("SELECT qid, CAST(coalesce(sum(w), 0) AS BIGINT) AS h FROM boxes LEFT JOIN hist ON x0 > lo0 AND x0 <= hi0 AND x1 > lo1 AND x1 <= hi1 AND bin >= b0 AND bin <= b1 GROUP BY qid", _TABLE_BOXES))
def region_bin_interval(spark, d):
    """The weight of a range of bins in a box for each supplier, by two lookups a coefficient in sparse running sums."""
    spec, found = coefs(spark, d)
    return intervals.region_intervals(wavelet.bin_cumsum(found, spec), table_boxes(spark, d), spec).select("qid", F.round("h").cast("long").alias("h"))


@query(_with("SELECT l0, l1, k0, k1, bin, 2 * ic AS ic FROM coefs", _COEF))
def hybrid_add(spark, d):
    """Coefficients packed as arrays or pairs, added to themselves and unpacked."""
    spec, found = coefs(spark, d)
    rows = hybrid.pack(found, spec)
    return hybrid.unpack(hybrid.add(rows, rows, spec), spec)


_ASKED = "SELECT p_partkey, CAST(p_size % 7 AS INTEGER) AS l0, CAST(p_partkey % 5 AS INTEGER) AS l1, CAST(p_partkey % CAST(pow(2, greatest(p_size % 7, 1) - 1) AS BIGINT) AS INTEGER) AS k0, CAST(p_partkey % CAST(pow(2, greatest(p_partkey % 5, 1) - 1) AS BIGINT) AS INTEGER) AS k1, CAST(p_partkey % 8 AS INTEGER) AS bin FROM part"


@query(_with(f"SELECT p_partkey, coalesce(ic, 0) AS ic FROM ({_ASKED}) a LEFT JOIN coefs USING (l0, l1, k0, k1, bin)", _COEF))
def hybrid_lookup(spark, d):
    """A value for each part from packed rows, by address and bin."""
    spec, found = coefs(spark, d)
    parts = spark.read.parquet(f"{d}/part.parquet")
    size, key = F.col("p_size"), F.col("p_partkey")
    width = lambda level: F.pow(F.lit(2), F.greatest(level, F.lit(1)) - 1).cast("long")
    asked = {"l0": size % 7, "l1": key % 5, "k0": key % width(size % 7), "k1": key % width(key % 5), "bin": key % 8}
    return hybrid.lookup(hybrid.pack(found, spec), parts.select(key, *(c.cast("int").alias(k) for k, c in asked.items())), spec).select("p_partkey", "ic")


# Rays

_RAYS = """,
 ray AS (SELECT s_suppkey AS ray, -5.0e0 - s_suppkey % 7 AS o0, s_suppkey * 3 % 160 / 10.0e0 AS o1, 1.0e0 + s_suppkey % 5 AS v0, (s_suppkey % 9 - 4) * 0.25e0 AS v1 FROM supplier),
 leaf AS (SELECT k0, k1, k0 * 8.0e0 AS lo0, (k0 + 1) * 8.0e0 AS hi0, k1 * 2.0e0 AS lo1, (k1 + 1) * 2.0e0 AS hi1 FROM node WHERE level = 4),
 met AS (SELECT ray, k0, k1, greatest(0, (lo0 - o0) / v0, CASE WHEN v1 <> 0 THEN least((lo1 - o1) / v1, (hi1 - o1) / v1) ELSE 0 END) AS t,
   least((hi0 - o0) / v0, CASE WHEN v1 <> 0 THEN greatest((lo1 - o1) / v1, (hi1 - o1) / v1) WHEN o1 >= lo1 AND o1 <= hi1 THEN 1e9 ELSE -1 END) AS u FROM ray, leaf)"""


@query(_with("SELECT ray, k0, k1, round(t, 6) AS t FROM (SELECT *, row_number() OVER (PARTITION BY ray ORDER BY t, k0, k1) AS n FROM met WHERE t <= u) WHERE n = 1", _TREE, _RAYS))
def cursor_pick(spark, d):
    """The block that a ray for each supplier meets first."""
    spec, found = coefs(spark, d)
    i = F.col("s_suppkey")
    cols = {"ray": i, "o0": -5.0 - i % 7, "o1": i * 3 % 160 / 10.0, "v0": 1.0 + i % 5, "v1": (i % 9 - 4) * 0.25}
    asked = spark.read.parquet(f"{d}/supplier.parquet").select(*(c.alias(k) for k, c in cols.items()))
    return rays.pick(asked, tree.build(found, spec), spec).withColumn("t", F.round("t", 6))


@query(
    """WITH s AS (SELECT l_suppkey AS ray, l_orderkey AS step, l_extendedprice / 100000 AS c, 1 - exp(-l_discount * l_quantity / 100) AS a FROM lineitem),
 f AS (SELECT ray, c, a, exp(coalesce(sum(ln(1 - a)) OVER (PARTITION BY ray ORDER BY step, c, a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS front FROM s)
SELECT ray, round(sum(front * a * c), 6) AS c, round(1 - min(front * (1 - a)), 6) AS a FROM f GROUP BY ray"""
)
def ray_integral(spark, d):
    """Colour and opacity along a ray for each supplier, from composited segments."""
    a = rays.opacity(F.col("l_discount"), F.col("l_quantity") / 100)
    samples = lineitem(spark, d).select(F.col("l_suppkey").alias("ray"), F.col("l_orderkey").alias("step"), (F.col("l_extendedprice") / 100000).alias("c"), a.alias("a"))
    return rays.composite(rays.segments(samples, 4096)).select("ray", F.round("c", 6).alias("c"), F.round("a", 6).alias("a"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_hist_filter(spark, sf_dir)
