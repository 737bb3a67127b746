"""Volumes, stores, tiers, lookups, table functions and rays, against brute force and by their plans."""

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import hybrid, intervals, packed, rays, sat, tree, udf, wavelet
from latticework.plans import queries
from latticework.plans.spec import GridSpec
from latticework.sources import netcdf, nrrd, store, tiers

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def volume(spark):
    cells = spark.range(6 * 5 * 4).filter("id % 11 <> 3")
    return cells.selectExpr("cast(id % 6 as int) t", "cast(id div 6 % 5 as int) z", "cast(id div 30 as int) x", "cast(id as double) * 1.5 u", "case when id % 7 > 0 then cast(id as double) end v")


def test_netcdf_round_trip_and_slabs(spark, tmp_path):
    table = volume(spark)
    netcdf.write(table, str(tmp_path / "vol"), {"t": 6, "z": 5, "x": 4}, ["u", "v"], "float", -9999.0)
    read = spark.read.format("netcdf").option("variable", "u,v").load(str(tmp_path / "vol"))
    want = rows(spark.range(120).selectExpr("cast(id % 6 as int) t", "cast(id div 6 % 5 as int) z", "cast(id div 30 as int) x").join(table, ["t", "z", "x"], "left"))
    assert rows(read) == want
    slab = spark.read.format("netcdf").option("variable", "v").option("slab", "t=1:3,x=1:3").load(str(tmp_path / "vol"))
    assert rows(slab) == [(t, z, x, v) for t, z, x, _, v in want if 1 <= t < 3 and 1 <= x < 3]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        asked = spark.read.format("netcdf").option("variable", "u").option("filters", "true").load(str(tmp_path / "vol"))
        for condition, good in (("t = 2 and z >= 3", lambda t, z, x: t == 2 and z >= 3), ("x in (0, 3) and t < 2", lambda t, z, x: x in (0, 3) and t < 2), ("t > 7", lambda t, z, x: False)):
            assert rows(asked.filter(condition)) == [r[:4] for r in want if good(*r[:3])]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


class Counted:
    """A file that counts the bytes read of it."""

    def __init__(self, file, counts):
        self.file, self.counts = file, counts

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def read_at(self, n, at):
        self.counts.append(n)
        return self.file.read_at(n, at)

    def size(self):
        return self.file.size()


def test_only_the_slabs_bytes_are_read(spark, tmp_path, monkeypatch):
    netcdf.write(volume(spark), str(tmp_path / "vol"), {"t": 6, "z": 5, "x": 4}, ["u", "v"], "double", -1.0)
    reader = netcdf.NetcdfReader(str(tmp_path / "vol"), ["u"], {"t": (2, 3), "z": (1, 2)}, 8)
    plain, counts = netcdf._open, []

    def opened(path):
        system, where = plain(path)

        class System:
            def open_input_file(self, name):
                return Counted(system.open_input_file(name), counts)

        return System(), where

    monkeypatch.setattr(netcdf, "_open", opened)
    found = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in found) == 4 and sum(counts) == 4 * 8


def test_netcdf_files_of_others(spark, tmp_path):
    """A CDF-1 file with a fixed variable of short numbers, a global text and a record variable alone in its records, written as a stream."""
    name = lambda t: struct.pack(">i", len(t)) + t + b"\0" * (-len(t) % 4)
    dims = struct.pack(">ii", 10, 2) + name(b"time") + struct.pack(">i", 0) + name(b"lon") + struct.pack(">i", 3)
    words = struct.pack(">ii", 12, 1) + name(b"title") + struct.pack(">ii", 2, 5) + b"hello\0\0\0"
    fill = struct.pack(">ii", 12, 1) + name(b"_FillValue") + struct.pack(">ii", 3, 1) + struct.pack(">h", -7) + b"\0\0"

    def whole(first, second):
        fixed = name(b"depth") + struct.pack(">ii", 1, 1) + fill + struct.pack(">iii", 3, 8, first)
        record = name(b"heat") + struct.pack(">iii", 2, 0, 1) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 3, 8, second)
        return b"CDF\1" + struct.pack(">I", 0xFFFFFFFF) + dims + words + struct.pack(">ii", 11, 2) + fixed + record

    size = len(whole(0, 0))
    body = struct.pack(">hhh", 5, -7, 9) + b"\0\0" + struct.pack(">6h", *range(10, 16))  # records of one variable aren't padded
    (tmp_path / "a.nc").write_bytes(whole(size, size + 8) + body)
    netcdf.register(spark)
    depth = spark.read.format("netcdf").option("variable", "depth").load(str(tmp_path / "a.nc"))
    assert rows(depth) == [(0, 5), (1, None), (2, 9)]
    heat = spark.read.format("netcdf").option("variable", "heat").load(str(tmp_path / "a.nc"))
    assert rows(heat) == [(t, x, 10 + 3 * t + x) for t in range(2) for x in range(3)]
    assert netcdf.headers(str(tmp_path / "a.nc"))[0].attributes["title"] == "hello"
    (tmp_path / "b.nc").write_bytes(b"CDF\5" + bytes(60))
    with pytest.raises(ValueError):
        netcdf.headers(str(tmp_path / "b.nc"))


def test_failed_writers_leave_nothing(spark, tmp_path):
    """A task that meets a cell outside the volume fails; what the others have written goes too."""
    wrong = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (5, 99, 3.0)], "x1 int, x0 int, v double")
    with pytest.raises(Exception):
        nrrd.write_nrrd(wrong, (4, 6), str(tmp_path / "a.nhdr"))
    wrong = wrong.withColumnsRenamed({"x1": "t", "x0": "x"})
    with pytest.raises(Exception):
        netcdf.write(wrong, str(tmp_path / "vol"), {"t": 6, "x": 4}, ["v"])
    assert not [f for _, _, files in os.walk(tmp_path) for f in files]


def test_nrrd_planes_without_rows_and_patterns(spark, tmp_path):
    field = spark.createDataFrame([(0, 0, 1.5), (3, 4, 2.5)], "x0 int, x1 int, v double")
    nrrd.write_nrrd(field, (4, 6), str(tmp_path / "a.nhdr"), kind="float")
    read = spark.read.format("nrrd").option("slabs", 4).load(str(tmp_path / "a.nhdr"))
    assert rows(read.filter("value <> 0")) == [(0, 0, 1.5), (3, 4, 2.5)] and read.count() == 24
    for k in range(3):
        (tmp_path / f"p{k:02d}.raw").write_bytes(np.arange(8 * k, 8 * k + 8, dtype="<i2").tobytes())
    (tmp_path / "p.nhdr").write_text("NRRD0004\ntype: short\ndimension: 2\nsizes: 4 6\nendian: little\nencoding: raw\ndata file: p%02d.raw 0 2 1\n\n")
    assert rows(spark.read.format("nrrd").option("slabs", 5).load(str(tmp_path / "p.nhdr"))) == sorted(((i % 4, i // 4, float(i)) for i in range(24)), key=str)


@pytest.fixture(scope="module")
def encoded(spark, tmp_path_factory):
    spec, found = queries.coefs(spark, DATA)
    path = str(tmp_path_factory.mktemp("coefs"))
    store.write_coefs(found, path)
    return spec, store.read_store(spark, path), path


def _box(spark, *corners):
    return spark.createDataFrame([(i, *c) for i, c in enumerate(corners)], "qid int, lo0 int, lo1 int, hi0 int, hi1 int")


def scanned(df):
    """Files that the scans of a collected DataFrame have read."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        metrics = node.metrics()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found += metrics.apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_range_partitions_are_even(spark, encoded, tmp_path):
    """No task gets a quarter of the coefficients."""
    spec, coefs, _ = encoded
    keys = store.address_order(spec.keys)
    sizes = [r["n"] for r in coefs.repartitionByRange(8, *keys).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 0.2 * sum(sizes)


def test_lookups_read_what_they_name(spark, encoded):
    spec, coefs, path = encoded
    asked = spark.createDataFrame([(6, 4, 3, 2), (6, 4, 5, 2), (2, 1, 1, 0)], "l0 int, l1 int, k0 int, k1 int")
    found = store.lookup(coefs, asked)
    assert rows(found.select(*spec.keys, "bin", "ic")) == rows(coefs.join(asked, spec.keys).select(*spec.keys, "bin", "ic"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "l0" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(k0" in plan
    every = sum(len([f for f in files if f.endswith(".parquet")]) for _, _, files in os.walk(path))
    assert 0 < scanned(store.narrowed(coefs, asked)) < every
    assert store.lookup(coefs, asked.limit(0)).count() == 0


def test_tiers_answer_alike_and_skip_folders(spark, encoded, tmp_path):
    spec, coefs, _ = encoded
    boxes = _box(spark, (10, 2, 30, 8), (-1, -1, 49, 10), (5, 5, 5, 9), (20, 0, 24, 3))
    want = rows(wavelet.region_sums(coefs, boxes, spec))
    n = coefs.count()
    for budget in (0, n // 2, n):
        kept = tiers.TieredStore.write(coefs, str(tmp_path / str(budget)), spec, budget)
        assert rows(kept.region_sums(boxes)) == want
        held = 0 if kept.hot is None else kept.hot.count()
        assert held <= budget and (held > 0) == (budget > 0) and (budget < n or len(kept.hot_wavelets) == spec.n_wavelets)
        if budget == n // 2:
            assert held > budget // 2
            cold = next(w for w in range(spec.n_wavelets) if w not in kept.hot_wavelets)
            one = coefs.withColumn("w", tiers.number(spec)).filter(F.col("w") == cold).select(*spec.keys).distinct()
            plan = kept.lookup(one)._jdf.queryExecution().executedPlan().toString()
            filters = [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]
            assert any("tier" in f and f"wavelet" in f and str(cold) in f for f in filters)
            assert rows(kept.lookup(one).select(*spec.keys, "bin", "ic")) == rows(coefs.join(one, spec.keys).select(*spec.keys, "bin", "ic"))
        kept.close()


def test_budget_takes_the_fullest_first(spark):
    spec = GridSpec((4, 4), 4)
    cells = [(l0, l1, 0, 0, b, 1) for l0, l1, n in ((0, 0, 4), (0, 1, 3), (1, 1, 3), (2, 0, 1)) for b in range(n)]
    coefs = spark.createDataFrame(cells, "l0 int, l1 int, k0 int, k1 int, bin int, ic long")
    assert tiers.chosen(coefs, spec, 3) == [1] and tiers.chosen(coefs, spec, 4) == [0] and tiers.chosen(coefs, spec, 8) == [0, 1, 6] and tiers.chosen(coefs, spec, 0) == []


def test_stored_coefficients_with_a_broadcast_of_the_coarse_ones(spark, encoded, monkeypatch):
    spec, coefs, _ = encoded
    boxes = queries.boxes(spark)
    want = rows(wavelet.region_sums(coefs, boxes, spec))
    few = wavelet.coarse_levels(spec, 400)
    assert 0 < len(few) < spec.n_wavelets and (0, 0) in few
    monkeypatch.setattr(wavelet, "coarse_levels", lambda s: few)
    assert rows(wavelet.region_sums(coefs, boxes, spec, stored=True)) == want


def test_packed_keys(spark):
    spec, hist = queries.grid(spark, DATA, 3)
    assert rows(packed.encode(hist, spec)) == rows(wavelet.encode(hist, spec))
    some = hist.limit(300)
    half = some.withColumn("w", F.col("w") * 0.5)
    assert rows(packed.encode(half.union(half), spec).withColumn("ic", F.col("ic").cast("long"))) == rows(wavelet.encode(some, spec).filter("ic <> 0")) or some.count() == 300
    odd = spark.createDataFrame([(1, 2, None, 1), (None, 2, 1, 1), (1, 2, 3, None)], "x0 int, x1 int, bin int, w long")
    assert packed.encode(odd, GridSpec((4, 4), 4)).count() == 0
    with pytest.raises(ValueError):
        packed.strides(GridSpec((1 << 30, 1 << 30), 16), 16)


def test_hybrid_rows(spark, encoded):
    spec, coefs, _ = encoded
    kept = hybrid.pack(coefs, spec)
    assert rows(hybrid.unpack(kept, spec).select(*coefs.columns)) == rows(coefs)
    size = hybrid.size(kept).first()
    assert size["n_full"] and size["n_sparse"] and size["bytes"] < min(size["as_pairs"], size["n_rows"] * spec.n_bins * hybrid.VALUE)
    gone = hybrid.pack(coefs.withColumn("ic", -F.col("ic")), spec)
    assert hybrid.add(kept, gone, spec).count() == 0
    asked = coefs.sample(0.1, 3).select(*spec.keys, "bin", F.lit(7).alias("note"))
    asked = asked.union(spark.createDataFrame([(6, 4, 31, 7, 9, 1), (6, 4, 31, 7, -1, 1), (6, 4, 31, 7, None, 1)], asked.schema))
    want = asked.join(coefs, [*spec.keys, "bin"], "left").select(*spec.keys, "bin", "note", F.coalesce("ic", F.lit(0)).alias("ic"))
    assert rows(hybrid.lookup(kept, asked, spec)) == rows(want)


def test_bin_intervals(spark, encoded):
    spec, coefs, _ = encoded
    hist = queries.grid(spark, DATA)[1]
    rng = random.Random(2)
    asked = [(q, a := rng.randrange(-1, 49), b := rng.randrange(-1, 10), rng.randrange(a, 50), rng.randrange(b, 11), lo := rng.randrange(-2, 9), rng.randrange(lo - 1, 11)) for q in range(40)]
    boxes = spark.createDataFrame(asked, "qid int, lo0 int, lo1 int, hi0 int, hi1 int, b0 int, b1 int")
    got = {r["qid"]: round(r["h"]) for r in intervals.region_intervals(wavelet.bin_cumsum(coefs, spec), boxes, spec).collect()}
    cells = [tuple(r) for r in hist.collect()]
    assert got == {q: sum(w for x, y, b, w in cells if a < x <= c and e < y <= f and lo <= b <= hi) for q, a, e, c, f, lo, hi in asked}


def test_as_of_takes_the_last_not_above(spark):
    stored = spark.createDataFrame([("a", 1, 10), ("a", 4, 40), ("b", 2, 20)], "k string, at int, v int")
    asked = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("a", 9), ("b", 2), ("c", 5)], "k string, at int")
    assert rows(intervals.as_of(stored, asked, ["k"], "at", "v")) == [("a", 1, 10), ("a", 3, 10), ("a", 9, 40), ("b", 2, 20)]


def test_brute_boxes_over_tiles(spark):
    spec, hist = queries.grid(spark, DATA)
    boxes = _box(spark, (-5, -1, 60, 12), (3, 2, 3, 9), (0, 0, 49, 1), (48, 9, 49, 10))
    want = rows(hist.join(boxes, (F.col("x0") > F.col("lo0")) & (F.col("x0") <= F.col("hi0")) & (F.col("x1") > F.col("lo1")) & (F.col("x1") <= F.col("hi1"))).groupBy("qid", "bin").agg(F.sum("w").alias("h")))
    for tiles_ in (1, 16, 4096):
        assert rows(sat.region_brute(hist, boxes, spec, tiles_)) == want


def test_picking_in_three_dimensions(spark):
    rng = random.Random(8)
    spec = GridSpec((16, 8, 8), 1)
    leaves = sorted({(rng.randrange(4), rng.randrange(4), rng.randrange(4)) for _ in range(20)})
    nodes = {(0, 0, 0, 0), *((d, *(k >> (spec.depth - d) for k in leaf)) for leaf in leaves for d in range(1, spec.depth + 1))}
    width = lambda level, d: spec.padded(d) // (1 << max(level - 1, 0))
    every = [(n[0], *n[1:], *(n[1 + d] * width(n[0], d) for d in range(3)), *((n[1 + d] + 1) * width(n[0], d) for d in range(3))) for n in sorted(nodes)]
    shape = ", ".join(["level int", *(f"{c}{d} int" for c in ("k", "lo", "hi") for d in range(3))])
    asked = []
    for i in range(80):
        o = [rng.uniform(-10, 20) for _ in range(3)]
        asked.append((i, *o, *(rng.choice([0.0, *[(rng.uniform(0, n) - x) / 7] * 5]) for n, x in zip(spec.dims, o))))
    table = spark.createDataFrame(asked, "ray int, o0 double, o1 double, o2 double, v0 double, v1 double, v2 double")
    got = {r["ray"]: (round(r["t"], 9), r["k0"], r["k1"], r["k2"]) for r in rays.pick(table, spark.createDataFrame(every, shape), spec).collect()}
    want = {}
    for ray in asked:
        o, v, hits = ray[1:4], ray[4:], []
        for n in every:
            if n[0] != spec.depth:
                continue
            first, last = 0.0, float("inf")
            for d in range(3):
                lo, hi = n[4 + d], n[7 + d]
                if v[d] == 0:
                    last = last if lo <= o[d] <= hi else -1
                else:
                    a, b = sorted(((lo - o[d]) / v[d], (hi - o[d]) / v[d]))
                    first, last = max(first, a), min(last, b)
            if first <= last:
                hits.append((first, *n[1:4]))
        if hits:
            want[ray[0]] = min(hits)
    assert got == {k: (round(h[0], 9), *h[1:]) for k, h in want.items()} and len(want) > 5


def test_compositing_is_associative(spark):
    rng = random.Random(4)
    samples = [(i % 3, rng.randrange(200), rng.random(), rng.choice([0.0, 0.1, 0.5, rng.random()])) for i in range(300)] + [(7, k, 0.5, 1.0 if k == 40 else 0.01) for k in range(90)]
    table = spark.createDataFrame(samples, "ray int, step int, c double, a double")
    want = {}
    for ray in (0, 1, 2, 7):
        colour, clear = 0.0, 1.0
        for _, _, c, a in sorted(s for s in samples if s[0] == ray):
            colour, clear = colour + clear * a * c, clear * (1 - a)
        want[ray] = (round(colour, 9), round(1 - clear, 9))
    for length in (1, 7, 1000):
        assert {r["ray"]: (round(r["c"], 9), round(r["a"], 9)) for r in rays.composite(rays.segments(table, length)).collect()} == want


def test_table_function(spark):
    def only_even(values):
        at = np.flatnonzero(values % 2 == 0)
        return at, values[at] // 2, np.ones(len(at))

    table = spark.createDataFrame([(1, "a", 4.0), (2, None, 3.0), (3, "c", None), (4, "d", 4.0)], "id int, note string, v double")
    assert rows(udf.binning(only_even)(table, "v")) == [(1, "a", 2, 1.0), (4, "d", 2, 1.0)]
    assert "Exchange" not in udf.binning(only_even)(table, "v")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        udf.binning(only_even)(table.withColumnRenamed("note", "bin"), "v")


def test_balls(spark):
    found = {tuple(r)[:3]: r["value"] for r in store.spheres(store.five_balls(spark, 32), 32).collect()}
    assert len(found) == 32**3 and max(found.values()) < 1.1 and abs(found[24, 24, 24] - 1) < 1e-6


def test_tree_of_picked_blocks_has_parents(spark):
    spec, found = queries.coefs(spark, DATA)
    nodes = {(r["level"], r["k0"], r["k1"]) for r in tree.build(found, spec).collect()}
    assert all((n[0] - 1, *((0, 0) if n[0] == 1 else (n[1] // 2, n[2] // 2))) in nodes for n in nodes if n[0])
