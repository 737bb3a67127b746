"""Properties of the grid operators on small random grids, against numpy."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from latticework.functions import binning
from latticework.operators import cells, fields, sat, tree, udf, wavelet
from latticework.plans import queries
from latticework.plans.spec import GridSpec
from latticework.sources import store

DATA = "/root/testdata/sf0.001"


def make(spark, dims, bins, seed, share=0.7):
    """A random cell histogram as an array (bins, *dims), and as a table."""
    rng = np.random.default_rng(seed)
    dense = rng.integers(1, 6, (bins, *dims)) * (rng.random((bins, *dims)) < share)
    at = np.argwhere(dense)
    data = [(*map(int, r[1:]), int(r[0]), int(dense[tuple(r)])) for r in at]
    names = ", ".join(f"x{d} int" for d in range(len(dims)))
    return dense, spark.createDataFrame(data, f"{names}, bin int, w bigint"), GridSpec(tuple(dims), bins)


def haar(line):
    out, smooth = np.zeros(len(line)), np.asarray(line, float)
    while len(smooth) > 1:
        n = len(smooth) // 2
        out[n : 2 * n] = (smooth[0::2] - smooth[1::2]) / math.sqrt(2)
        smooth = (smooth[0::2] + smooth[1::2]) / math.sqrt(2)
    out[0] = smooth[0]
    return out


@pytest.mark.parametrize("dims,bins", [((8, 8), 4), ((5, 7), 3), ((4, 6, 3), 3), ((16,), 2), ((1, 1), 1)])
def test_encode_is_the_haar_transform_of_the_prefix_sums(spark, dims, bins):
    dense, table, spec = make(spark, dims, bins, 1)
    full = np.zeros((bins, *(spec.padded(d) for d in range(len(dims)))))
    full[tuple(slice(0, n) for n in dense.shape)] = dense
    for axis in range(1, full.ndim):
        full = full.cumsum(axis=axis)
    for axis in range(1, full.ndim):
        full = np.apply_along_axis(haar, axis, full)
    got = np.zeros_like(full)
    index = [binning.global_index(F.col(f"l{d}"), F.col(f"k{d}")).cast("int").alias(f"g{d}") for d in range(len(dims))]
    for r in wavelet.encode(table, spec).select("bin", *index, wavelet.coefficient(spec).alias("c")).collect():
        got[tuple(r[:-1])] = r["c"]
    assert np.allclose(got, full, atol=1e-9)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.sampled_from([(5, 7), (9,), (3, 4, 5)]))
def test_three_ways_to_a_region(spark, seed, dims):
    dense, table, spec = make(spark, dims, 3, seed)
    rng = np.random.default_rng(seed)
    boxes = []
    for q in range(5):
        lo = [int(rng.integers(-1, n)) for n in dims]
        boxes.append((q, *lo, *(int(rng.integers(a, n)) for a, n in zip(lo, dims))))
    names = ["qid", *(f"lo{d}" for d in range(len(dims))), *(f"hi{d}" for d in range(len(dims)))]
    asked = spark.createDataFrame(boxes, ", ".join(f"{n} int" for n in names))
    want = {}
    for q, *rest in boxes:
        inside = dense[(slice(None), *(slice(a + 1, b + 1) for a, b in zip(rest[: len(dims)], rest[len(dims) :])))]
        for b, h in enumerate(inside.reshape(3, -1).sum(axis=1)):
            if h:
                want[q, b] = int(h)
    frames = [
        sat.region_brute(table, asked, spec),
        sat.region_sums(sat.sat(table, spec), asked, spec).filter("h <> 0"),
        wavelet.region_sums(wavelet.encode(table, spec), asked, spec),
        wavelet.region_sums(wavelet.encode(table, spec), asked, spec, merge=False),
    ]
    for frame in frames:
        assert {(r["qid"], r["bin"]): r["h"] for r in frame.collect()} == want


def test_decoding_gives_the_prefix_sums_exactly(spark):
    dense, table, spec = make(spark, (5, 7), 3, 5)
    want = dense[1:3].sum(axis=0).cumsum(axis=0).cumsum(axis=1)
    got = {(r["x0"], r["x1"]): r["s"] for r in wavelet.decode_bins(wavelet.encode(table, spec), spec, 1, 2).collect()}
    assert all(got.get((i, j), 0) == want[i, j] for i in range(5) for j in range(7))


def test_encoding_adds_up(spark):
    _, table, spec = make(spark, (5, 7), 3, 6)
    halves = [wavelet.encode(table.filter(F.col("x0") % 2 == k), spec) for k in (0, 1)]
    merged = halves[0].union(halves[1]).groupBy(*spec.keys, "bin").agg(F.sum("ic").alias("ic")).filter("ic <> 0")
    assert sorted(merged.collect()) == sorted(wavelet.encode(table, spec).select(*merged.columns).collect())


def test_entropy_is_between_0_and_1(spark):
    _, table, spec = make(spark, (6, 6), 4, 7)
    found = [r["v"] for r in fields.entropy_field(table, spec, (-1, -1), (1, 1)).collect()]
    assert len(found) == 36 and all(-1e-12 <= v <= 1 + 1e-12 for v in found) and max(found) > 0


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (0.99,), (-3.0,), (9.0,)], "v double")
    assert [r[0] for r in df.select(binning.bin_linear(F.col("v"), 0.0, 1.0, 4)).collect()] == [0, 3, 2, 3, 0, 3]
    assert {r[0] for r in df.select(binning.bin_linear(F.col("v"), 2.0, 2.0, 4)).collect()} == {0}
    vectors = spark.createDataFrame([(None, 1.0), (-99.0, 1.0), (0.0, -0.0), (1.0, 0.0), (-1.0, 0.0), (-1.0, -0.0)], "u double, v double")
    assert [r[0] for r in vectors.select(binning.bin_direction(F.col("u"), F.col("v"), 8, -99.0, -99.0)).collect()] == [0, 0, 1, 6, 9, 9]


def test_contour_spectrum_weights_sum_to_one(spark):
    for dims in (2, 3):
        spec = GridSpec((4,) * dims, 5)
        field = spec.lattice(spark).withColumn("value", F.expr("+".join(f"x{d} * {d + 1}" for d in range(dims))).cast("double"))
        top = 3.0 * sum(range(1, dims + 1))
        found = binning.contour_spectrum(cells.corners(field, dims), dims, 5, 0.0, top)
        sums = [r["w"] for r in found.groupBy(*spec.axes).agg(F.sum("w").alias("w")).collect()]
        assert len(sums) == 3**dims and np.allclose(sums, 1)
    one = binning.below(np.array([[0.0, 1.0, 2.0]]), np.array([[0.0, 1.0, 2.0]]))
    assert np.allclose(one, [[0, 0.5, 1]], atol=1e-3)


def test_paths_and_single_cells(spark):
    _, table, spec = make(spark, (8, 8), 3, 8, share=1.0)
    nodes = tree.build(wavelet.encode(table, spec), spec)
    every = tree.filter_paths(nodes, spec, {})
    levels = {r["level"] for r in every.collect()}
    assert levels == set(range(spec.depth + 1))
    assert tree.filter_paths(nodes, spec, {1: (2.0, 3.0)}).count() == 0
    assert GridSpec((1, 1), 1).levels(0) == 1 and GridSpec((1, 1), 1).depth == 0


def test_nrrd_types(spark, tmp_path):
    from latticework.sources import nrrd

    data = np.arange(24, dtype=">i2")
    (tmp_path / "a.nrrd").write_bytes(b"NRRD0004\ntype: short\ndimension: 3\nsizes: 4 3 2\nendian: big\nencoding: raw\n\n" + data.tobytes())
    nrrd.register(spark)
    found = {tuple(r[:3]): r[3] for r in spark.read.format("nrrd").load(str(tmp_path / "a.nrrd")).collect()}
    assert len(found) == 24 and found[3, 2, 1] == 23.0 and found[1, 0, 0] == 1.0


@pytest.mark.parametrize("dims,bins", [((8, 8), 4), ((5, 7), 3), ((4, 6, 3), 3), ((16,), 2), ((1, 1), 1)])
def test_dense_route_gives_all_coefficients(spark, dims, bins):
    _, table, spec = make(spark, dims, bins, 2)
    want = sorted(map(tuple, wavelet.encode(table, spec).collect()))
    assert want and sorted(map(tuple, wavelet.dense_encode(table, spec).collect())) == want


def test_dense_route_on_the_main_grid(spark):
    spec, found = queries.coefs(spark, DATA)
    want = sorted(map(tuple, found.select(*spec.keys, "bin", "ic").collect()))
    assert len({r[-2] for r in want}) == spec.n_bins
    assert sorted(map(tuple, wavelet.dense_encode(queries.grid(spark, DATA)[1], spec).collect())) == want


def test_contour_spectrum_of_the_whole_volume(spark):
    """Each unit cell's shares add up to 1: of lineitem's volume, and of a cube of balls."""
    assert queries.contour_spectrum_3d(spark, DATA).agg(F.sum("w")).first()[0] == pytest.approx(49 * 10 * 6)
    balls = cells.corners(store.spheres(store.five_balls(spark)), 3)
    assert binning.contour_spectrum(balls, 3, 8, 0.0, 1.5).agg(F.sum("w")).first()[0] == pytest.approx(63**3)


def test_values_without_a_bin(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, None), (1, float("nan")), (1, 3.0), (None, 2.0), (1, 99.0)], "x0 int, value double")
    spec = GridSpec((2,), 2).with_range(rows.filter("value < 4 or value is null or isnan(value)"), "value")
    assert (spec.vmin, spec.vmax) == (1.0, 3.0)
    found = rows.select("value", binning.bin_linear(F.col("value"), spec.vmin, spec.vmax, 2).alias("bin")).collect()
    assert [r["bin"] for r in found] == [0, None, None, 1, 1, 1]
    assert sorted(map(tuple, cells.linear_histogram(rows, spec).collect())) == [(0, 0, 1), (1, 1, 2)]


def test_empty_grids(spark):
    for rows in (spark.createDataFrame([], "x0 int, x1 int, value double"), spark.createDataFrame([(0, 1, None)], "x0 int, x1 int, value double")):
        spec = GridSpec((3, 5), 4).with_range(rows, "value")
        assert spec.vmin is None and spec.vmax is None
        hist = cells.linear_histogram(rows, spec)
        assert hist.count() == 0 and wavelet.encode(hist, spec).count() == 0
        assert {r["s"] for r in sat.sat(hist, spec).collect()} == {0}
        assert {r["v"] for r in fields.entropy_field(hist, spec, (-1, -1), (1, 1)).collect()} == {0.0}


def test_shares_of_simplices():
    """The closed forms against counted points, equal vertices included."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 3):
        inside = rng.dirichlet(np.ones(n + 1), 200_000)
        for values in (rng.random(n + 1), np.repeat(rng.random(), n + 1), np.array([0.2, 0.2, 0.7, 0.9][: n + 1]), np.array([0.1, 0.6, 0.6, 0.6][: n + 1])):
            t = np.linspace(-0.1, 1.1, 7)
            got = binning.below(values[None], t[None])[0]
            want = (inside @ values < t[:, None] - 1e-12).mean(axis=1)
            assert np.abs(got - want).max() < 0.01 and (np.diff(got) >= -1e-12).all()


def test_filters_one_by_one_and_batched(spark):
    rng = np.random.default_rng(8)
    full = rng.integers(0, 4, (6, 5, 3))
    spec = GridSpec((6, 5), 3)
    hist = spark.createDataFrame([(i, j, b, int(full[i, j, b])) for i in range(6) for j in range(5) for b in range(3) if full[i, j, b]], "x0 int, x1 int, bin int, w long")
    want = {}
    for i in range(6):
        for j in range(5):
            a, b, c, d = max(0, i - 2), min(5, i + 1), max(0, min(4, j + 1)), min(4, j + 2)
            want[i, j] = float(full[a + 1 : b + 1, c + 1 : d + 1].sum(axis=(0, 1)) @ [1, 10, 100])
    for function, batched in ((lambda h: h @ [1, 10, 100], True), (lambda h: h[0] + 10 * h[1] + 100 * h[2], False)):
        got = udf.apply_filter(hist, spec, function, (-2, 1), (1, 2), batched)
        assert {(r["x0"], r["x1"]): r["v"] for r in got.collect()} == want


def test_stores_with_a_level(spark, tmp_path):
    hist = spark.range(20000).select((F.col("id") % 50).cast("int").alias("x0"), (F.hash("id") % 7).alias("bin"), F.xxhash64("id").alias("w"))
    for name, level in (("gzip", 1), ("gzip", 9), ("zstd", 3), ("zstd", 19)):
        store.write_bins(hist, f"{tmp_path}/{name}{level}", ["x0"], compression=name, level=level)
        assert store.read_bins(spark, f"{tmp_path}/{name}{level}").exceptAll(hist).count() == 0
    with pytest.raises(ValueError):
        store.write_bins(hist, f"{tmp_path}/snappy", ["x0"], compression="snappy", level=3)
