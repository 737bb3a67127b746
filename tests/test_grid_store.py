"""The stored grid and the command line."""

import pytest

from latticework.__main__ import main
from latticework.api import ROUTES, GridStore
from latticework.sources import netcdf, nrrd

LINEITEM = "/root/testdata/sf0.001/lineitem.parquet"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("grid"))
    main(
        ["encode", LINEITEM, where, "--coords", "cast(l_quantity as int) - 1", "cast(round(l_discount * 100) as int)", "--value", "l_extendedprice", "--dims", "50,11", "--n-bins", "4", "--budget", "900"],
        spark,
    )
    return where


def test_routes_agree(spark, path):
    grid = GridStore(spark, path)
    boxes = grid.boxes(((10, 2), (30, 8)), ((-1, -1), (49, 10)), ((5, 5), (5, 9)))
    found = [{(r["qid"], r["bin"]): round(r["h"]) for r in grid.region_histogram(boxes, route).collect() if r["h"]} for route in ROUTES]
    assert all(f == found[0] for f in found) and sum(v for (q, _), v in found[0].items() if q == 1) == spark.read.parquet(LINEITEM).count()
    assert grid.size() == (50, 11) and grid.levels() == (7, 5) and grid.n_bins() == 4 and grid.spec.vmin is not None


def test_fields_and_blocks(spark, path, tmp_path):
    grid = GridStore(spark, path)
    for field in (grid.entropy_field(2), grid.median_field(2, 2), grid.region_sum(0, 1, (-1, -1), (1, 1)), grid.apply_filter(lambda h: h.sum(), (-1, -1), (1, 1))):
        assert field.count() == 550
    assert grid.block_statistics(2, "mean").count() > 0 and grid.block_statistics(0, "mean").count() == 0
    assert grid.coef_sparse((2, 1), (1, 0)).count() <= 4 and grid.bin_aggregate(1, 2).count() == 550
    main(["query", path, "--box", "10,2", "30,8", "--route", "sat", "--out", str(tmp_path / "out")], spark)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    main(["stats", path], spark)


def test_random_boxes_contours_and_bins_only(spark, path, tmp_path):
    for route in ("coefs", "bins"):
        main(["query", path, "--random", "50", "--window", "4", "--route", route, "--out", str(tmp_path / route)], spark)
    found = [{(r["qid"], r["bin"]): round(r["h"]) for r in spark.read.parquet(str(tmp_path / route)).collect()} for route in ("coefs", "bins")]
    assert found[0] == found[1] and len({q for q, _ in found[0]}) > 10
    common = ["--coords", "cast(l_quantity as int) - 1", "cast(round(l_discount * 100) as int)", "--value", "l_extendedprice", "--dims", "50,11", "--n-bins", "4"]
    main(["encode", LINEITEM, str(tmp_path / "c"), *common, "--contour", "--only", "bins", "--compression", "gzip", "--level", "9"], spark)
    grid = GridStore(spark, str(tmp_path / "c"))
    shares = grid.bins.groupBy("x0", "x1").agg({"w": "sum"}).collect()
    assert len(shares) > 400 and all(abs(r["sum(w)"] - 1) < 1e-9 for r in shares)
    assert not (tmp_path / "c" / "coefs").exists()


def test_volumes_as_input_and_times(spark, tmp_path, capsys):
    """The same cells from a NetCDF slab and an NRRD volume; the command line prints what each phase took."""
    cells = spark.range(8 * 6 * 5).selectExpr("cast(id % 8 as int) x0", "cast(id div 8 % 6 as int) x1", "cast(id div 48 as int) x2", "cast(id * 7 % 50 as double) v")
    nrrd.write_nrrd(cells, (8, 6, 5), str(tmp_path / "a.nhdr"))
    netcdf.write(cells.withColumnsRenamed({"x2": "t", "x1": "y", "x0": "x"}), str(tmp_path / "vol"), {"t": 5, "y": 6, "x": 8}, ["v"])
    found = []
    for name, options in (("a.nhdr", ["--format", "nrrd", "--coords", "x0", "x1", "x2", "--value", "value"]), ("vol", ["--format", "netcdf", "--variable", "v", "--coords", "x", "y", "t", "--value", "v"])):
        main(["encode", str(tmp_path / name), str(tmp_path / f"{name}-grid"), *options, "--dims", "8,6,5", "--n-bins", "5", "--times"], spark)
        assert '"encode"' in capsys.readouterr().err
        grid = GridStore(spark, str(tmp_path / f"{name}-grid"))
        found.append(sorted(map(tuple, grid.coefs.select(*grid.spec.keys, "bin", "ic").collect())))
    assert found[0] == found[1] and found[0]
    main(["encode", str(tmp_path / "vol"), str(tmp_path / "slice"), "--format", "netcdf", "--variable", "v", "--slab", "t=2", "--coords", "x", "y", "--value", "v", "--dims", "8,6", "--n-bins", "5"], spark)
    assert sum(r["w"] for r in GridStore(spark, str(tmp_path / "slice")).bins.collect()) == 48


def test_bin_ranges_and_picks(spark, path, tmp_path):
    grid = GridStore(spark, path)
    main(["query", path, "--box", "10,2", "30,8", "--bins", "1", "2", "--out", str(tmp_path / "out")], spark)
    whole = {r["bin"]: r["h"] for r in grid.region_histogram(grid.boxes(((10, 2), (30, 8))), "bins").collect()}
    assert [r["h"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [whole.get(1, 0) + whole.get(2, 0)]
    ray = spark.createDataFrame([(1, -3.0, 5.0, 1.0, 0.0), (2, -3.0, -5.0, 1.0, 0.0)], "ray int, o0 double, o1 double, v0 double, v1 double")
    assert [(r["ray"], r["k0"], r["k1"]) for r in grid.pick(ray).collect()] == [(1, 0, 2)]
