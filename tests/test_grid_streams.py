"""Streams: final coefficients once each over restarts, and runs merged behind a manifest."""

import math

import pytest
from pyspark.sql import functions as F

from latticework.operators import cells, wavelet
from latticework.plans.spec import GridSpec
from latticework.sources.manifest import Manifests
from latticework.streaming import completion, runs

SPEC = GridSpec((10, 6), 3)


def points(spark, n=400):
    i = F.col("id")
    return spark.range(n).select((i * i % 10).cast("int").alias("x0"), (i * 7 % 5).cast("int").alias("x1"), (i % 3).cast("int").alias("bin"))


def rows(df):
    return sorted(map(tuple, df.select(*SPEC.keys, "bin", "ic").collect()))


def test_final_coefficients_over_a_restart(spark, tmp_path):
    hist = cells.cell_histogram(points(spark), SPEC.axes, F.col("bin"))
    want = rows(wavelet.encode(hist, SPEC))
    whole = completion.whole_cells(hist, SPEC)
    assert whole.count() == 60 and whole.filter("size(bins) = 0").count() > 0
    dealt = whole.withColumn("part", F.pmod(F.xxhash64("x0", "x1"), F.lit(3)))
    where, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for turn in range(3):
        dealt.filter(F.col("part") == turn).drop("part").coalesce(1).write.mode("append").parquet(where)
        completion.store_final(spark.readStream.schema(whole.schema).parquet(where), SPEC, out, state).awaitTermination()
        held = spark.read.format("statestore").option("stateVarName", "held").load(state).count()
        got = rows(spark.read.schema(", ".join(f"{k} int" for k in [*SPEC.keys, "bin"]) + ", ic long").parquet(out))
        if turn < 2:  # some are final, and only those whose cells have all come
            here = dealt.filter(F.col("part") <= turn).select("x0", "x1").collect()
            assert held > 0 and set(got) < set(want) and all(done(k, {tuple(r) for r in here}) for k in {g[:4] for g in got})
    assert got == want and held == 0  # each once, and nothing is left


def done(place, seen):
    l0, l1, k0, k1 = place
    spans = [range(k * SPEC.support(d, level), min(SPEC.dims[d], (k + 1) * SPEC.support(d, level))) for d, (level, k) in enumerate(((l0, k0), (l1, k1)))]
    return all((x, y) in seen for x in spans[0] for y in spans[1])


def test_a_cell_that_comes_twice_is_an_error(spark, tmp_path):
    hist = cells.cell_histogram(points(spark), SPEC.axes, F.col("bin"))
    whole = completion.whole_cells(hist, SPEC)
    whole.union(whole.filter("x0 = 3 and x1 = 3")).coalesce(1).write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="come twice"):
        completion.store_final(spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in")), SPEC, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()


def test_cells_that_come_again_are_passed_over(spark, tmp_path):
    hist = cells.cell_histogram(points(spark), SPEC.axes, F.col("bin"))
    whole, where = completion.whole_cells(hist, SPEC), str(tmp_path / "in")
    for condition in ("x0 < 6", "x0 > 2", "x0 < 9"):  # overlapping parts, the last without anything new
        whole.filter(condition).coalesce(1).write.mode("append").parquet(where)
        completion.store_final(spark.readStream.schema(whole.schema).parquet(where), SPEC, str(tmp_path / "out"), str(tmp_path / "state"), True).awaitTermination()
    got = spark.read.schema(", ".join(f"{k} int" for k in [*SPEC.keys, "bin"]) + ", ic long").parquet(str(tmp_path / "out"))
    assert rows(got) == rows(wavelet.encode(hist, SPEC))


def test_the_sessions_state_store_setting_returns(spark):
    key = completion._PROVIDER
    before = spark.conf.get(key, None)
    with completion.rocks(spark):
        assert spark.conf.get(key) == completion._ROCKS
    assert spark.conf.get(key, None) == before


def test_runs_stay_few_and_snapshots_hold(spark, tmp_path):
    kept = runs.RunStore(spark, str(tmp_path), SPEC, 3)
    every, old = points(spark), None
    for n in range(14):
        batch = every.filter(F.pmod(F.xxhash64("x0", "x1", "bin"), F.lit(14)) == n)
        kept.append(wavelet.encode(cells.cell_histogram(batch, SPEC.axes, F.col("bin")), SPEC), n)
        assert len(kept.runs()) <= 2 * math.ceil(math.log(n + 2, 3))
        if n == 4:
            old = kept.read(), rows(kept.read())
    assert rows(kept.read()) == rows(wavelet.encode(cells.cell_histogram(every, SPEC.axes, F.col("bin")), SPEC))
    assert rows(old[0]) == old[1]  # its runs are merged away, but there
    kept.append(kept.read(), 13)  # tried again: known
    assert kept.manifests.read()["batch"] == 13 and len(kept.manifests.versions()) == 14
    before = rows(kept.read())
    assert kept.vacuum(2) > 0 and kept.vacuum(2) == 0 and rows(kept.read()) == before and kept.manifests.versions() == [12, 13]
    with pytest.raises(ValueError):
        kept.read(3)
    assert len(kept.manifests.children(f"{tmp_path}/runs")) >= len(kept.runs())


def test_runs_of_nothing(spark, tmp_path):
    kept = runs.RunStore(spark, str(tmp_path), SPEC)
    assert kept.read().count() == 0 and kept.vacuum() == 0


def test_flushes_go_on_after_a_restart(spark, tmp_path):
    kept = runs.RunStore(spark, str(tmp_path / "runs"), SPEC, 2)
    every, where = points(spark), str(tmp_path / "in")
    for turn in range(2):
        every.filter(F.col("x0") % 2 == turn).repartition(2).write.mode("append").parquet(where)
        arriving = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(where)
        runs.flush_stream(arriving, kept, str(tmp_path / "state")).start().awaitTermination()
    assert rows(kept.read()) == rows(wavelet.encode(cells.cell_histogram(every, SPEC.axes, F.col("bin")), SPEC))
    assert kept.manifests.read()["batch"] >= 3 and len(kept.runs()) <= 3


def test_two_writers_of_one_snapshot(spark, tmp_path):
    log = Manifests(spark, str(tmp_path))
    assert log.read() == {} and log.commit({"a": 1}, -1) == 0
    with pytest.raises(ValueError):
        log.commit({"a": 2}, -1)
    assert log.read() == {"a": 1, "version": 0} and log.read(0)["a"] == 1
