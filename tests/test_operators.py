"""Operators on small inputs made by hand: edges, missing values, flat tiles, and properties."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rastrel.functions import geo, names
from rastrel.operators import augment, classify, focal, grid, masks, metrics, runlog, sampling, transforms


def value(spark, expr, **columns):
    frame = spark.range(1)
    for name, v in columns.items():
        frame = frame.withColumn(name, F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]))
    return frame.select(expr.alias("x")).first()["x"]


def test_flat_tiles(spark):
    t, p = F.col("t"), F.col("p")
    flat, other = [2.0] * 4, [1.0, 2.0, 3.0, 4.0]
    assert value(spark, metrics.zncc(t, p), t=flat, p=other) == 0
    assert value(spark, metrics.psnr(metrics.mse(t, p)), t=flat, p=flat) is None
    assert value(spark, metrics.relative(t, p), t=[1.0], p=[-1.0]) is None
    assert value(spark, metrics.zncc(t, p), t=other, p=[3 * x + 7 for x in other]) == pytest.approx(1)
    assert value(spark, metrics.zncc_sample(t, p), t=other, p=other) == pytest.approx(0.75)


def test_ssim(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random(64), rng.random(64)
    want = []
    for r in range(2):
        for c in range(2):
            x, y = (v.reshape(8, 8)[r : r + 7, c : c + 7].ravel() for v in (a, b))
            cov = np.cov(x, y)
            want.append((2 * x.mean() * y.mean() + 1e-4) * (2 * cov[0, 1] + 9e-4) / ((x.mean() ** 2 + y.mean() ** 2 + 1e-4) * (cov[0, 0] + cov[1, 1] + 9e-4)))
    assert value(spark, metrics.ssim(F.col("t"), F.col("p"), 8, 8), t=a.tolist(), p=b.tolist()) == pytest.approx(np.mean(want))
    assert value(spark, metrics.ssim(F.col("t"), F.col("t"), 8, 8), t=a.tolist()) == pytest.approx(1)


def test_masks(spark):
    nan, inf = float("nan"), float("inf")
    assert value(spark, masks.zero_where_missing(F.col("p"), F.col("t")), t=[nan, 1.0], p=[5.0, 6.0]) == [0, 6]
    assert value(spark, masks.n_missing(F.col("t")), t=[nan, 1.0, nan]) == 2
    assert value(spark, masks.finite(F.col("t")), t=[nan, inf, -inf, 1.0]) == [0, 3.4028234663852886e38, -3.4028234663852886e38, 1]
    assert value(spark, masks.thresholded(F.col("t"), F.col("p")), t=[1.0, 2.0, 2.0], p=[9.0, 30.0, 29.0]) == [0, 0, 29]


@pytest.mark.parametrize("length", [1, 200, 255, 256, 257, 512, 1000, 1001])
def test_grid_covers(spark, length):
    starts = value(spark, grid.overlap_starts(F.col("n"), 256, "cover"), n=length)
    assert starts[0] == 0 and max(starts) == max(0, length - 256)
    assert all(b - a <= 256 for a, b in zip(starts, starts[1:], strict=False))
    reference = value(spark, grid.overlap_starts(F.col("n"), 256), n=length)
    assert len(reference) == (length - 1) // 256 + 1 and min(reference) >= 0


def test_metric_grid_needs_a_step(spark):
    with pytest.raises(ValueError):
        grid.metric_grid(spark.range(1), 10.0, 10.0)


def test_turns_and_flips(spark):
    v = [float(k) for k in range(6)]
    tile = np.array(v).reshape(2, 3)
    for turns in range(4):
        assert value(spark, transforms.quarter_turns(F.col("v"), turns, 2, 3), v=v) == np.rot90(tile, turns).ravel().tolist()
    assert value(spark, transforms.flip_rows(F.col("v"), 2, 3), v=v) == tile[::-1].ravel().tolist()
    assert value(spark, transforms.flip_cols(transforms.flip_cols(F.col("v"), 2, 3), 2, 3), v=v) == v


def test_convolution_and_sobel(spark):
    rng = np.random.default_rng(2)
    tile, kernel = rng.random((5, 4)), rng.random((3, 3))
    got = value(spark, focal.convolve(F.col("v"), kernel.tolist(), 5, 4), v=tile.ravel().tolist())
    assert np.allclose(got, augment.convolve(tile, kernel).ravel())
    gx = value(spark, focal.sobel(F.col("v"), 5, 4)[0], v=tile.ravel().tolist())
    assert np.allclose(gx, augment.convolve(tile, np.array(focal.SOBEL_X)[::-1, ::-1]).ravel())


def test_resample_and_rotate():
    tile = np.arange(36.0).reshape(6, 6)
    assert np.allclose(augment.resample(tile, 6, 6), tile)
    assert np.allclose(augment.resample(np.ones((5, 7)), 9, 3, "cubic"), 1)
    flat = augment.rotated(np.ones((2, 9, 9)), [90, 33])
    assert np.allclose(flat[:, 3:6, 3:6], 1)
    stack = np.random.default_rng(4).normal(size=(3, 8, 8))
    for k in range(3):  # a stack is its tiles one by one
        assert np.allclose(augment.resample(stack, 12, 10)[k], augment.resample(stack[k], 12, 10))
        assert np.allclose(augment.down_and_up(stack, 0.5)[k], augment.down_and_up(stack[k], 0.5))
        assert np.allclose(augment.rotated(stack, [10, 20, 30])[k], augment.rotated(stack[k : k + 1], [10 * k + 10])[0])
    kernels = np.random.default_rng(5).normal(size=(3, 3, 3))
    assert np.allclose(augment.convolve(stack, kernels)[1], augment.convolve(stack[1], kernels[1]))
    assert augment.plasma_size(8, 9) == 16
    fractal = augment.plasma(16, 2.0, augment.draws(np.arange(3), 256))
    assert fractal.shape == (3, 16, 16) and (fractal.min((1, 2)) == 0).all() and np.allclose(fractal.max((1, 2)), 1)
    with pytest.raises(ValueError):
        augment.plasma(12, 2.0, augment.draws(np.arange(1), 144))
    noise = np.array([[0.5, -0.25, 0.75, 0.0]])  # one level: the centre, then the points beside and below the corner
    middle = 5000.0
    heights = np.array([0, middle / 2 - 2500, middle / 2 + 7500, middle])
    low = heights.min()
    assert np.allclose(augment.plasma(2, 2.0, noise).ravel(), (heights - low) / (heights.max() - low))
    assert augment.motion_kernel(np.random.default_rng(1), 0.5).sum() == pytest.approx(1)


def test_utm(spark):
    rows = [(9.0, 0.0), (11.5, 48.1), (-70.2, -33.4), (179.9, 60.0)]
    frame = spark.createDataFrame(rows, "lon double, lat double")
    zone = geo.utm_zone(F.col("lon"))
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), zone)
    back = geo.from_utm(F.col("x"), F.col("y"), F.col("zone"), F.col("lat") < 0)
    out = frame.select("lon", "lat", zone.alias("zone"), x.alias("x"), y.alias("y")).select("*", back[0].alias("lon2"), back[1].alias("lat2")).collect()
    for r in out:
        assert r["lon2"] == pytest.approx(r["lon"], abs=1e-7) and r["lat2"] == pytest.approx(r["lat"], abs=1e-7)
    assert out[0]["x"] == pytest.approx(500000) and out[0]["y"] == pytest.approx(0, abs=1e-6)
    assert out[1]["x"] == pytest.approx(686000, abs=2000) and out[1]["y"] == pytest.approx(5330000, abs=3000)
    assert value(spark, geo.utm_epsg(F.col("lon"), F.col("lat")), lon=180.0, lat=-1.0) == "EPSG:32760"


def test_names(spark):
    p = F.col("p")
    assert value(spark, names.slice_name(p, "image"), p="x/a_b_c_slice_12.tif") == "image0012.tif"
    assert value(spark, names.slice_name(p, "dsm"), p="a_b_c_slice_123456.tif") == "dsm123456.tif"
    assert value(spark, names.stem(p), p="x/.hidden") == ".hidden"
    assert value(spark, names.iteration(p), p="gen_00001500.pt") == 1500
    assert value(spark, names.iteration(p), p="gen_latest.pt") is None
    frame = spark.createDataFrame([("e10",), ("e9",), ("e100",), ("d1",)], "p string")
    assert [r["p"] for r in frame.orderBy(names.natural_key(p)).collect()] == ["d1", "e9", "e10", "e100"]


@pytest.mark.parametrize("n,want", [(9, {"train": 6, "test": 1, "rest": 2}), (785, {"train": 549, "validation": 78, "test": 157, "rest": 1}), (0, {})])
def test_split_sizes(spark, n, want):
    frame = sampling.split(spark.range(n).withColumnRenamed("id", "k"), 1, "k")
    got = {r["split"]: r["count"] for r in frame.groupBy("split").count().collect()}
    assert got == want


def test_split_is_repeatable(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    first = {tuple(r) for r in sampling.split(rows, 3, "k").collect()}
    again = {tuple(r) for r in sampling.split(rows.repartition(7), 3, "k").collect()}
    other = {tuple(r) for r in sampling.split(rows, 4, "k").collect()}
    assert first == again != other


def test_class_report(spark):
    frame = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y_true int, y_pred int")
    rows = {r["class"]: r for r in classify.report(frame).collect()}
    assert rows[2]["recall"] == 0 and rows[2]["precision"] == 0 and rows[1]["precision"] == pytest.approx(1 / 3)
    total = classify.agreement(frame).first()
    assert total["oa"] == 0.5 and total["aa"] == pytest.approx(0.5) and total["kappa"] == pytest.approx((0.5 - 5 / 16) / (1 - 5 / 16))


def test_parts(spark):
    rows = runlog.parts(spark.createDataFrame([("a", 150), ("b", 0), ("c", 100)], "name string, size long"), 100).collect()
    assert sorted((r["name"], r["part"], r["size"]) for r in rows) == [("a", 0, 100), ("a", 1, 50), ("b", 0, 0), ("c", 0, 100)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=3, max_size=6))
def test_slerp_keeps_ends(spark, a):
    if math.sqrt(sum(x * x for x in a)) < 1e-3:
        return
    b = [x + 1.5 for x in a[::-1]]
    if math.sqrt(sum(x * x for x in b)) < 1e-3:
        return
    assert np.allclose(value(spark, transforms.slerp(F.col("a"), F.col("b"), 0.0), a=a, b=b), a, atol=1e-6)


def test_running_means_do_not_depend_on_stretches(spark):
    rows = [("a", 1, 2, 1.5), ("a", 7, 1, 2.0), ("a", 12, 3, None), (None, 3, 1, 4.0), ("a", None, 1, 9.0), (None, 25, 0, 1.0), ("z", 4, 0, 1.0)]
    log = spark.createDataFrame(rows, "metric string, iter long, n long, value double")
    of = lambda stretch: sorted(map(repr, runlog.running_mean(log, "metric", stretch=stretch).collect()))
    assert of(1) == of(5) == of(100_000)
    found = {(r["metric"], r["iter"]): (r["total"], r["count"], r["mean"]) for r in runlog.running_mean(log, "metric", stretch=5).collect()}
    assert found["a", None] == (9.0, 1, 9.0) and found["a", 12] == (14.0, 7, 2.0) and found[None, 25] == (4.0, 1, 4.0)
    assert found["z", 4] == (0.0, 0, None)
    assert runlog.running_mean(log.limit(0), "metric").count() == 0


def test_elapsed_across_stretches(spark):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 3, "2024-01-01 00:00:01"), ("a", 2, "2024-01-01 00:00:01"), ("a", 4, "2024-01-03 00:00:01"), ("a", 5, None), (None, 6, "2024-01-01 00:00:00"), (None, 7, "2024-01-01 00:00:30")]
    log = spark.createDataFrame(rows, "metric string, id long, at string").withColumn("at", F.col("at").cast("timestamp"))
    for seconds in (1, 60, 10**9):
        found = {r["id"]: r["us"] for r in runlog.elapsed(log, "metric", "at", "id", seconds).collect()}
        assert found == {2: 1_000_000, 3: 0, 4: 172_800_000_000, 7: 30_000_000}


def test_warp(spark):
    gt = lambda x0, y0, dx, rx, ry, dy: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x0", "dx", "rx", "y0", "ry", "dy"), (x0, dx, rx, y0, ry, dy), strict=True)])
    own, v = gt(10, 20, 1, 0, 0, -1), [1.0, 2.0, 3.0, 4.0]
    to = lambda place, h, w, **of: value(spark, focal.warped(F.col("v"), own, 2, 2, place, h, w, **of), v=v)
    assert to(own, 2, 2) == v
    assert to(gt(10.5, 19.5, 1, 0, 0, -1), 1, 1) == [2.5]  # between all four
    assert to(gt(8, 20, 1, 0, 0, -1), 2, 2, fill=-9.0) == [-9.0] * 4  # beside the tile
    assert to(gt(10.5, 19.5, 1, 0, 0, -1), 1, 1, no_data=4.0) == [2.0]
    assert to(gt(10, 18, 0, 1, 1, 0), 2, 2) == [3.0, 1.0, 4.0, 2.0]  # turned by a quarter


def test_draws_are_repeated():
    assert np.array_equal(augment.draws(np.array([5, 6]), 8), augment.draws(np.array([5, 6]), 8)) and augment.draws(np.arange(0), 4).shape == (0, 4)
    assert abs(augment.draws(np.arange(500), 16).mean()) < 0.03
