"""Line form, block form and plain NumPy agree; a wrong boundary must not."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import stencil


def smooth(x, sigma, mode="symmetric"):
    r = scalars.kernel_radius(sigma)
    return np.convolve(np.pad(x, r, mode=mode), scalars.gaussian_kernel(sigma, r), "valid")


def line(spark, values, mask=None, more=None):
    rows = [(1, i, len(values), float(v), 1 if mask is None else int(mask[i]), float(more[i]) if more is not None else 0.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k int, i int, n int, v double, m int, w double")


@pytest.mark.parametrize("k, s, expected", [(-2.5, 1, (2.5, 7)), (-2.5, 0.5, (5, 15)), (2.5, 0.5, (2.5, 7)), (-2.5, 1.25, (2, 6))])
def test_sigma_and_radius(k, s, expected):
    sigma = scalars.sigma_in_voxels(k, s)
    assert (sigma, scalars.kernel_radius(sigma)) == expected


def test_weights(spark):
    df = spark.createDataFrame([(0.0,), (0.15,), (1.0,), (float("nan"),), (None,)], "d double")
    got = [r[0] for r in df.select(scalars.distance_to_weight(F.col("d"))).collect()]
    assert got == pytest.approx([1, 0.367879, 0.00127263, 0, 0], rel=1e-5)


@pytest.mark.parametrize("n", [1, 3, 5, 50])
def test_gaussian_line_mirrors_the_edge_sample(spark, n):
    x = np.random.default_rng(n).random(n)
    got = stencil.gaussian_line(line(spark, x), ["k"], ["v"], 2.5).orderBy("i").toPandas()["v"].to_numpy()
    assert np.allclose(got, smooth(x, 2.5))
    if n == 50:
        assert (np.abs(got - smooth(x, 2.5, "reflect")) > 1e-9).sum() == 14


def test_masked_mean(spark):
    rng = np.random.default_rng(4)
    x, m = rng.random(40), rng.random(40) > 0.4
    got = stencil.masked_gaussian_line(line(spark, x, m), ["k"], ["v"], "m", 2.0).orderBy("i").toPandas()["v"].to_numpy()
    assert np.allclose(got, np.where(m, smooth(x * m, 2.0) / np.where(m, smooth(m.astype(float), 2.0), 1), 0))


@pytest.mark.parametrize("a, b, expected", [(1, 0, 0), (2, 3, 0), (-1, 0, 2)])
def test_lncc_of_linear_images(spark, a, b, expected):
    x = np.random.default_rng(5).random(30)
    got = stencil.lncc_line(line(spark, x, more=a * x + b), ["k"], "v", "w", "m", sigma=2.0).toPandas()["distance"]
    assert np.allclose(got, expected, atol=1e-9)


def test_lncc_is_null_without_variance_or_outside(spark):
    x = np.random.default_rng(6).random(30)
    flat = stencil.lncc_line(line(spark, x, more=np.ones(30)), ["k"], "v", "w", "m", sigma=2.0)
    assert flat.where("distance is not null and abs(distance) < 1e6").count() == 0 or flat.where("distance is null").count() > 0
    outside = stencil.lncc_line(line(spark, x, np.arange(30) < 20, x), ["k"], "v", "w", "m", sigma=2.0)
    assert outside.where("i >= 20 and distance is not null").count() == 0


def voxels(spark, box, other=None, mask=None):
    shape = box.shape
    rows = [(1, *map(int, at), *shape, float(box[at]), float(other[at]) if other is not None else 0.0, int(mask[at]) if mask is not None else 1) for at in np.ndindex(shape)]
    return spark.createDataFrame(rows, "k int, x int, y int, z int, nx int, ny int, nz int, v double, w double, m int")


def cube(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["x"], r["y"], r["z"]] = np.nan if r[name] is None else r[name]
    return out


@pytest.mark.parametrize("block", [3, 5, 32])
def test_blocks_equal_the_whole_box(spark, block):
    rng = np.random.default_rng(7)
    box, mask = rng.random((7, 6, 5)), rng.random((7, 6, 5)) > 0.3
    padded = lambda x: np.pad(x, 3, mode="symmetric")
    kernels = [np.array(scalars.gaussian_kernel(1.0))] * 3
    expected = stencil.masked_box([padded(box)], padded(mask.astype(float)), kernels)[0]
    got = stencil.gaussian_blocks(voxels(spark, box, mask=mask), ["k"], "v", (1.0, 1.0, 1.0), "m", block)
    assert np.allclose(cube(got, "v", box.shape), expected)


@pytest.mark.parametrize("nz", [1, 2, 3])
def test_thin_grids_fold_more_than_once(spark, nz):
    rng = np.random.default_rng(9)
    box = rng.random((9, 8, nz))
    kernels = [np.array(scalars.gaussian_kernel(2.5))] * 3
    expected = stencil.smooth_box(np.pad(box, 7, mode="symmetric"), kernels)
    for block in (2, 32):
        got = stencil.gaussian_blocks(voxels(spark, box), ["k"], "v", (2.5,) * 3, block=block)
        assert np.allclose(cube(got, "v", box.shape), expected)
    lines = voxels(spark, box).select("k", "x", "y", F.col("z").alias("i"), F.col("nz").alias("n"), "v")
    line = stencil.gaussian_line(lines, ["k", "x", "y"], ["v"], 2.5).withColumnRenamed("i", "z")
    assert np.allclose(cube(line, "v", box.shape), stencil.smooth_axis(np.pad(box, [(0, 0), (0, 0), (7, 7)], mode="symmetric"), 2, kernels[2]))


def test_many_grids_of_several_sizes_at_once(spark, monkeypatch):
    monkeypatch.setattr(stencil, "_CELLS", 3000)
    rng = np.random.default_rng(10)
    boxes = {k: rng.random((3 + k % 3, 4, 5)) for k in range(12)}
    rows = [(None if k == 0 else k, *map(int, at), *b.shape, float(b[at])) for k, b in boxes.items() for at in np.ndindex(b.shape)]
    df = spark.createDataFrame(rows, "k int, x int, y int, z int, nx int, ny int, nz int, v double")
    got = stencil.gaussian_blocks(df, ["k"], "v", (1.0,) * 3, block=4)
    assert got.count() == len(rows)
    kernels = [np.array(scalars.gaussian_kernel(1.0))] * 3
    for k, b in boxes.items():
        own = got.where(F.col("k").eqNullSafe(F.lit(None if k == 0 else k)))
        assert np.allclose(cube(own, "v", b.shape), stencil.smooth_box(np.pad(b, 3, mode="symmetric"), kernels))


def test_lncc_blocks(spark):
    rng = np.random.default_rng(8)
    box = rng.random((6, 6, 6))
    got = stencil.lncc_blocks(voxels(spark, box, 2 * box + 3), ["k"], "v", "w", "m", (-1.0,) * 3, block=4)
    assert np.allclose(cube(got, "distance", box.shape), 0, atol=1e-8)
    noise = rng.random((6, 6, 6))
    kernels = [np.array(scalars.gaussian_kernel(1.0))] * 3
    padded = lambda x: np.pad(x, 3, mode="symmetric")
    expected = stencil.lncc_box(padded(box), padded(noise), np.ones((12, 12, 12)), kernels)
    got = stencil.lncc_blocks(voxels(spark, box, noise), ["k"], "v", "w", "m", (-1.0,) * 3, block=4)
    assert np.allclose(cube(got, "distance", box.shape), expected)
