"""Masked Gaussian means and local normalised cross-correlation.

Two forms with the same results. The line form joins samples with kernel taps
and sums (for one axis; pure DataFrame operations). The block form works on
bricks of a grid: bricks are cut with a halo as wide as the kernel, which is
sent to the bricks around, and each brick is filtered on its own as an Arrow
batch. A halo is filled by the mirror image at the grid's faces, folded as often
as a thin grid needs, and by real neighbours inside. Bricks of equal size are
filtered many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import gaussian_kernel, kernel_radius, lncc_distance, safe_ratio, sigma_in_voxels
from gridloom.session import let_workers_import

#: Standard deviation per axis: negative, so divided by the spacing; a fixed value.
LNCC_SIGMA = -2.5


def _taps(df: DataFrame, sigma: float) -> DataFrame:
    radius = kernel_radius(sigma)
    taps = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(w).alias("tap")) for k, w in zip(range(-radius, radius + 1), gaussian_kernel(sigma, radius))))
    return df.select("*", F.inline(taps))


def gaussian_line(samples: DataFrame, keys: list[str], values: list[str], sigma: float, at: str = "i", n: str = "n") -> DataFrame:
    """Gaussian mean along one axis: keys, at, values smoothed. n: the line's length.

    Every sample is sent to the places its taps reach, mirrored ones included,
    and added up there: one shuffle, with partial sums before it.
    """
    # a tap at step k of place i reads the mirror image of i + k: each sample goes to the places that read it
    radius = kernel_radius(sigma)
    places = _taps(samples.select(*keys, F.col(at).alias("_from"), F.col(n).alias("_len"), *values), sigma)
    # places that read _i by step: i with mirrored(i + step) == _i; folds of the mirror within reach
    if radius:
        folds = F.sequence(-F.ceil(F.lit(radius) / (2 * F.col("_len"))) - 1, F.ceil(F.lit(radius) / (2 * F.col("_len"))) + 1)
        places = places.withColumn("_fold", F.explode(folds))
        same = 2 * F.col("_len") * F.col("_fold") + F.col("_from") - F.col("step")
        flip = 2 * F.col("_len") * F.col("_fold") - 1 - F.col("_from") - F.col("step")
        places = places.withColumn(at, F.explode(F.array(same, flip))).where((F.col(at) >= 0) & (F.col(at) < F.col("_len")))
    else:
        places = places.withColumn(at, F.col("_from"))
    summed = places.groupBy(*keys, F.col(at).cast("int").alias(at)).agg(*(F.sum(F.col(v) * F.col("tap")).alias(v) for v in values))
    return summed


def masked_gaussian_line(samples: DataFrame, keys: list[str], values: list[str], mask: str, sigma: float, at: str = "i", n: str = "n") -> DataFrame:
    """Gaussian mean over the samples in the mask, 0 outside: keys, at, mask, values."""
    inside = samples.select(*keys, at, n, F.col(mask).cast("double").alias("_m"), *(F.when(F.col(mask) != 0, F.col(v)).otherwise(0.0).cast("double").alias(v) for v in values))
    smooth = gaussian_line(inside, keys, [*values, "_m"], sigma, at, n).withColumnRenamed("_m", "_w")
    joined = inside.select(*keys, at, "_m").join(smooth, [*keys, at])
    return joined.select(*keys, at, F.col("_m").cast("int").alias(mask), *(F.when(F.col("_m") != 0, safe_ratio(F.col(v), F.col("_w"))).otherwise(0.0).alias(v) for v in values))


def lncc_line(samples: DataFrame, keys: list[str], image: str, atlas: str, mask: str | None = None, sigma: float | None = None, spacing: float = 1.0, at: str = "i", n: str = "n") -> DataFrame:
    """LNCC distance along one axis: keys, at, distance (null where it is undefined). The mask is smoothed once."""
    sigma = sigma_in_voxels(LNCC_SIGMA if sigma is None else sigma, spacing)
    a = F.nanvl(F.col(atlas).cast("double"), F.lit(None))
    there = (F.lit(1) if mask is None else F.coalesce(F.col(mask), F.lit(1))).cast("int")
    rows = samples.select(*keys, at, n, F.when((there != 0) & a.isNotNull(), 1).otherwise(0).alias("_mask"), F.col(image).cast("double").alias("_i"), F.coalesce(a, F.lit(0.0)).alias("_a"))
    rows = rows.withColumns({"_ii": F.col("_i") * F.col("_i"), "_aa": F.col("_a") * F.col("_a"), "_ia": F.col("_i") * F.col("_a")})
    mean = masked_gaussian_line(rows, keys, ["_i", "_ii", "_a", "_aa", "_ia"], "_mask", sigma, at, n)
    return mean.select(*keys, at, F.when(F.col("_mask") != 0, lncc_distance(*(F.col(c) for c in ("_i", "_ii", "_a", "_aa", "_ia")))).alias("distance"))


# blocks ---------------------------------------------------------------------


def smooth_axis(x: np.ndarray, axis: int, taps: np.ndarray) -> np.ndarray:
    """Correlate along an axis, without the margin that the taps need."""
    n = x.shape[axis] - len(taps) + 1
    out = np.zeros([n if a == axis else s for a, s in enumerate(x.shape)])
    for k, w in enumerate(taps):
        out += w * x[(slice(None),) * axis + (slice(k, k + n),)]
    return out


def smooth_box(x: np.ndarray, kernels: list[np.ndarray]) -> np.ndarray:
    """Separable smoothing of boxes that carry their halo; the last three axes are the grid's."""
    for axis, taps in enumerate(kernels, x.ndim - len(kernels)):
        x = smooth_axis(x, axis, taps)
    return x


def masked_box(values: list[np.ndarray], mask: np.ndarray, kernels: list[np.ndarray]) -> list[np.ndarray]:
    """Masked Gaussian means of boxes with halo; the mask is smoothed once."""
    radius = [len(k) // 2 for k in kernels]
    inner = mask[(..., *(slice(r, s - r) for r, s in zip(radius, mask.shape[-len(kernels) :])))]
    weight = smooth_box(mask, kernels)
    weight[inner == 0] = 1
    return [np.where(inner != 0, smooth_box(v * mask, kernels) / weight, 0.0) for v in values]


def lncc_box(image: np.ndarray, atlas: np.ndarray, mask: np.ndarray, kernels: list[np.ndarray]) -> np.ndarray:
    """LNCC distances of boxes with halo; NaN where undefined."""
    m = ((mask != 0) & ~np.isnan(atlas)).astype(float)
    a = np.nan_to_num(atlas)
    mi, mii, ma, maa, mia = masked_box([image, image * image, a, a * a, image * a], m, kernels)
    product_ = (mii - mi * mi) * (maa - ma * ma)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(product_ > 0, 1 - (mia - mi * ma) / np.sqrt(np.where(product_ > 0, product_, 1)), np.nan)


def _images(i: Column, n: Column, r: int) -> Column:
    """The places within r of a line of n samples that read sample i: itself and its mirror images, as often as they fold."""
    if not r:
        return F.array(i)
    folds = F.sequence(-F.ceil(F.lit(r) / (2 * n)) - 1, F.ceil(F.lit(r) / (2 * n)) + 1)
    both = F.flatten(F.transform(folds, lambda f: F.array(2 * n * f + i, 2 * n * f - 1 - i)))
    near = F.filter(both, lambda p: (p >= -r) & (p < n + r))
    # a grid that is wider than the kernel has one image at each face at most
    plain = F.filter(F.array(i, -1 - i, 2 * n - 1 - i), lambda p: (p >= -r) & (p < n + r))
    return F.when((i >= r) & (i < n - r), F.array(i)).when(n > r, plain.cast("array<bigint>")).otherwise(near.cast("array<bigint>"))


def with_halo(voxels: DataFrame, keys: list[str], values: list[str], block: int, radius: tuple[int, int, int]) -> DataFrame:
    """Each voxel sent to every brick that reads it, at its place there.

    voxels: keys, x, y, z, nx, ny, nz and values. Returns keys, bx, by, bz, the
    grid's size, place (px, py, pz) in the brick with halo, and values. A voxel
    in the middle of a brick goes to one; only halos are copied.
    """
    out = voxels
    for axis, r in zip("xyz", radius):
        i, n = F.col(axis).cast("bigint"), F.col(f"n{axis}").cast("bigint")
        out = out.withColumn(f"_p{axis}", F.explode(_images(i, n, r)))
        last = F.floor((n - 1) / block)
        first_b, last_b = F.floor((F.col(f"_p{axis}") - r) / block), F.floor((F.col(f"_p{axis}") + r) / block)
        low, high = F.greatest(first_b, F.lit(0)), F.least(last_b, last)
        out = out.withColumn(f"b{axis}", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
        out = out.withColumn(f"p{axis}", (F.col(f"_p{axis}") - F.col(f"b{axis}") * block + r).cast("int"))
    return out.select(*keys, "bx", "by", "bz", "nx", "ny", "nz", "px", "py", "pz", *values)


def gaussian_blocks(voxels: DataFrame, keys: list[str], value: str, sigma: tuple[float, float, float], mask: str | None = None, block: int = 32) -> DataFrame:
    """Masked Gaussian mean in three dimensions: keys, x, y, z, value. Grids may be of any width."""
    return _blocks(voxels, keys, [value], sigma, mask, block, lambda boxes, m, kernels: masked_box(boxes, m, kernels)[0], value)


def lncc_blocks(voxels: DataFrame, keys: list[str], image: str, atlas: str, mask: str | None = None, sigma: tuple[float, float, float] | None = None, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), block: int = 32) -> DataFrame:
    """LNCC distance in three dimensions: keys, x, y, z, distance (null where undefined)."""
    sigma = tuple(sigma_in_voxels(s, u) for s, u in zip(sigma or (LNCC_SIGMA,) * 3, spacing))
    return _blocks(voxels, keys, [image, atlas], sigma, mask, block, lambda boxes, m, kernels: lncc_box(*boxes, m, kernels), "distance")


def _blocks(voxels: DataFrame, keys: list[str], values: list[str], sigma, mask: str | None, block: int, compute, out: str) -> DataFrame:
    let_workers_import(voxels.sparkSession)
    kernels = [np.array(gaussian_kernel(s)) for s in sigma]
    radius = tuple(len(k) // 2 for k in kernels)
    m = (F.lit(1) if mask is None else F.coalesce(F.col(mask), F.lit(1))).cast("double").alias("_mask")
    rows = with_halo(voxels.select(*keys, "x", "y", "z", "nx", "ny", "nz", m, *(F.col(v).cast("double").alias(v) for v in values)), keys, ["_mask", *values], block, radius)
    group = [*keys, "bx", "by", "bz"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in voxels.select(*keys).schema) + ", " if keys else ""
    at = {name: i for i, name in enumerate(rows.columns)}

    def bricks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Record batches of whole bricks of one size, from rows that come brick by brick."""
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            starts = _starts(batch, [at[c] for c in group])
            yield from _by_size(batch.slice(0, int(starts[-1])), starts[:-1])
            rest = batch.slice(int(starts[-1]))
        if rest is not None:
            yield from _by_size(rest, np.zeros(1, np.int64))

    def _by_size(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        sizes = np.stack([np.minimum(block, batch.column(at[f"n{a}"]).to_numpy()[starts] - batch.column(at[f"b{a}"]).to_numpy()[starts].astype(np.int64) * block) for a in "xyz"], axis=1)
        ends = np.append(starts[1:], batch.num_rows)
        kinds_, which = np.unique(sizes, axis=0, return_inverse=True)
        for k, size in enumerate(kinds_.tolist()):
            own = np.flatnonzero(which.ravel() == k)
            step = max(1, _CELLS // int(np.prod([s + 2 * r for s, r in zip(size, radius)])))
            for a in range(0, len(own), step):
                yield from filtered(batch, starts[own[a : a + step]], ends[own[a : a + step]], size)

    def filtered(batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray, size: list[int]) -> Iterator[pa.RecordBatch]:
        count, shape = ends - starts, [s + 2 * r for s, r in zip(size, radius)]
        brick = np.repeat(np.arange(len(starts)), count)
        where = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        place = (brick, *(batch.column(at[f"p{a}"]).to_numpy()[where] for a in "xyz"))
        boxes = []
        for c in ("_mask", *values):
            box = np.zeros([len(starts), *shape])
            box[place] = batch.column(at[c]).to_numpy(zero_copy_only=False)[where]
            boxes.append(box)
        result = compute(boxes[1:], boxes[0], kernels).ravel()
        cells = int(np.prod(size))
        first = pa.array(np.repeat(starts, cells))
        columns = [batch.column(at[k]).take(first) for k in keys]
        for g, a in zip(np.indices(size), "xyz"):
            corner = batch.column(at[f"b{a}"]).to_numpy()[starts].astype(np.int64) * block
            columns.append(pa.array((corner[:, None] + g.ravel()[None, :]).ravel().astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*columns, pa.array(result, mask=np.isnan(result))], names=[*keys, "x", "y", "z", out])

    dealt = rows.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(bricks, f"{kinds}x int, y int, z int, `{out}` double")


#: Cells with halo that are filtered at once.
_CELLS = 1 << 18


def _starts(batch: pa.RecordBatch, columns: list[int]) -> np.ndarray:
    """Where a new brick begins in rows that come brick by brick."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in columns:
        x = batch.column(c)
        if batch.num_rows > 1:
            a, b = x.slice(1), x.slice(0, batch.num_rows - 1)
            differ = pa.compute.not_equal(a, b).fill_null(False).to_numpy(zero_copy_only=False)
            new[1:] |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)
