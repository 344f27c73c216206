"""Scalar expressions as Column functions; all stay on the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Temperature of the conversion from distance to weight; a fixed value.
TEMPERATURE = 0.15
#: Prior mass below this is dropped; a fixed value.
PRIOR_THRESHOLD = 0.01


def distance_to_weight(distance: Column, temperature: float = TEMPERATURE) -> Column:
    """exp(-d / temperature); a missing or NaN distance weighs nothing."""
    return F.coalesce(F.nanvl(F.exp(-distance.cast("double") / F.lit(temperature)), F.lit(0.0)), F.lit(0.0))


def nan_to_zero(x: Column) -> Column:
    return F.nanvl(x.cast("double"), F.lit(0.0))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null (ANSI mode raises on a bare division)."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def local_variance(mean_of_square: Column, mean: Column) -> Column:
    return mean_of_square - mean * mean


def lncc_distance(mean_i: Column, mean_ii: Column, mean_a: Column, mean_aa: Column, mean_ia: Column) -> Column:
    """1 - cov / sqrt(var * var) from local moments; null where the product of variances isn't positive."""
    product = local_variance(mean_ii, mean_i) * local_variance(mean_aa, mean_a)
    return F.when(product > 0, 1.0 - (mean_ia - mean_i * mean_a) / F.sqrt(product))


def sigma_in_voxels(sigma: float, spacing: float) -> float:
    """A negative sigma is divided by the spacing, a positive one is taken as it is."""
    return abs(sigma / spacing) if sigma < 0 else sigma


def kernel_radius(sigma: float) -> int:
    return math.floor(3 * sigma)


def gaussian_kernel(sigma: float, radius: int | None = None) -> list[float]:
    """Normalised taps from -radius to radius."""
    radius = kernel_radius(sigma) if radius is None else radius
    taps = [math.exp(-0.5 * (k / sigma) ** 2) if sigma else float(k == 0) for k in range(-radius, radius + 1)]
    total = math.fsum(taps)
    return [t / total for t in taps]


def dice(match: Column, pred: Column, truth: Column) -> Column:
    """2 match / (pred + truth), 1 where both are empty."""
    total = pred + truth
    return F.when(total == 0, F.lit(1.0)).otherwise(safe_ratio(2.0 * match, total.cast("double")))


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers, before any text in their place."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.transform(parts, lambda x: F.struct(F.coalesce(x.try_cast("bigint"), F.lit(-1).cast("bigint")).alias("number"), x.alias("text")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def label_name(label: Column, name: Column) -> Column:
    """The name, or a default made of the label."""
    return F.coalesce(name, F.concat(F.lit("label-"), label.cast("string")))


def int_list(cell: Column) -> Column:
    """A bracketed list in a CSV cell, as array<int>."""
    return F.from_json(cell, "array<int>")


def all_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether arrays of numbers have the same length and agree within tolerance."""
    near = F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: x)
