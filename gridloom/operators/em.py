"""Expectation maximisation of a class map from intensities and priors.

A native approximation after the published algorithms (Gaussian classes, priors
per voxel, a Potts field over the six faces' neighbours, a polynomial bias
field). It stands in for an external program and does not claim its numbers.

Every subject has a model of its own and ends by its own likelihood. A voxel is
one row with a column for each class, so that a round without a field is one
pass without a shuffle; with it, voxels and what their neighbours send meet in
one aggregation.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import safe_ratio
from gridloom.operators.fusion import BACKGROUND, dimension
from gridloom.session import drop, written

#: Defaults; fixed values.
MAX_ITERATIONS, MIN_ITERATIONS, MRF_BETA, BIAS_ORDER, BIAS_THRESHOLD = 30, 3, 0.1, 4, 0.05
#: Classes are columns: a bound on their number.
MOST_CLASSES = 256
_FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
_LEAST_VARIANCE = 1e-6


def tissue_em(
    voxels: DataFrame,
    priors: DataFrame,
    keys: list[str],
    max_iterations: int = MAX_ITERATIONS,
    min_iterations: int = MIN_ITERATIONS,
    mrf_beta: float = MRF_BETA,
    bias_order: int = 0,
    tolerance: float = 1e-4,
    coords: tuple[str, str, str] | None = None,
    mask: str | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Posterior of each voxel's classes, with the prior: keys, tissue, q, prior.

    voxels: keys, intensity, and coords for the field and the bias. priors:
    keys, tissue, q, sparse; a voxel without prior has no result. by: the
    columns that tell subjects apart, by default the keys that are no coords if
    there are coords, else none. Where the column mask is 0 a voxel takes no
    part and is background alone.

    The loop keeps a few numbers a subject on the driver (means, variances, the
    bias polynomial); voxels are written each round, so that a round is computed
    once, lineage stays short and lost executors cost one round. A subject that
    has ended keeps its last round.
    """
    by = ([k for k in keys if k not in coords] if coords else []) if by is None else by
    spark = voxels.sparkSession
    field, bias = bool(mrf_beta and coords), bool(bias_order and coords)
    classes = sorted(r[0] for r in priors.select("tissue").distinct().limit(MOST_CLASSES + 1).collect())
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    if not classes:
        return voxels.join(priors, keys).select(*keys, "tissue", "q", F.col("q").alias("prior"))
    beside = [c for c in coords or () if c not in keys]
    n = range(len(classes))
    q, p = [f"_q{i}" for i in n], [f"_p{i}" for i in n]
    by_class = priors.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("tissue") == t, F.col("q"))), F.lit(0.0)).alias(p[i]) for i, t in zip(n, classes)))
    inside = (F.coalesce(F.col(mask), F.lit(1)) != 0) if mask else F.lit(True)
    rows = voxels.select(*keys, *beside, F.col("intensity").cast("double").alias("_i"), inside.alias("_in")).join(by_class, keys)
    start, path = written(rows, "em-input")
    outside = start.where(~F.col("_in"))
    state = start.where("_in").select(*keys, *beside, "_i", *p, *(F.col(a).alias(b) for a, b in zip(p, q)))
    powers = [x for x in product(range(bias_order + 1), repeat=3) if sum(x) <= bias_order] if bias else []
    sizes = {_key(r, by): [max(1, r[c]) for c in coords] for r in state.groupBy(*by).agg(*(F.max(c).alias(c) for c in coords)).collect()} if bias else {}
    bent: dict[tuple, np.ndarray] = {}
    last: dict[tuple, float] = {}
    ended: list[DataFrame] = []
    older: list[str] = []
    for iteration in range(max_iterations):
        stats = _with_model(state, by, {}, sizes, bent, powers, coords, classes) if bias else state
        value = F.col("_i") - _bias(powers, coords, sizes) if bias else F.col("_i")
        sums = [F.sum(f(F.col(c))).alias(f"{name}{i}") for i, c in zip(n, q) for name, f in (("w", lambda x: x), ("s", lambda x: x * value), ("t", lambda x: x * value * value))]
        model = {_key(r, by): _gaussians(r, n) for r in stats.groupBy(*by).agg(*sums).collect()}
        if not model:
            break
        now, at = written(_expectation(_with_model(state, by, model, sizes, bent, powers, coords, classes), keys, beside, q, p, by, coords, mrf_beta if field else 0.0, _bias(powers, coords, sizes) if bias else F.lit(0.0)), "em")
        likelihood = {_key(r, by): r["l"] or 0.0 for r in now.groupBy(*by).agg(F.sum("_l").alias("l")).collect()}
        done = [k for k, x in likelihood.items() if iteration + 1 == max_iterations or (k in last and iteration + 1 >= min_iterations and abs(x - last[k]) <= tolerance * abs(last[k]))]
        if bias:
            bent = bias_fields(_with_model(now, by, model, sizes, {}, powers, coords, classes), by, q, powers, coords, sizes)
        if done:
            ended.append(_of(now, by, done))
        drop(spark, *older)
        older = [] if done else [at]
        last = {k: x for k, x in likelihood.items() if k not in done}
        if not last:
            break
        state = _of(now, by, list(last)) if done else now
    out = [*ended] or [state]
    result = reduce(DataFrame.unionByName, (x.select(*keys, *q, *p) for x in out))
    each = lambda values: F.inline(F.array(*(F.struct(F.lit(t).alias("tissue"), v.alias("q"), F.col(p[i]).alias("prior")) for i, t, v in values)))
    found = result.select(*keys, each([(i, t, F.col(q[i])) for i, t in zip(n, classes)])).where("prior > 0")
    if not mask:
        return found
    background = F.col(p[classes.index(BACKGROUND)]) if BACKGROUND in classes else F.lit(0.0)
    kind = priors.schema["tissue"].dataType
    return found.unionByName(outside.select(*keys, F.lit(BACKGROUND).cast(kind).alias("tissue"), F.lit(1.0).alias("q"), background.alias("prior")))


def _key(row, by: list[str]) -> tuple:
    return tuple(row[c] for c in by)


def _of(df: DataFrame, by: list[str], subjects: list[tuple]) -> DataFrame:
    """The rows of some subjects."""
    if not by:
        return df
    wanted = df.sparkSession.createDataFrame(subjects, df.select(*by).schema)
    return df.join(dimension(wanted), by, "left_semi")


def _gaussians(row, n: range) -> tuple[list[float], list[float]]:
    """Means and variances of the classes; a class without mass has none."""
    mean = [row[f"s{i}"] / row[f"w{i}"] if row[f"w{i}"] else None for i in n]
    return mean, [max(row[f"t{i}"] / row[f"w{i}"] - m * m, _LEAST_VARIANCE) if m is not None else None for i, m in zip(n, mean)]


def _with_model(df: DataFrame, by: list[str], model: dict, sizes: dict, bent: dict, powers: list, coords, classes: list) -> DataFrame:
    """Each voxel with its subject's model: arrays _mean, _var, _size and _bent (null: no bias yet)."""
    rows = [(*k, *(model.get(k) or (None, None)), [float(x) for x in sizes[k]] if k in sizes else None, bent[k].tolist() if k in bent else None) for k in (model or sizes)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema), "_mean array<double>", "_var array<double>", "_size array<double>", "_bent array<double>"])
    table = df.sparkSession.createDataFrame(rows, schema)
    return df.join(dimension(table), by) if by else df.crossJoin(F.broadcast(table))


def _basis(powers: list, coords: tuple[str, str, str]) -> list[Column]:
    """Monomials of the coordinates, from -1 to 1 over a subject's grid."""
    unit = [2 * F.col(c) / F.col("_size")[i] - 1 for i, c in enumerate(coords)]
    return [reduce(lambda x, y: x * y, (u for u, k in zip(unit, p) for _ in range(k)), F.lit(1.0)) for p in powers]


def _bias(powers: list, coords: tuple[str, str, str], sizes: dict) -> Column:
    terms = [F.col("_bent")[i] * x for i, x in enumerate(_basis(powers, coords))]
    return F.coalesce(reduce(lambda x, y: x + y, terms), F.lit(0.0))


def _expectation(rows: DataFrame, keys: list[str], beside: list[str], q: list[str], p: list[str], by: list[str], coords, mrf_beta: float, bias: Column) -> DataFrame:
    """New posteriors, and each voxel's log likelihood _l."""
    n = range(len(q))
    if mrf_beta:
        # a voxel and what its neighbours send meet in one aggregation; what falls outside the grid meets none
        own = [F.struct("_i", "_mean", "_var", "_size", "_bent", *p, *(c for c in beside)).alias("_own")]
        sent = F.array(*(F.struct(*(F.lit(d).alias(f"_d{k}") for k, d in enumerate(s)), F.lit(s == (0, 0, 0)).alias("_self")) for s in [(0, 0, 0), *_FACES]))
        moved = rows.select(*[k for k in keys if k not in coords], *coords, *own, *q, F.inline(sent))
        places = [(F.col(c) + F.col(f"_d{k}")).alias(c) for k, c in enumerate(coords)]
        moved = moved.select(*[k for k in keys if k not in coords], *places, F.when(F.col("_self"), F.col("_own")).alias("_own"), *(F.when(~F.col("_self"), F.col(c)).alias(c) for c in q))
        groups = [*[k for k in keys if k not in coords], *coords]
        rows = moved.groupBy(*groups).agg(F.max("_own").alias("_own"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"_around{c}") for c in q)).where(F.col("_own").isNotNull())
        rows = rows.select(*groups, *(f"_own.{c}" for c in ("_i", "_mean", "_var", "_size", "_bent", *p)), *(f"_around{c}" for c in q))
    value = F.col("_i") - bias
    log = []
    for i in n:
        mean, var = F.col("_mean")[i], F.col("_var")[i]
        x = F.log(F.col(p[i])) - 0.5 * F.log(var) - (value - mean) * (value - mean) / (2 * var)
        log.append(F.when((F.col(p[i]) > 0) & mean.isNotNull(), x + mrf_beta * F.col(f"_around{q[i]}") if mrf_beta else x))
    rows = rows.select(*keys, *beside, "_i", *p, *(x.alias(f"_g{i}") for i, x in zip(n, log)))
    top = F.greatest(*(F.col(f"_g{i}") for i in n)) if len(q) > 1 else F.col("_g0")
    rows = rows.withColumn("_top", top)
    rows = rows.select(*keys, *beside, "_i", *p, "_top", *(F.coalesce(F.exp(F.col(f"_g{i}") - F.col("_top")), F.lit(0.0)).alias(f"_u{i}") for i in n))
    rows = rows.withColumn("_z", reduce(lambda x, y: x + y, (F.col(f"_u{i}") for i in n)))
    return rows.select(*keys, *beside, "_i", *p, *(F.coalesce(safe_ratio(F.col(f"_u{i}"), F.col("_z")), F.lit(0.0)).alias(q[i]) for i in n), F.when(F.col("_z") > 0, F.log(F.col("_z")) + F.col("_top")).alias("_l"))


def bias_fields(rows: DataFrame, by: list[str], q: list[str], powers: list, coords: tuple[str, str, str], sizes: dict) -> dict[tuple, np.ndarray]:
    """For each subject a polynomial in the coordinates fitted to what the classes' means leave.

    The normal equations are one aggregation; only their few numbers reach the
    driver.
    """
    n, basis = len(powers), _basis(powers, coords)
    precision = [F.coalesce(F.col(c) / F.col("_var")[i], F.lit(0.0)) for i, c in enumerate(q)]
    rows = rows.withColumns({"_w": reduce(lambda x, y: x + y, precision), "_r": reduce(lambda x, y: x + y, (w * F.coalesce(F.col("_i") - F.col("_mean")[i], F.lit(0.0)) for i, w in enumerate(precision)))})
    rows = rows.select(*by, "_w", "_r", *(x.alias(f"_x{i}") for i, x in enumerate(basis)))
    sums = [F.sum(F.col("_w") * F.col(f"_x{j}") * F.col(f"_x{k}")) for j in range(n) for k in range(j, n)] + [F.sum(F.col("_r") * F.col(f"_x{j}")) for j in range(n)]
    out = {}
    for r in rows.groupBy(*by).agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).collect():
        got = [r[f"s{i}"] for i in range(len(sums))]
        matrix = np.zeros((n, n))
        matrix[np.triu_indices(n)] = got[: n * (n + 1) // 2]
        matrix = matrix + matrix.T - np.diag(np.diag(matrix))
        fit = np.linalg.lstsq(matrix + 1e-9 * np.eye(n), np.array(got[n * (n + 1) // 2 :]), rcond=None)[0]
        fit[powers.index((0, 0, 0))] = 0.0  # a constant belongs to the means
        out[_key(r, by)] = fit
    return out
