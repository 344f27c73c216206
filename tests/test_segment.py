import numpy as np
import pytest

from gridloom.operators import em
from gridloom.plans import segment


def test_em_separates_two_classes(spark):
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 2, 200)
    x = np.where(truth == 1, 5.0, 0.0) + rng.normal(0, 0.5, 200)
    v = spark.createDataFrame([(i, float(a)) for i, a in enumerate(x)], "i int, intensity double")
    p = spark.createDataFrame([(i, t, 0.6 if t == (a > 3.5) else 0.4) for i, a in enumerate(x) for t in (0, 1)], "i int, tissue int, q double")
    q = em.tissue_em(v, p, ["i"], max_iterations=6)
    best = {r["i"]: r["tissue"] for r in q.where("q > 0.5").collect()}
    assert np.mean([best[i] == t for i, t in enumerate(truth)]) > 0.98


def subject(name, shift, rng, n=8):
    truth = (np.indices((n, n, n)).sum(0) % n < 4).astype(int)
    x = truth * 5.0 + shift + rng.normal(0, 0.5, truth.shape)
    at = list(np.ndindex(truth.shape))
    voxels = [(name, *p, float(x[p]), 0 if p[0] == 0 else 1) for p in at]
    return truth, voxels, [(name, *p, t, 0.7 if t == (x[p] - shift > 2.5) else 0.3) for p in at for t in (0, 1)]


@pytest.mark.parametrize("bias", [0, 1])
def test_em_of_two_subjects_equals_each_alone(spark, bias):
    rng = np.random.default_rng(3)
    a, b = subject("a", 0.0, rng), subject("b", 30.0, rng)

    def run(*subjects):
        v = spark.createDataFrame([x for s in subjects for x in s[1]], "subject string, x int, y int, z int, intensity double, mask int")
        p = spark.createDataFrame([x for s in subjects for x in s[2]], "subject string, x int, y int, z int, tissue int, q double")
        out = em.tissue_em(v, p, ["subject", "x", "y", "z"], max_iterations=5, bias_order=bias, coords=("x", "y", "z"), mask="mask")
        return {tuple(r[c] for c in ("subject", "x", "y", "z", "tissue")): r["q"] for r in out.collect()}

    both = run(a, b)
    alone = run(a) | run(b)
    assert both.keys() == alone.keys() and all(both[k] == pytest.approx(alone[k], abs=1e-9) for k in both)
    for name, (truth, _, _) in (("a", a), ("b", b)):
        assert np.mean([(both[name, *p, 1] > 0.5) == truth[p] for p in np.ndindex(truth.shape) if p[0]]) > 0.98
        assert all(both[name, 0, y, z, 0] == 1 and (name, 0, y, z, 1) not in both for y in range(8) for z in range(8))


def test_em_without_rows(spark):
    v = spark.createDataFrame([], "subject string, x int, y int, z int, intensity double")
    p = spark.createDataFrame([], "subject string, x int, y int, z int, tissue int, q double")
    assert em.tissue_em(v, p, ["subject", "x", "y", "z"], coords=("x", "y", "z")).count() == 0


def test_whole_flow_on_a_small_cohort(spark):
    rng = np.random.default_rng(2)
    n = 8
    truth = np.zeros((n, n, n), int)
    truth[2:6, 2:6, 2:6] = 1
    truth[2:6, 2:6, 4:6] = 2
    image = np.choose(truth, [0.0, 4.0, 8.0]) + rng.normal(0, 0.1, truth.shape)
    at = list(np.ndindex(truth.shape))
    targets = spark.createDataFrame([("s", *p, n, n, n, float(image[p]), 1) for p in at], "subject string, x int, y int, z int, nx int, ny int, nz int, intensity double, mask int")
    rows = []
    for k in range(3):
        noise = rng.random(truth.shape) < 0.1
        label = np.where(noise, rng.integers(0, 3, truth.shape), truth)
        rows += [("s", f"a{k}", *p, float(image[p] + rng.normal(0, 0.1)), int(label[p])) for p in at]
    sources = spark.createDataFrame(rows, "subject string, source string, x int, y int, z int, intensity double, label int")
    structures = spark.createDataFrame([(0, [0]), (1, [1]), (2, [2])], "label int, tissues array<int>")
    tissues = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "label int, name string")
    options = segment.Options(lncc_sigma=-1.0, em_iterations=3, bias_order=1, block=5)
    result = segment.segment(targets, sources, structures, tissues, options=options)
    expected = spark.createDataFrame([("s", *p, int(truth[p])) for p in at], "subject string, x int, y int, z int, label int")
    scores, means, total = segment.evaluate(result.parcellation, expected)
    assert scores.count() == 2 and total.first()["mean_dice"] > 0.9
    assert result.prior.groupBy("x", "y", "z").sum("q").where("abs(`sum(q)` - 1) > 1e-9").isEmpty()
