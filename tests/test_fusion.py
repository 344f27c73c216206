"""Vote, prior, class map and constrained choice on small cases worked out by hand."""

import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gridloom.operators import fusion
from gridloom.plans import registry


def vote(spark, votes):
    df = spark.createDataFrame(votes, "v int, label int, weight double")
    return {(r["v"], r["label"]): r["p"] for r in fusion.weighted_vote(df, ["v"]).collect()}


def test_vote_sums_weights_and_falls_back_to_background(spark):
    got = vote(
        spark,
        [(1, 5, 0.2), (1, 7, 0.5), (1, 5, 0.4), (2, 0, 0.2), (2, 0, 0.3), (3, 0, 0.9), (3, 5, 0.0), (4, 5, 0.0), (4, 5, 0.0), (5, 5, float("nan")), (5, 6, None)],
    )
    expected = {(1, 5): 0.6, (1, 7): 0.5, (2, 0): 1.0, (3, 0): 0.9, (3, 5): 0.0, (4, 0): 1.0, (4, 5): 0.0, (5, 0): 1.0, (5, 5): 0.0, (5, 6): 0.0}
    assert got == pytest.approx(expected)


def test_vote_is_independent_of_order(spark):
    rng = random.Random(1)
    votes = [(rng.randrange(5), rng.randrange(4), rng.random()) for _ in range(60)]
    a, b = vote(spark, votes), vote(spark, votes[::-1])
    assert a == pytest.approx(b)


def test_ties_go_to_the_smaller_label(spark):
    df = spark.createDataFrame([(1, 7, 0.5), (1, 5, 0.5), (1, 9, 0.1)], "v int, label int, p double")
    assert [tuple(r) for r in fusion.top_label(df, ["v"]).collect()] == [(1, 5, 0.5)]


def test_the_same_weights_in_another_order_tie(spark):
    # 0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1 in floating point
    votes = spark.createDataFrame([(1, 5, w) for w in (0.3, 0.2, 0.1)] + [(1, 7, w) for w in (0.1, 0.2, 0.3)], "v int, label int, weight double").coalesce(1)
    p = fusion.weighted_vote(votes, ["v"])
    assert [(r["label"], r["rank"]) for r in fusion.ranked_labels(p, ["v"], 3).orderBy("rank").collect()] == [(5, 1), (7, 2)]


def test_the_top_of_the_same_weights_is_the_smaller_label(spark):
    votes = spark.createDataFrame([(1, 5, w) for w in (0.3, 0.2, 0.1)] + [(1, 7, w) for w in (0.1, 0.2, 0.3)], "v int, label int, weight double").coalesce(1)
    assert fusion.top_label(fusion.weighted_vote(votes, ["v"]), ["v"]).first()["label"] == 5


def test_the_query_on_repeated_keys_is_that_of_exact_sums(spark, tmp_path):
    # each copy of an order's lines shifts their labels by one, so that many labels get the same weights in different orders
    rng = random.Random(3)
    lines = [(order, rng.randrange(700), rng.randrange(11) / 100) for order in range(300) for _ in range(4)]
    lines = [(order, part + 701 * copy, d) for copy in range(6) for order, part, d in lines]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_discount double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    sums = {}
    for order, part, d in lines:
        own = sums.setdefault(order, {})
        own[part % 7] = own.get(part % 7, 0) + Fraction(math.exp(-(d * 10) / 0.15))
    expected = {order: min(own, key=lambda label: (-own[label], label)) for order, own in sums.items()}
    assert {r["voxel"]: r["label"] for r in registry.QUERIES["weighted_vote_argmax"](spark, str(tmp_path)).collect()} == expected


def prior(spark, rows, structures, mask=None, **kw):
    df = spark.createDataFrame([(1, label, p, mask) for label, p in rows], "v int, label int, p double, mask int")
    s = spark.createDataFrame(structures, "label int, tissues array<int>")
    return {r["tissue"]: r["q"] for r in fusion.tissue_prior(df, s, ["v"], mask="mask", **kw).collect()}


def test_prior_deals_mass_and_cuts_small_shares(spark):
    structures = [(4, [1]), (8, [3, 4]), (0, [0])]
    assert prior(spark, [(4, 0.6), (8, 0.3), (0, 0.005)], structures) == pytest.approx({1: 2 / 3, 3: 1 / 6, 4: 1 / 6})


def test_mask_sets_background_beside_the_others(spark):
    got = prior(spark, [(4, 0.6), (8, 0.3)], [(4, [1]), (8, [3, 4])], mask=0)
    assert got == pytest.approx({0: 1 / 1.9, 1: 0.6 / 1.9, 3: 0.15 / 1.9, 4: 0.15 / 1.9})
    assert prior(spark, [(4, 0.6)], [(4, [1])], mask=0, mask_hard=True) == {0: 1.0}


def test_prior_of_unknown_labels_is_background(spark):
    assert prior(spark, [(9, 0.6)], [(4, [1])]) == {0: 1.0}


def test_prior_sums_to_one(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(v, label, rng.random()) for v in range(30) for label in rng.sample(range(8), 4)], "v int, label int, p double")
    s = spark.createDataFrame([(i, sorted(rng.sample(range(5), 1 + i % 3))) for i in range(7)], "label int, tissues array<int>")
    sums = fusion.tissue_prior(df, s, ["v"]).groupBy("v").agg(F.sum("q").alias("q")).collect()
    assert len(sums) == 30 and all(abs(r["q"] - 1) < 1e-12 for r in sums)


FIXED = [(1, (0.4, 0.3, 0.3), 1), (2, (0.4, 0.3, 0.3), 1), (3, (0.2, 0.5, 0.3), 1), (3, (0.2, 0.5, 0.3), 1), (0, (0.6, 0.2, 0.2), 0), (2, (0.6, 0.2, 0.2), 1), (3, (0.4, 0.1, 0.5), 2), (3, (0.4, 0.1, 0.5), 2)]


def constrained(spark, voxels, structures, **kw):
    proba = spark.createDataFrame([(v, label, p) for v, (_, ps) in enumerate(voxels) for label, p in enumerate(ps)], "v int, label int, p double")
    tissues = spark.createDataFrame([(v, t) for v, (t, _) in enumerate(voxels)], "v int, tissue int")
    s = spark.createDataFrame(structures, "label int, tissues array<int>")
    return {r["v"]: r["label"] for r in fusion.constrained_top(proba, tissues, s, ["v"], **kw).collect()}


def test_constrained_choice_on_the_fixed_case(spark):
    got = constrained(spark, [(t, ps) for t, ps, _ in FIXED], [(0, [0]), (1, [1, 2, 3]), (2, [3])])
    assert got == {v: label for v, (_, _, label) in enumerate(FIXED)}


def test_constrained_choice_without_a_fit_is_background(spark):
    assert constrained(spark, [(7, (0.5, 0.5))], [(0, [0]), (1, [1])]) == {0: 0}


def test_a_label_without_mass_may_win_unless_asked_otherwise(spark):
    voxels, structures = [(2, (0.9, 0.0))], [(0, [0]), (1, [2])]
    assert constrained(spark, voxels, structures) == {0: 1}
    assert constrained(spark, voxels, structures, require_positive=True) == {0: 0}


def test_search_may_stop_at_a_label_without_structure(spark):
    assert constrained(spark, [(1, (0.2, 0.5, 0.3))], [(0, [0]), (2, [1])], stop_at_unknown=True) == {0: 0}
    assert constrained(spark, [(1, (0.2, 0.1, 0.3))], [(0, [0]), (2, [1])], stop_at_unknown=True) == {0: 2}


def test_constrained_choice_against_a_loop(spark):
    rng = random.Random(3)
    structures = [(label, sorted(rng.sample(range(7), rng.randrange(1, 4)))) for label in range(12)]
    voxels = [(rng.randrange(7), tuple(rng.random() for _ in range(12))) for _ in range(80)]
    expected = {}
    for v, (tissue, ps) in enumerate(voxels):
        fits = [label for label in sorted(range(12), key=lambda i: -ps[i]) if tissue in dict(structures)[label]]
        expected[v] = fits[0] if fits else 0
    assert constrained(spark, voxels, structures) == expected


def test_faces_and_certain_voxels_become_background(spark):
    points = list(itertools.product(range(3), repeat=3))
    schema = "x int, y int, z int, tissue int, q double, prior double"
    q = spark.createDataFrame([(*p, 1, 1.0, 1.0) for p in points], schema)
    n = F.lit(3)
    got = fusion.tissue_map(q, ["x", "y", "z"], fusion.on_border(F.col("x"), F.col("y"), F.col("z"), n, n, n)).collect()
    assert {(r["x"], r["y"], r["z"]): r["tissue"] for r in got} == {p: int(p == (1, 1, 1)) for p in points}
    sure = q.union(spark.createDataFrame([(1, 1, 1, 0, 0.0, 1.0)], schema))
    got = fusion.tissue_map(sure, ["x", "y", "z"], F.lit(False)).where("tissue = 0").collect()
    assert [(r["x"], r["y"], r["z"]) for r in got] == [(1, 1, 1)]
