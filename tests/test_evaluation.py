import pytest
from pyspark.sql import functions as F

from gridloom.operators import evaluation, validation

PRED, TRUTH = [0, 0, 1, 1, 2, 2], [0, 1, 1, 1, 2, 3]


@pytest.fixture(scope="module")
def scores(spark):
    pairs = spark.createDataFrame([("s", p, t) for p, t in zip(PRED, TRUTH)], "subject string, pred int, truth int")
    return evaluation.dice_scores(pairs, ["subject"]).cache()


def test_dice_of_each_label(scores):
    assert {r["label"]: r["dice"] for r in scores.collect()} == pytest.approx({0: 2 / 3, 1: 0.8, 2: 2 / 3, 3: 0.0})


def test_dice_is_symmetric_and_one_on_equal_maps(spark, scores):
    back = spark.createDataFrame([("s", t, p) for p, t in zip(PRED, TRUTH)], "subject string, pred int, truth int")
    assert {tuple(r) for r in evaluation.dice_scores(back, ["subject"]).collect()} == {tuple(r) for r in scores.collect()}
    same = spark.createDataFrame([("s", t, t) for t in TRUTH], "subject string, pred int, truth int")
    assert {r["dice"] for r in evaluation.dice_scores(same, ["subject"]).collect()} == {1.0}


def test_background_may_be_left_out(spark):
    pairs = spark.createDataFrame([(p, t) for p, t in zip(PRED, TRUTH)], "pred int, truth int")
    assert {r["label"] for r in evaluation.dice_scores(pairs, [], exclude_background=True).collect()} == {1, 2, 3}


def test_both_standard_deviations(scores):
    pop, samp = evaluation.summary(scores).first(), evaluation.summary(scores, population=False).first()
    assert (pop["mean_dice"], pop["std_dice"], samp["std_dice"]) == pytest.approx((0.533333, 0.312694, 0.361068), abs=1e-6)
    assert (pop["n_subjects"], pop["n_labels"], pop["n_scores"]) == (1, 4, 4)


def test_box_statistics(spark):
    df = spark.createDataFrame([(1, x) for x in [0.0, 0.1, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]], "k int, dice double")
    r = evaluation.box_stats(df, ["k"]).first()
    assert tuple(r)[1:] == pytest.approx((0.4, 0.65, 0.825, 0.1, 1.0, 1))


def test_names_have_a_default(spark, scores):
    names = spark.createDataFrame([(1, "one")], "label int, name string")
    got = {r["label"]: r["target_structure"] for r in evaluation.enrich(scores, names, "e").collect()}
    assert got[1] == "1: one" and got[2] == "2: label-2"


def test_compatibility_needs_shape_and_affine(spark):
    rows = [([2, 2], [2, 2], [1.0, 2.0], [1.0, 2.00001]), ([2, 2], [2, 3], [1.0], [1.0]), ([2], [2], [1.0], [1.1]), ([2], [2], [1.0], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, c array<double>, d array<double>")
    assert [r[0] for r in df.select(evaluation.compatible(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [True, False, False, False]


def test_failed_checks_raise_by_name(spark):
    df = spark.createDataFrame([(1,), (None,)], "k int")
    checks = validation.all_of([validation.holds("k there", df, F.col("k") > 0), validation.has_count("two", df, 2), validation.not_empty("some", df), validation.dense_from_zero("dense", df.where("k is not null"), "k")])
    assert {r["check"]: r["violations"] for r in checks.collect()} == {"k there": 1, "two": 0, "some": 0, "dense": 1}
    with pytest.raises(ValueError, match="dense.*k there"):
        validation.require(checks)
