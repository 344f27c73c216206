"""Overlap of predicted and true labels, and the statistics made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import all_close, dice, label_name


def label_counts(pairs: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    """For each label in either map: n_match, n_pred and n_truth. One pass, aggregated before the shuffle."""
    same = F.col(pred) == F.col(truth)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    entry = lambda label, m, p, t: F.struct(label.alias("label"), m.alias("m"), p.alias("p"), t.alias("t"))
    entries = F.when(same, F.array(entry(F.col(pred), one, one, one))).otherwise(F.array(entry(F.col(pred), none, one, none), entry(F.col(truth), none, none, one)))
    rows = pairs.select(*keys, F.inline(entries)).where(F.col("label").isNotNull())
    return rows.groupBy(*keys, "label").agg(F.sum("m").alias("n_match"), F.sum("p").alias("n_pred"), F.sum("t").alias("n_truth"))


def dice_scores(pairs: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth", exclude_background: bool = False) -> DataFrame:
    """Dice of each label, for each value of the keys."""
    counts = label_counts(pairs, keys, pred, truth)
    if exclude_background:
        counts = counts.where(F.col("label") != 0)
    return counts.select(*keys, "label", dice(F.col("n_match"), F.col("n_pred"), F.col("n_truth")).alias("dice"))


def subject_means(scores: DataFrame, subject: str = "subject") -> DataFrame:
    return scores.groupBy(subject).agg(F.avg("dice").alias("mean_dice"), F.count("*").alias("n_labels"))


def summary(scores: DataFrame, subject: str = "subject", population: bool = True) -> DataFrame:
    """One row: numbers of subjects, labels and scores, mean and standard deviation."""
    spread = F.stddev_pop("dice") if population else F.stddev_samp("dice")
    return scores.agg(F.countDistinct(subject).alias("n_subjects"), F.countDistinct("label").alias("n_labels"), F.count("*").alias("n_scores"), F.avg("dice").alias("mean_dice"), spread.alias("std_dice"))


def box_stats(scores: DataFrame, keys: list[str], value: str = "dice", whis: float = 0.8) -> DataFrame:
    """Quartiles, whiskers at the outermost values within whis times their range, and the number beyond."""
    q = scores.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    joined = scores.join(q, keys)
    reach = F.lit(whis) * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    kept = F.when(inside, F.col(value))
    out = joined.groupBy(*keys, "q1", "median", "q3").agg(F.min(kept).alias("whisker_low"), F.max(kept).alias("whisker_high"), F.count_if(~inside).alias("n_fliers"))
    return out.select(*keys, "q1", "median", "q3", F.least("whisker_low", "q1").alias("whisker_low"), F.greatest("whisker_high", "q3").alias("whisker_high"), "n_fliers")


def enrich(scores: DataFrame, names: DataFrame, experiment: str) -> DataFrame:
    """Display name of each label (a default where none is known), 'label: name' and the experiment's name."""
    joined = scores.join(names.select("label", "name"), "label", "left")
    name = label_name(F.col("label"), F.col("name"))
    return joined.select(*scores.columns, name.alias("label_name"), F.concat(F.col("label").cast("string"), F.lit(": "), name).alias("target_structure"), F.lit(experiment).alias("experiment"))


def matched_pairs(predictions: DataFrame, truths: DataFrame, on: str = "subject") -> tuple[DataFrame, DataFrame]:
    """Predictions with their truth, and those without any."""
    return predictions.join(truths, on), predictions.join(truths.select(on), on, "left_anti")


def compatible(shape_a: Column, shape_b: Column, affine_a: Column, affine_b: Column) -> Column:
    """Whether two volumes have the same shape and, within tolerance, the same affine."""
    return (shape_a == shape_b) & all_close(affine_a, affine_b)
