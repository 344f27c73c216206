"""Overlap scores: subject = supplier mod 42, two label maps of the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import clamp
from gridloom.operators import evaluation, validation
from gridloom.plans.registry import query, rounded, table

_PAIRS = "pairs as (select l_suppkey % 42 subject, cast(l_partkey % 8 as int) pred, cast(case when l_quantity < 30 then l_partkey % 8 else l_orderkey % 8 end as int) truth from lineitem)"
_COUNTS = """c as (select subject, label, sum(m) n_match, sum(p) n_pred, sum(t) n_truth from (
  select subject, pred label, case when pred = truth then 1 else 0 end m, 1 p, 0 t from pairs union all select subject, truth, 0, 0, 1 from pairs) group by subject, label)"""
_SCORES = f"{_PAIRS}, {_COUNTS}, scores as (select subject, label, case when n_pred + n_truth = 0 then 1.0 else 2.0 * n_match / (n_pred + n_truth) end dice from c)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    pred = F.col("l_partkey") % 8
    truth = F.when(F.col("l_quantity") < 30, pred).otherwise(F.col("l_orderkey") % 8)
    return rows.select((F.col("l_suppkey") % 42).alias("subject"), pred.cast("int").alias("pred"), truth.cast("int").alias("truth"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.dice_scores(pairs(spark, sf_dir), ["subject"])


@query(f"""with {_PAIRS}, c as (select label, sum(m) n_match, sum(p) n_pred, sum(t) n_truth from (
  select pred label, case when pred = truth then 1 else 0 end m, 1 p, 0 t from pairs union all select truth, 0, 0, 1 from pairs) group by label)
select label, round(2.0 * n_match / (n_pred + n_truth), 9) dice from c where label <> 0""")
def dice_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.dice_scores(pairs(spark, sf_dir), [], exclude_background=True).select("label", rounded("dice"))


@query(f"with {_SCORES} select subject, label, round(dice, 9) dice from scores")
def dice_by_subject_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("subject", "label", rounded("dice"))


@query(f"with {_SCORES} select subject, round(avg(dice), 9) mean_dice, count(*) n_labels from scores group by subject")
def dice_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.subject_means(scores(spark, sf_dir)).select("subject", rounded("mean_dice"), "n_labels")


_SUMMARY = "count(distinct subject) n_subjects, count(distinct label) n_labels, count(*) n_scores, round(avg(dice), 9) mean_dice"


@query(f"with {_SCORES} select {_SUMMARY}, round(stddev_pop(dice), 9) std_dice from scores")
def dice_summary_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(scores(spark, sf_dir)).withColumns({"mean_dice": rounded("mean_dice"), "std_dice": rounded("std_dice")})


@query(f"with {_SCORES} select {_SUMMARY}, round(stddev_samp(dice), 9) std_dice from scores")
def dice_summary_samp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(scores(spark, sf_dir), population=False).withColumns({"mean_dice": rounded("mean_dice"), "std_dice": rounded("std_dice")})


@query(f"""with {_SCORES}, q as (select label, quantile_cont(dice, 0.25) q1, quantile_cont(dice, 0.5) median, quantile_cont(dice, 0.75) q3 from scores group by label),
j as (select s.label, dice, q1, median, q3, dice >= q1 - 0.8 * (q3 - q1) and dice <= q3 + 0.8 * (q3 - q1) inside from scores s join q on q.label = s.label)
select label, round(q1, 9) q1, round(median, 9) median, round(q3, 9) q3, round(least(min(case when inside then dice end), q1), 9) whisker_low,
  round(greatest(max(case when inside then dice end), q3), 9) whisker_high, count(*) filter (where not inside) n_fliers from j group by label, q1, median, q3""")
def dice_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.box_stats(scores(spark, sf_dir), ["label"])
    return out.select("label", *(rounded(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")), "n_fliers")


@query(f"""with {_SCORES}, names as (select r_regionkey label, r_name name from region)
select subject, s.label, round(dice, 9) dice, coalesce(name, 'label-' || s.label) label_name, s.label || ': ' || coalesce(name, 'label-' || s.label) target_structure, 'fusion on test set' experiment
from scores s left join names on names.label = s.label""")
def score_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("label"), F.col("r_name").alias("name"))
    return evaluation.enrich(scores(spark, sf_dir), names, "fusion on test set").withColumn("dice", rounded("dice"))


@query(f"""with {_SCORES}, n as (select greatest(14.0, least(24.0, 0.18 * count(distinct label))) width from scores)
select subject, label, round(dice, 9) dice, round(cast(width as double), 6) width from scores cross join n order by subject, label limit 10 offset 20""")
def score_head_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    n = s.agg(clamp(0.18 * F.countDistinct("label"), 14.0, 24.0).alias("width"))
    return s.orderBy("subject", "label").offset(20).limit(10).join(F.broadcast(n)).select("subject", "label", rounded("dice"), rounded("width", 6))


@query("""with a as (select s_suppkey * 17 subject, s_nationkey % 3 shape, [s_acctbal, s_suppkey * 17] affine from supplier),
b as (select c_custkey subject, c_nationkey % 3 shape, [c_acctbal, c_custkey] affine from customer)
select a.subject, b.subject is not null has_truth, coalesce(a.shape = b.shape and abs(a.affine[1] - b.affine[1]) <= 1e-8 + 1e-5 * abs(b.affine[1]) and abs(a.affine[2] - b.affine[2]) <= 1e-8 + 1e-5 * abs(b.affine[2]), false) compatible
from a left join b on a.subject = b.subject""")
def pair_join_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(t: str, p: str, key: str, suffix: str, times: int) -> DataFrame:
        subject = F.col(f"{p}_{key}") * times
        affine = F.array(F.col(f"{p}_acctbal"), subject.cast("double"))
        return table(spark, sf_dir, t).select(subject.alias("subject"), (F.col(f"{p}_nationkey") % 3).alias(f"shape{suffix}"), affine.alias(f"affine{suffix}"))

    met, missing = evaluation.matched_pairs(side("supplier", "s", "suppkey", "_a", 17), side("customer", "c", "custkey", "_b", 1))
    ok = evaluation.compatible(F.col("shape_a"), F.col("shape_b"), F.col("affine_a"), F.col("affine_b"))
    return met.select("subject", F.lit(True).alias("has_truth"), ok.alias("compatible")).union(missing.select("subject", F.lit(False), F.lit(False)))


@query("""select 'nations have a region' "check", count(*) violations from nation where n_regionkey not in (select r_regionkey from region)
union all select 'regions are 0..n-1', case when min(r_regionkey) = 0 and max(r_regionkey) = count(distinct r_regionkey) - 1 then 0 else 1 end from region
union all select 'discounts in range', count(*) from lineitem where not coalesce(l_discount between 0 and 1, false)
union all select 'five regions', abs(count(*) - 5) from region
union all select 'parts exist', case when count(*) > 0 then 0 else 1 end from part
union all select 'orders have a customer', count(distinct o_custkey) from orders where o_custkey not in (select c_custkey from customer)""")
def validation_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    checks = [
        validation.refers("nations have a region", nation.withColumnRenamed("n_regionkey", "r_regionkey"), region, "r_regionkey"),
        validation.dense_from_zero("regions are 0..n-1", region, "r_regionkey"),
        validation.holds("discounts in range", table(spark, sf_dir, "lineitem"), F.col("l_discount").between(0, 1)),
        validation.has_count("five regions", region, 5),
        validation.not_empty("parts exist", table(spark, sf_dir, "part")),
        validation.refers("orders have a customer", orders, table(spark, sf_dir, "customer"), "c_custkey"),
    ]
    return validation.all_of(checks)
