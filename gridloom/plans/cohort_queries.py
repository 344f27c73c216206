"""Cohorts: who serves whom, what is left to do, natural order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import base_name, join_path
from gridloom.operators import cohort
from gridloom.plans.registry import query, table


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))


@query("select a.n_name target, b.n_name as name from nation a join nation b on a.n_name <> b.n_name")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.leave_one_out(names(spark, sf_dir))


@query("""with r as (select *, row_number() over (order by cast(regexp_extract(n_name, '[0-9]+') as int)) - 1 pos from (select n_name from nation))
select a.n_name target, b.n_name as name from r a cross join r b where a.pos in (0, 3, 7) and b.pos not in (0, 3, 7)""")
def leave_specified_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cohort.at_positions(names(spark, sf_dir), [0, 3, 7])
    return cohort.leave_specified_out(names(spark, sf_dir), out)


@query("""with t as (select r_name target from region order by r_name limit 3), w as (select target, n_name as name from t cross join nation),
done as (select r_name target, n_name as name from nation join region on n_regionkey = r_regionkey)
select w.target, w.name from w left join done d on d.target = w.target and d.name = w.name where d.name is null""")
def cohort_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("target"), "r_regionkey")
    work = cohort.every_source(region, names(spark, sf_dir), limit=3)
    done = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("target", F.col("n_name").alias("name"))
    return cohort.unfinished(work, done, ["target", "name"])


@query("""with n as (select 'atlas-' || (s_suppkey % 13) || '-' || s_suppkey as name, s_suppkey % 13 a, s_suppkey b from supplier)
select name, row_number() over (order by a, b) - 1 as "position" from n""")
def natural_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("atlas-"), (F.col("s_suppkey") % 13).cast("string"), F.lit("-"), F.col("s_suppkey").cast("string"))
    return cohort.natural_rank(supplier.select(name.alias("name")))


@query("""with a as (select c_name, row_number() over (order by c_custkey) - 1 pos from customer), b as (select c_custkey, row_number() over (order by c_custkey) - 1 pos from customer)
select pos as "position", '/data/' || c_name || '/image.nii.gz' image, '/data/seg-' || c_custkey || '/labels.nii.gz' seg, 'image.nii.gz' base from a join b using (pos)""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    both = cohort.zip_by_position(customer.select("c_name"), customer.select(F.concat(F.lit("seg-"), F.col("c_custkey").cast("string")).alias("seg_name")), "c_name", "seg_name")
    image = join_path(F.lit("/data"), F.col("c_name"), F.lit("image.nii.gz"))
    return both.select("position", image.alias("image"), join_path(F.lit("/data"), F.col("seg_name"), F.lit("labels.nii.gz")).alias("seg"), base_name(image).alias("base"))


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return cohort.unfinished(work, done, ["o_orderkey"])
