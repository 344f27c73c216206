"""Vote, prior and class maps: voxel = order, source = line number, label = part key mod 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import distance_to_weight
from gridloom.operators import fusion
from gridloom.plans.registry import query, rounded, table

#: Classes of each label in the queries.
STRUCTURES = {0: [0], 1: [1], 2: [2], 3: [3], 4: [4], 5: [1, 2], 6: [3, 4]}

_VOTES = "votes as (select l_orderkey voxel, cast(l_partkey % 7 as int) label, exp(-(l_discount * 10) / cast(0.15 as double)) w from lineitem)"
_BRIDGE = "bridge(label, tissue, n) as (values (0,0,1),(1,1,1),(2,2,1),(3,3,1),(4,4,1),(5,1,2),(5,2,2),(6,3,2),(6,4,2))"
_VOTE = """s as (select voxel, label, sum(w) p from votes group by voxel, label),
t as (select voxel, max(label) most, sum(p) total from s group by voxel),
p as (select s.voxel, label, case when most = 0 then 1.0 else p end p from s join t using (voxel) where not (most > 0 and total = 0 and label = 0)
  union all select voxel, 0, 1.0 from t where most > 0 and total = 0)"""
_PRIOR = """q0 as (select voxel, tissue, sum(p / n) q from p join bridge using (label) group by voxel, tissue),
q1 as (select voxel, tissue, q from q0 where not (voxel % 5 = 0 and tissue = 0) union all select distinct voxel, 0, 1.0 from p where voxel % 5 = 0),
v as (select distinct voxel from p),
q2 as (select voxel, tissue, q from q1 union all select voxel, 0, 1.0 from v where voxel not in (select voxel from q1 group by voxel having sum(q) > 0)),
q3 as (select voxel, tissue, q / sum(q) over (partition by voxel) q from q2),
q4 as (select * from q3 where q >= 0.01),
q5 as (select * from q4 union all select voxel, 0, 1.0 from v where voxel not in (select voxel from q4)),
q as (select voxel, tissue, q / sum(q) over (partition by voxel) q from q5)"""


def structures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STRUCTURES.items()), "label int, tissues array<int>")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("voxel"), (F.col("l_partkey") % 7).cast("int").alias("label"), distance_to_weight(F.col("l_discount") * 10).alias("weight"))


def proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.weighted_vote(votes(spark, sf_dir), ["voxel"])


def prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = proba(spark, sf_dir).withColumn("mask", F.when(F.col("voxel") % 5 == 0, 0).otherwise(1))
    return fusion.tissue_prior(p, structures(spark), ["voxel"], mask="mask")


@query(f"""with {_VOTES}, {_VOTE},
r as (select *, row_number() over (partition by voxel order by p desc, label) rk from p)
select voxel, label, round(p, 9) proba from r where rk = 1""")
def weighted_vote_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.top_label(proba(spark, sf_dir), ["voxel"]).select("voxel", "label", rounded(F.col("p")).alias("proba"))


@query(f"""with {_VOTES}, {_VOTE},
r as (select *, row_number() over (partition by voxel order by p desc, label) rk from p)
select voxel, label, round(p, 9) p, cast(rk as int) as "rank" from r where rk <= 3""")
def ranked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.ranked_labels(proba(spark, sf_dir), ["voxel"], 3).select("voxel", "label", rounded("p"), "rank")


@query(f"""with votes as (select l_orderkey voxel, cast(case when l_quantity < 20 then 0 else l_partkey % 7 end as int) label,
  case when l_discount > 0.03 then 0.0 else exp(-(l_discount * 10) / cast(0.15 as double)) end w from lineitem), {_VOTE}
select voxel, label, round(p, 9) p from p""")
def vote_any_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_quantity") < 20, 0).otherwise(F.col("l_partkey") % 7).cast("int")
    weight = F.when(F.col("l_discount") > 0.03, float("nan")).otherwise(distance_to_weight(F.col("l_discount") * 10))
    v = rows.select(F.col("l_orderkey").alias("voxel"), label.alias("label"), weight.alias("weight"))
    return fusion.weighted_vote(v, ["voxel"]).select("voxel", "label", rounded("p"))


@query(f"with {_VOTES}, {_BRIDGE}, {_VOTE}, {_PRIOR} select voxel, cast(tissue as int) tissue, round(q, 9) q from q where q > 0")
def tissue_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prior(spark, sf_dir).select("voxel", "tissue", rounded("q"))


@query(f"""with {_VOTES}, {_BRIDGE}, {_VOTE},
c as (select voxel, p.label, row_number() over (partition by voxel order by p desc, p.label) rk from p join bridge b on b.label = p.label and b.tissue = voxel % 6),
least as (select tissue, min(label) label from bridge group by tissue)
select v.voxel, cast(v.voxel % 6 as int) tissue, cast(coalesce(c.label, least.label, 0) as int) label
from (select distinct voxel from votes) v left join c on c.voxel = v.voxel and rk = 1 left join least on least.tissue = v.voxel % 6""")
def constrained_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes(spark, sf_dir)
    p = fusion.weighted_vote(v, ["voxel"])
    tissues = v.select("voxel").distinct().withColumn("tissue", (F.col("voxel") % 6).cast("int"))
    return fusion.constrained_top(p, tissues, structures(spark), ["voxel"])


@query(f"""with {_VOTES}, {_BRIDGE}, {_VOTE}, {_PRIOR},
m as (select voxel, tissue, row_number() over (partition by voxel order by round(q, 9) desc, tissue) rk, max(case when tissue = 0 and q = 1 then 1 else 0 end) over (partition by voxel) sure from q)
select voxel, cast(case when sure = 1 or voxel % 16 in (0, 15) or (voxel // 16) % 16 in (0, 15) or (voxel // 256) % 16 in (0, 15) then 0 else tissue end as int) tissue
from m where rk = 1""")
def border_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = prior(spark, sf_dir)
    posterior = q.select("voxel", "tissue", F.round("q", 9).alias("q"), F.col("q").alias("prior"))
    at = [F.floor(F.col("voxel") / d) % 16 for d in (1, 16, 256)]
    side = F.lit(16)
    return fusion.tissue_map(posterior, ["voxel"], fusion.on_border(*at, side, side, side))


@query(f"""with {_VOTES}, {_BRIDGE}, {_VOTE}, {_PRIOR}
select cast(tissue as int) tissue, count(*) n, round(sum(q), 6) mass from q where q > 0 group by tissue""")
def tissue_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prior(spark, sf_dir).groupBy("tissue").agg(F.count("*").alias("n"), rounded(F.sum("q"), 6).alias("mass"))


@query("""with w as (select l_orderkey, l_linenumber, l_partkey, case when l_tax > 0.07 then null else l_discount * 10 end d from lineitem)
select l_orderkey, l_linenumber, l_partkey, round(coalesce(exp(-d / cast(0.15 as double)), 0.0), 9) weight, count(*) n from w group by all""")
def distance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    d = F.when(F.col("l_tax") > 0.07, float("nan")).otherwise(F.col("l_discount") * 10)
    out = rows.select("l_orderkey", "l_linenumber", "l_partkey", rounded(distance_to_weight(d)).alias("weight"))
    return out.groupBy("l_orderkey", "l_linenumber", "l_partkey", "weight").agg(F.count("*").alias("n"))


def tissue_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of events by their value, from even priors."""
    from gridloom.operators.em import tissue_em as em

    events = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("intensity"))
    classes = F.array(*(F.struct(F.lit(t).alias("tissue"), F.lit(p).alias("q")) for t, p in ((0, 0.5), (1, 0.3), (2, 0.2))))
    # priors that lean towards a class by the value's rank break the symmetry between classes
    cuts = events.agg(F.percentile_approx("intensity", [0.5, 0.8], 10000).alias("c"))
    lean = events.join(F.broadcast(cuts)).select("event_id", F.when(F.col("intensity") <= F.col("c")[0], 0).when(F.col("intensity") <= F.col("c")[1], 1).otherwise(2).alias("lean"), F.inline(classes))
    priors = lean.select("event_id", "tissue", ((F.col("q") + F.when(F.col("tissue") == F.col("lean"), 1.0).otherwise(0.0)) / 2.0).alias("q"))
    out = em(events, priors, ["event_id"], max_iterations=8)
    return fusion.top_label(out, ["event_id"], "tissue", "q").select("event_id", "tissue", rounded("q", 4))


query()(tissue_em)


@query("""with e as (select event_id, event_id % 3 subject, value x, case when event_id % 7 = 0 then 0 else 1 end inside from events),
p as (select event_id, subject, x, inside, t tissue, (case when event_id % 3 = t or (x > 50 and t = 2) then 3.0 else 1.0 end) / 10 prior from e, (select unnest([0, 1, 2]) t)),
m as (select subject, tissue, sum(prior * x) / sum(prior) mean, sum(prior * x * x) / sum(prior) square from p where inside = 1 group by subject, tissue),
g as (select event_id, p.tissue, prior, ln(prior) - 0.5 * ln(greatest(square - mean * mean, 1e-6)) - (x - mean) * (x - mean) / (2 * greatest(square - mean * mean, 1e-6)) g
  from p join m on m.subject = p.subject and m.tissue = p.tissue where inside = 1),
u as (select event_id, tissue, prior, exp(g - max(g) over (partition by event_id)) u from g)
select event_id, cast(tissue as int) tissue, round(u / sum(u) over (partition by event_id), 6) q, prior from u
union all select event_id, 0, 1.0, prior from p where inside = 0 and tissue = 0""")
def tissue_em_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round for three subjects with a mask: means and variances from the priors, then posteriors."""
    from gridloom.operators.em import tissue_em as em

    events = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).alias("subject"), F.col("value").alias("intensity"), F.when(F.col("event_id") % 7 == 0, 0).otherwise(1).alias("mask"))
    lean = lambda t: F.when((F.col("subject") == t) | ((F.col("intensity") > 50) & F.lit(t == 2)), 3.0).otherwise(1.0) / 10
    priors = events.select("event_id", "subject", F.inline(F.array(*(F.struct(F.lit(t).alias("tissue"), lean(t).alias("q")) for t in range(3)))))
    out = em(events, priors, ["event_id", "subject"], max_iterations=1, mask="mask", by=["subject"])
    return out.select("event_id", "tissue", rounded("q", 6), "prior")
