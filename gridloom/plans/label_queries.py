"""Label tables: reconciling, remapping, naming by rules, cleaning a grid of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import int_list
from gridloom.operators import labels, resample
from gridloom.plans.registry import query, rounded, table

_GRID = "grid as (select cast(i % 10 as int) x, cast((i // 10) % 10 as int) y, cast(i // 100 as int) z, label from (select p_partkey i, cast(p_size % 9 as int) label from part))"
_STEPS = "steps as (select a.v dx, b.v dy, c.v dz from (values (-1),(0),(1)) a(v), (values (-1),(0),(1)) b(v), (values (-1),(0),(1)) c(v) where not (a.v = 0 and b.v = 0 and c.v = 0))"
_MODE = f"""{_GRID}, {_STEPS}, met as (select g.x, g.y, g.z, g.label old, n.label, count(*) c from grid g cross join steps s
  join grid n on n.x = g.x + dx and n.y = g.y + dy and n.z = g.z + dz where g.label in (7, 8) and n.label <> g.label group by all),
r as (select *, row_number() over (partition by x, y, z order by c desc, label) rk from met),
fixed as (select x, y, z, old label, case when label in (7, 8) then null else label end new_label from r where rk = 1)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    return part.select((i % 10).cast("int").alias("x"), (F.floor(i / 10) % 10).cast("int").alias("y"), F.floor(i / 100).cast("int").alias("z"), (F.col("p_size") % 9).cast("int").alias("label"))


@query(f"with {_MODE} select g.x, g.y, g.z, g.label, f.new_label from grid g left join fixed f on f.x = g.x and f.y = g.y and f.z = g.z where g.label in (7, 8)")
def neighbour_mode_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.neighbour_mode(grid(spark, sf_dir), [7, 8], strict=False)


@query(f"with {_MODE} select count(*) n_changed from fixed where new_label is not null")
def clean_changed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = grid(spark, sf_dir)
    return labels.changed_count(before, labels.clean_labels(before, [7, 8], strict=False), ["x", "y", "z"])


@query("""with f as (select distinct n_regionkey + 2 k from nation), r as (select r_regionkey k from region)
select k, 'unknown' side from f where k not in (select k from r) union all select k, 'unused' from r where k not in (select k from f)""")
def label_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 2).alias("k"))
    return labels.reconcile(found, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k")), "k")


@query("select distinct unnest([p_size % 3, p_size % 4, 5]) tissue from part")
def tissues_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.lit("["), F.concat_ws(", ", (F.col("p_size") % 3).cast("string"), (F.col("p_size") % 4).cast("string"), F.lit("5")), F.lit("]"))
    return labels.distinct_tissues(table(spark, sf_dir, "part").select(int_list(cell).alias("tissues")))


@query("""with m as (select distinct p_size * 2 original, p_size consecutive from part)
select p_partkey, p_size label, consecutive new_label, consecutive is not null mapped from part left join m on original = p_size""")
def remap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("label"))
    mapping = part.select((F.col("label") * 2).alias("original"), F.col("label").alias("consecutive")).distinct()
    met, missing = labels.remap(part, mapping)
    return met.select("p_partkey", "label", "new_label", F.lit(True).alias("mapped")).union(missing.select("p_partkey", "label", F.lit(None).cast("int"), F.lit(False)))


@query("""with ref as (select replace(p_name, ' ', '') || case when p_partkey % 3 = 0 then '' else '#' end k, min_by([p_size % 6], p_partkey) tissues from part group by 1),
items as (select p_partkey label, case p_partkey % 9 when 1 then 'CSF ' when 2 then 'Left White Matter ' when 4 then 'Unlabeled ' when 5 then 'Vitamin E ' when 7 then 'Basal Forebrain ' when 8 then 'icc ' else '' end || p_name as name, p_partkey % 4 present from part),
j as (select label, name, tissues, present, k from items left join ref on k = replace(name, ' ', ''))
select label, name, cast(case when k is not null then tissues when contains(name, 'Unlabeled') then [0,1,2,3,4,5] when contains(name, 'Vitamin E') then [0] when contains(name, 'White Matter') then [3]
  when contains(name, 'CSF') then [1] when contains(name, 'Basal Forebrain') then [4] else [1] end as varchar) tissues from j where k is not null or present <> 0
union all select 0, 'Background', '[0]'""")
def name_match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    other = F.when(F.col("p_partkey") % 3 == 0, "").otherwise("#")
    reference = part.select(F.col("p_partkey").alias("pos"), F.concat("p_name", other).alias("name"), F.array(F.col("p_size") % 6).alias("tissues"))
    prefix = F.lit("")
    for k, text in ((1, "CSF "), (2, "Left White Matter "), (4, "Unlabeled "), (5, "Vitamin E "), (7, "Basal Forebrain "), (8, "icc ")):
        prefix = F.when(F.col("p_partkey") % 9 == k, text).otherwise(prefix)
    items = part.select(F.lit("all").alias("source"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("label"), F.concat(prefix, "p_name").alias("name"))
    present = part.select(F.lit("all").alias("source"), F.when(F.col("p_partkey") % 4 == 0, -1 - F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("label"))
    out = labels.assign_tissues(items, reference, present)
    return out.withColumn("tissues", F.concat(F.lit("["), F.array_join(F.transform("tissues", lambda x: x.cast("string")), ", "), F.lit("]")))


@query("""with i as (select p_partkey % 4 src, p_partkey pos, case when p_partkey % 4 > 0 and p_partkey >= p_partkey % 4 * 40 and p_partkey % 7 = 0 then 'Lesion ' else 'CSF ' end || p_name as name from part),
s as (select src, min(pos) stop from i where contains(name, 'Lesion') group by src)
select pos as label, name, '[1]' tissues from i left join s using (src) where stop is null or pos < stop union all select 0, 'Background', '[0]'""")
def name_rules_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that ends its source's list: it and what comes after it go, in that source only."""
    part, at = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.concat(F.when((at % 4 > 0) & (at >= at % 4 * 40) & (at % 7 == 0), "Lesion ").otherwise("CSF "), "p_name")
    items = part.select((at % 4).alias("source"), at.alias("pos"), at.alias("label"), name.alias("name"))
    reference = part.select(at.alias("pos"), F.lit("none").alias("name"), F.array(F.lit(0)).alias("tissues")).limit(1)
    out = labels.assign_tissues(items, reference, items.select("source", "label"))
    return out.withColumn("tissues", F.concat(F.lit("["), F.array_join(F.transform("tissues", lambda x: x.cast("string")), ", "), F.lit("]")))


@query("select n_name name from nation union select r_name from region union select 'OTHER'")
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    b = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    return a.unionByName(b).unionByName(spark.createDataFrame([("OTHER",)], "name string")).distinct()


@query("""with d as (select label, row_number() over (order by label) - 1 label_idx from (select distinct p_size label from part))
select p_partkey, label from part join d on label_idx = p_size % 10""")
def index_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    index = labels.label_index(part, "p_size")
    return labels.decode_index(part.select("p_partkey", (F.col("p_size") % 10).alias("label_idx")), index).select("p_partkey", "label")


@query(f"""with {_GRID}, want as (select x, y, z, cast(floor(0.9 * x - 0.2 * y + 1.3 + 0.5) as int) sx, cast(floor(0.1 * x + y + 0.5) as int) sy, cast(floor(z - 1 + 0.5) as int) sz from grid)
select w.x, w.y, w.z, coalesce(g.label, 0) label from want w left join grid g on g.x = sx and g.y = sy and g.z = sz""")
def affine_resample_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return resample.resample_nearest(g, g, [[0.9, -0.2, 0.0, 1.3], [0.1, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, -1.0], [0, 0, 0, 1]])


@query(f"""with {_GRID}, want as (select x, y, z, x + 0.25 u, y + 0.5 v, cast(z as double) w from grid),
c as (select a.v dx, b.v dy from (values (0),(1)) a(v), (values (0),(1)) b(v)),
m as (select q.x, q.y, q.z, cast((case dx when 1 then 0.25 else 0.75 end) * 0.5 as double) weight, g.label from want q cross join c left join grid g on g.x = q.x + dx and g.y = q.y + dy and g.z = q.z)
select x, y, z, round(case when count(*) filter (where label is null) = 0 then sum(weight * label) end, 9) as value from m group by x, y, z""")
def affine_resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).withColumn("value", F.col("label").cast("double"))
    out = resample.resample_linear(g, g, [[1.0, 0.0, 0.0, 0.25], [0.0, 1.0, 0.0, 0.5], [0.0, 0.0, 1.0, 0.0], [0, 0, 0, 1]])
    return out.select("x", "y", "z", rounded("value"))


@query("""select conv_id, count(*) n_turns, string_agg(role, '>' order by turn) roles, sum(case when role = 'user' then 1 else 0 end) n_user from conversations group by conv_id""")
def nested_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(ordered, ">").alias("roles"), F.count_if(F.col("role") == "user").alias("n_user"))


@query("""select i r, j c, cast(v as double) as value from (values (0,0,0.5),(0,1,0.0),(0,2,0.0),(0,3,-0.5),(1,0,0.0),(1,1,1.0),(1,2,0.0),(1,3,2.0),(2,0,0.0),(2,1,0.0),(2,2,4.0),(2,3,0.0),(3,0,0.0),(3,1,0.0),(3,2,0.0),(3,3,1.0)) t(i, j, v)""")
def affine_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = spark.createDataFrame(
        [([[2.0, 0.0, 0.0, 1.0], [0.0, 1.0, 0.0, -2.0], [0.0, 0.0, 0.5, 0.0], [0.0, 0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 2.0, 0.0], [0.0, 0.0, 0.0, 1.0]])],
        "affine array<array<double>>, sform array<array<double>>",
    )
    rows = resample.registered_sforms(meta).select(F.posexplode("registered").alias("r", "row"))
    return rows.select("r", F.posexplode("row").alias("c", "value")).select("r", "c", rounded("value"))
