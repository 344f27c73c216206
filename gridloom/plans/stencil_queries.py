"""Gaussian means and local correlation of vectors as lines of 64 samples, and of bricks 4 x 4 x 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import gaussian_kernel, kernel_radius
from gridloom.operators import stencil
from gridloom.plans.registry import query, rounded, table

#: Standard deviation of the line queries.
SIGMA = 2.5

_TAPS = ", ".join(f"({k}, {w!r})" for k, w in zip(range(-7, 8), gaussian_kernel(SIGMA)))
_LINE = f"""taps(step, tap) as (values {_TAPS}),
line as (select vec_id, cast(i - 1 as int) i, cast(embedding[i] as double) v, case when (vec_id + i) % 5 = 0 then 0 else 1 end m from embeddings, (select unnest(range(1, 65)) i)),
places as (select vec_id, cast(p as int) i, tap, case when ((p + step) % 128 + 128) % 128 < 64 then ((p + step) % 128 + 128) % 128 else 127 - ((p + step) % 128 + 128) % 128 end src from (select distinct vec_id from line), (select unnest(range(64)) p), taps)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"), F.size("embedding").alias("n"))
    return rows.withColumns({"v": F.col("v").cast("double"), "m": F.when((F.col("vec_id") + F.col("i") + 1) % 5 == 0, 0).otherwise(1)})


@query(f"""with {_LINE} select a.vec_id, a.i, round(sum(tap * v), 9) v from places a join line l on l.vec_id = a.vec_id and l.i = a.src group by a.vec_id, a.i""")
def gauss_smooth_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.gaussian_line(lines(spark, sf_dir), ["vec_id"], ["v"], SIGMA).select("vec_id", "i", rounded("v"))


@query(f"""with {_LINE}, s as (select a.vec_id, a.i, sum(tap * v * m) v, sum(tap * m) w from places a join line l on l.vec_id = a.vec_id and l.i = a.src group by a.vec_id, a.i)
select s.vec_id, s.i, l.m, round(case when l.m = 1 then s.v / w else 0.0 end, 9) v from s join line l on l.vec_id = s.vec_id and l.i = s.i""")
def masked_gauss_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.masked_gaussian_line(lines(spark, sf_dir), ["vec_id"], ["v"], "m", SIGMA).select("vec_id", "i", "m", rounded("v"))


@query(f"""with {_LINE}, pair as (select a.vec_id, a.i, a.m, a.v x, b.v y from line a join line b on b.vec_id = a.vec_id + 1 and b.i = a.i),
s as (select a.vec_id, a.i, sum(tap * m) w, sum(tap * m * x) x, sum(tap * m * x * x) xx, sum(tap * m * y) y, sum(tap * m * y * y) yy, sum(tap * m * x * y) xy from places a join pair p on p.vec_id = a.vec_id and p.i = a.src group by a.vec_id, a.i),
n as (select s.vec_id, s.i, s.x / w x, s.xx / w xx, s.y / w y, s.yy / w yy, s.xy / w xy from s join pair p on p.vec_id = s.vec_id and p.i = s.i where p.m = 1)
select p.vec_id, p.i, round(case when (xx - n.x * n.x) * (yy - n.y * n.y) > 0 then 1 - (xy - n.x * n.y) / sqrt((xx - n.x * n.x) * (yy - n.y * n.y)) end, 7) distance from pair p left join n on n.vec_id = p.vec_id and n.i = p.i""")
def lncc_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lines(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("v").alias("y"))
    both = a.join(b, ["vec_id", "i"])
    return stencil.lncc_line(both, ["vec_id"], "v", "y", "m", sigma=SIGMA).select("vec_id", "i", rounded("distance", 7))


_T3 = ", ".join(f"({k}, {w!r})" for k, w in zip(range(-3, 4), gaussian_kernel(1.0)))
_BOX = f"""taps(step, tap) as (values {_T3}),
vox as (select vec_id, cast((i - 1) // 16 as int) x, cast((i - 1) // 4 % 4 as int) y, cast((i - 1) % 4 as int) z, cast(embedding[i] as double) v, case when (vec_id + i) % 5 = 0 then 0 else 1 end m from embeddings, (select unnest(range(1, 65)) i)),
r as (select cast(p as int) p, tap, case when ((p + step) % 8 + 8) % 8 < 4 then ((p + step) % 8 + 8) % 8 else 7 - ((p + step) % 8 + 8) % 8 end s from (select unnest(range(4)) p), taps),
k as (select p, s, sum(cast(tap as double)) w from r group by p, s)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as boxes of edge 4, with a mask."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    i, n = F.col("i"), F.lit(4)
    place = [F.floor(i / 16).cast("int").alias("x"), (F.floor(i / 4) % 4).cast("int").alias("y"), (i % 4).cast("int").alias("z")]
    return rows.select("vec_id", *place, n.alias("nx"), n.alias("ny"), n.alias("nz"), F.col("v").cast("double").alias("v"), F.when((F.col("vec_id") + i + 1) % 5 == 0, 0).otherwise(1).alias("m"))


@query(f"""with {_BOX}
select vec_id, a.p x, b.p y, c.p z, round(sum(v * a.w * b.w * c.w), 9) v from vox join k a on a.s = x join k b on b.s = y join k c on c.s = z group by vec_id, a.p, b.p, c.p""")
def gauss_smooth_3d_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bricks of edge 2 with halos, so that the exchange between bricks is used too."""
    assert kernel_radius(1.0) == 3
    return stencil.gaussian_blocks(boxes(spark, sf_dir), ["vec_id"], "v", (1.0, 1.0, 1.0), block=2).select("vec_id", "x", "y", "z", rounded("v"))


@query(f"""with {_BOX},
s as (select vec_id, a.p x, b.p y, c.p z, sum(v * m * a.w * b.w * c.w) v, sum(m * a.w * b.w * c.w) w from vox join k a on a.s = x join k b on b.s = y join k c on c.s = z group by vec_id, a.p, b.p, c.p)
select s.vec_id, s.x, s.y, s.z, round(case when m = 1 then s.v / w else 0.0 end, 9) v from s join vox on vox.vec_id = s.vec_id and vox.x = s.x and vox.y = s.y and vox.z = s.z""")
def masked_gauss_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.gaussian_blocks(boxes(spark, sf_dir), ["vec_id"], "v", (1.0, 1.0, 1.0), "m").select("vec_id", "x", "y", "z", rounded("v"))


@query(f"""with {_BOX}, pair as (select a.*, b.v o from vox a join vox b on b.vec_id = a.vec_id + 1 and b.x = a.x and b.y = a.y and b.z = a.z),
s as (select vec_id, a.p x, b.p y, c.p z, sum(m * a.w * b.w * c.w) w, sum(v * m * a.w * b.w * c.w) i, sum(v * v * m * a.w * b.w * c.w) ii, sum(o * m * a.w * b.w * c.w) a, sum(o * o * m * a.w * b.w * c.w) aa, sum(v * o * m * a.w * b.w * c.w) ia
  from pair join k a on a.s = x join k b on b.s = y join k c on c.s = z group by vec_id, a.p, b.p, c.p),
n as (select s.vec_id, s.x, s.y, s.z, i / w i, ii / w ii, a / w a, aa / w aa, ia / w ia from s join pair p on p.vec_id = s.vec_id and p.x = s.x and p.y = s.y and p.z = s.z where m = 1)
select p.vec_id, p.x, p.y, p.z, round(case when (ii - i * i) * (aa - n.a * n.a) > 0 then 1 - (ia - i * n.a) / sqrt((ii - i * i) * (aa - n.a * n.a)) end, 7) distance
from pair p left join n on n.vec_id = p.vec_id and n.x = p.x and n.y = p.y and n.z = p.z""")
def lncc_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local correlation of each box with the next, by spacing 2 and a sigma of -2; bricks of edge 3."""
    a = boxes(spark, sf_dir)
    both = a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), "x", "y", "z", F.col("v").alias("other")), ["vec_id", "x", "y", "z"])
    return stencil.lncc_blocks(both, ["vec_id"], "v", "other", "m", (-2.0,) * 3, (2.0,) * 3, block=3).select("vec_id", "x", "y", "z", rounded("distance", 7))
