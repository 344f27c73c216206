"""Fusing labels of several sources into one: vote, prior, class map, constrained choice.

Votes are rows (voxel keys, label, weight); all other tables are sparse too. One
shuffle by the voxel keys serves vote, prior and choice, as each of them keeps
or narrows that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import PRIOR_THRESHOLD, safe_ratio

#: The class that stands for background, first in every order.
BACKGROUND = 0


#: Rows up to which a table of labels is broadcast: labels are 16-bit in the volumes that they come from.
DIMENSION_ROWS = 1 << 16


def dimension(df: DataFrame, rows: int = DIMENSION_ROWS) -> DataFrame:
    """A table of labels or classes, marked for broadcast if a count finds it within bounds; else Spark chooses."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def weighted_vote(votes: DataFrame, keys: list[str], label: str = "label", weight: str = "weight", out: str = "p") -> DataFrame:
    """Sum of weights for each voxel and label, not normalised.

    A voxel where every source says background, or where all weights sum to
    zero, gets background with 1 instead. NaN and null weights count as 0.

    Weights are added from the smallest up, so that a sum doesn't depend on the
    order of rows, and labels with the same weights tie exactly.
    """
    w = F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = votes.select(*keys, F.col(label).alias("label"), w.alias("_w")).repartition(*keys).sortWithinPartitions(*keys, "label", "_w")
    # a maximum of structs makes Spark aggregate by sorting, which keeps that order also where a hash table would spill
    total = F.when(F.max(F.struct("_w")).isNotNull(), F.sum("_w"))
    summed = rows.groupBy(*keys, "label").agg(total.alias(out))
    own = Window.partitionBy(*keys)
    marked = summed.select(
        *keys, "label", out, F.max("label").over(own).alias("_most"), F.sum(out).over(own).alias("_sum"), F.row_number().over(own.orderBy("label")).alias("_n"), F.min("label").over(own).alias("_least")
    )
    only = F.col("_most") == BACKGROUND
    empty = F.col("_sum") == 0
    value = F.when(only | (empty & (F.col("label") == BACKGROUND)), F.lit(1.0)).otherwise(F.col(out))
    row = F.struct(F.col("label").alias("label"), value.alias(out))
    extra = F.struct(F.lit(BACKGROUND).cast(votes.schema[label].dataType).alias("label"), F.lit(1.0).alias(out))
    rows = F.when(empty & (F.col("_n") == 1) & (F.col("_least") != BACKGROUND), F.array(row, extra)).otherwise(F.array(row))
    return marked.select(*keys, F.inline(rows))


def top_label(proba: DataFrame, keys: list[str], label: str = "label", p: str = "p") -> DataFrame:
    """The label of largest p in each voxel, of equals the smallest."""
    best = F.max(F.struct(F.col(p), (-F.col(label)).alias("_minus")))
    return proba.groupBy(*keys).agg(best.alias("_b")).select(*keys, (-F.col("_b._minus")).alias(label), F.col(f"_b.{p}").alias(p))


def ranked_labels(proba: DataFrame, keys: list[str], most: int, label: str = "label", p: str = "p") -> DataFrame:
    """The first most labels of each voxel by falling p, of equals the smaller first: rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col(p).desc(), F.col(label))
    return proba.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def bridge(structures: DataFrame, label: str = "label", tissues: str = "tissues") -> DataFrame:
    """(label, tissue, tissues_n): one row for each class that a label may belong to."""
    return structures.select(F.col(label).alias("label"), F.explode(tissues).alias("tissue"), F.size(tissues).alias("tissues_n"))


def tissue_prior(proba: DataFrame, structures: DataFrame, keys: list[str], mask: str | None = None, threshold: float = PRIOR_THRESHOLD, p: str = "p", mask_hard: bool = False) -> DataFrame:
    """Label mass dealt evenly to the label's classes, masked, normalised, cut and normalised again.

    Labels without a structure row are skipped. Where the column mask is 0 the
    background class is set to 1 beside the others, or alone if mask_hard. A
    voxel without mass becomes background. Rows with mass only: keys, tissue, q.
    structures is a table of labels, of a checked size broadcast by Spark.
    """
    kept = [*keys, *([mask] if mask else [])]
    mass = proba.join(dimension(bridge(structures)), "label", "left").groupBy(*kept, F.col("tissue").cast("int").alias("tissue")).agg(F.coalesce(F.sum(F.col(p) / F.col("tissues_n")), F.lit(0.0)).alias("q"))
    # a voxel's rows lie in one partition already: its sums are windows without another exchange
    own, first = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("tissue")
    out = (F.coalesce(F.col(mask), F.lit(1)) == 0) if mask else F.lit(False)
    background = F.col("tissue") == BACKGROUND
    value = F.when(F.col("tissue").isNull(), None).when(out & background, 1.0).when(out & F.lit(mask_hard), None).otherwise(F.col("q"))
    rows = mass.withColumn("_v", value).withColumns({"_n": F.row_number().over(first), "_has": F.max(F.coalesce(background, F.lit(False))).over(own), "_sum": F.coalesce(F.sum("_v").over(own), F.lit(0.0))})
    rows = rows.withColumn("_set", out & ~F.col("_has"))  # the mask's background, where the voxel has no such row
    rows = rows.withColumn("_t", F.col("_sum") + F.when(F.col("_set"), 1.0).otherwise(0.0))
    cut = lambda x: F.when(x >= threshold, x)
    rows = rows.withColumns({"_s": cut(safe_ratio(F.col("_v"), F.col("_t"))), "_b": cut(F.when(F.col("_set"), safe_ratio(F.lit(1.0), F.col("_t"))))})
    rows = rows.withColumn("_u", F.coalesce(F.sum("_s").over(own), F.lit(0.0)) + F.coalesce("_b", F.lit(0.0)))
    added = F.when(F.col("_n") == 1, F.when(F.col("_u") == 0, 1.0).otherwise(F.col("_b") / F.col("_u")))
    pair = lambda t, q: F.struct(t.alias("tissue"), q.alias("q"))
    both = F.array(pair(F.col("tissue"), safe_ratio(F.col("_s"), F.col("_u"))), pair(F.lit(BACKGROUND).cast("int"), added))
    return rows.select(*keys, F.inline(both)).where("q > 0")


def on_border(x: Column, y: Column, z: Column, nx: Column, ny: Column, nz: Column) -> Column:
    """Whether a voxel lies on one of the six faces of its grid."""
    return (x == 0) | (y == 0) | (z == 0) | (x == nx - 1) | (y == ny - 1) | (z == nz - 1)


def tissue_map(posterior: DataFrame, keys: list[str], border: Column, q: str = "q", prior: str = "prior") -> DataFrame:
    """Class of each voxel: background on the border and where the prior is certain of it, else the largest q.

    posterior has q and the prior beside each other, so that one aggregation by
    voxel does; border may use the keys and is the same for all rows of a voxel.
    """
    sure = F.max((F.col("tissue") == BACKGROUND) & (F.col(prior) == 1))
    best = F.max(F.struct(F.col(q), (-F.col("tissue")).alias("m")))
    found = posterior.groupBy(*keys).agg(best.alias("_b"), sure.alias("_sure"), F.max(border).alias("_border"))
    return found.select(*keys, F.when(F.col("_border") | F.coalesce("_sure", F.lit(False)), F.lit(BACKGROUND)).otherwise(-F.col("_b.m")).cast("int").alias("tissue"))


def constrained_top(proba: DataFrame, tissues: DataFrame, structures: DataFrame, keys: list[str], p: str = "p", require_positive: bool = False, all_labels: bool = True, stop_at_unknown: bool = False) -> DataFrame:
    """For each voxel the most probable label that may belong to the voxel's class, else background.

    Ties go to the smaller label. proba is sparse: unless require_positive, a
    label without a row counts with probability 0 (all_labels adds, for voxels
    that nothing else fits, the smallest label of the class). With
    stop_at_unknown a label without structure row that is more probable ends
    the search. One join and one aggregation by voxel; tables of labels are
    broadcast within their bound.
    """
    links = bridge(structures).select("label", "tissue").distinct()
    rows = tissues.join(proba.where(F.col(p) > 0) if require_positive else proba, keys, "left")
    rows = rows.join(dimension(links.withColumn("_fits", F.lit(True))), ["label", "tissue"], "left")
    value = F.struct(F.col(p).alias("p"), (-F.col("label")).alias("m"))
    wanted = [F.max(F.when(F.col("_fits"), value)).alias("b")]
    if stop_at_unknown:
        rows = rows.join(dimension(structures.select("label").distinct().withColumn("_known", F.lit(True))), "label", "left")
        wanted.append(F.max(F.when(F.col("_known").isNull() & F.col("label").isNotNull(), value)).alias("u"))
    out = rows.groupBy(*keys, "tissue").agg(*wanted)
    label = F.when(F.col("u").isNull() | (F.col("b") > F.col("u")), -F.col("b.m")) if stop_at_unknown else -F.col("b.m")
    if all_labels and not require_positive and not stop_at_unknown:
        least = links.groupBy("tissue").agg(F.min("label").alias("_least"))
        out, label = out.join(dimension(least), "tissue", "left"), F.coalesce(label, F.col("_least"))
    return out.select(*keys, "tissue", F.coalesce(label, F.lit(BACKGROUND)).alias("label"))
