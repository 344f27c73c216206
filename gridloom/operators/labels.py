"""Label tables: reconciling, remapping, naming, cleaning."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import int_list

#: The 26 steps to the voxels around one; a fixed value.
NEIGHBOURS = [d for d in product((-1, 0, 1), repeat=3) if d != (0, 0, 0)]

#: Ordered rules for names that no reference name equals: (contained text, classes); fixed values.
NAME_RULES = (("Unlabeled", [0, 1, 2, 3, 4, 5]), ("Vitamin E", [0]), ("White Matter", [3]), ("CSF", [1]), ("Basal Forebrain", [4]), ("icc", [1]))
#: A name that contains this ends its source's list.
STOP_NAME = "Lesion"


def distinct_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.select(F.col(label).alias("label")).distinct()


def label_index(labels: DataFrame, label: str = "label") -> DataFrame:
    """Dense index from 0 in ascending order of label, so that background comes first. For label tables only."""
    return distinct_labels(labels, label).withColumn("label_idx", F.row_number().over(Window.orderBy("label")) - 1)


def decode_index(rows: DataFrame, index: DataFrame, idx: str = "label_idx") -> DataFrame:
    """Labels in place of their indices."""
    return rows.join(index, idx).drop(idx)


def parse_structures(raw: DataFrame, tissues: str = "tissues") -> DataFrame:
    """The classes of a structure table read from CSV as array<int>."""
    return raw.withColumn(tissues, int_list(F.col(tissues)))


def distinct_tissues(structures: DataFrame, tissues: str = "tissues") -> DataFrame:
    return structures.select(F.explode(tissues).alias("tissue")).distinct()


def reconcile(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side), side 'unknown' if found but not known, 'unused' the other way round."""
    a, b = found.select(key).distinct(), known.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("unknown")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unused")))


def remap(rows: DataFrame, mapping: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Rows with mapping's new label (original, consecutive), and the rows whose label it lacks."""
    m = mapping.select(F.col("original").alias(label), F.col("consecutive").alias("new_label"))
    return rows.join(m, label), rows.join(m.select(label), label, "left_anti")


def assign_tissues(items: DataFrame, reference: DataFrame, present: DataFrame, source: str = "source") -> DataFrame:
    """Classes of named labels, from a reference table or by rules, and a background row.

    items: source, pos (order in the source), label, name. reference: pos, name,
    tissues; names match without their blanks, the first by pos wins. A name
    without match counts only if its label is in present (source, label); the
    rules decide by the first text it contains, a stop name drops the rest of
    its source, and a name that no rule knows is an error.
    """
    key = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    first = reference.groupBy(key(F.col("name")).alias("_key")).agg(F.min_by("tissues", "pos").alias("_tissues"))
    rows = items.withColumn("_key", key(F.col("name"))).join(first, "_key", "left")
    seen = present.select(source, "label").distinct().withColumn("_present", F.lit(True))
    rows = rows.join(seen, [source, "label"], "left").where(F.col("_tissues").isNotNull() | F.col("_present"))
    stop = F.col("_tissues").isNull() & F.contains(F.col("name"), F.lit(STOP_NAME))
    stops = rows.where(stop).groupBy(source).agg(F.min("pos").alias("_stop"))
    rows = rows.join(stops, source, "left").where(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
    ruled = F.when(F.col("_tissues").isNotNull(), F.col("_tissues"))
    for text, tissues in NAME_RULES:
        ruled = ruled.when(F.contains(F.col("name"), F.lit(text)), F.array(*map(F.lit, tissues)))
    ruled = ruled.otherwise(F.raise_error(F.concat(F.lit("unknown class of "), F.col("name"))))
    out = rows.select("label", "name", ruled.alias("tissues")).dropDuplicates(["label", "name", "tissues"])
    background = items.sparkSession.createDataFrame([(0, "Background", [0])], "label int, name string, tissues array<int>")
    return out.unionByName(background.select(F.col("label").cast(items.schema["label"].dataType).alias("label"), "name", "tissues")).dropDuplicates(["label", "name", "tissues"])


def neighbour_mode(grid: DataFrame, replace: list[int], keys: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Voxels whose label is in replace, with the commonest other label around: keys, x, y, z, label, new_label.

    Ties go to the smallest label; neighbours outside the grid don't count. With
    strict it is an error if no other label is around or the winner is to be
    replaced too; without, new_label is then null.
    """
    keys = keys or []
    marked = grid.where(F.col("label").isin(replace))
    steps = F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip(s, ("dx", "dy", "dz")))) for s in NEIGHBOURS))
    around = marked.select(*keys, "x", "y", "z", "label", F.inline(steps)).select(
        *keys, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), F.col("label").alias("_label"), (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), (F.col("z") + F.col("dz")).alias("z")
    )
    met = around.join(grid.select(*keys, "x", "y", "z", "label"), [*keys, "x", "y", "z"]).where("label <> _label")
    counts = met.groupBy(*keys, "_x", "_y", "_z", "label").count()
    best = counts.groupBy(*keys, "_x", "_y", "_z").agg(F.max(F.struct("count", (-F.col("label")).alias("m"))).alias("b"))
    best = best.select(*keys, F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_z").alias("z"), (-F.col("b.m")).alias("new_label"))
    out = marked.select(*keys, "x", "y", "z", "label").join(best, [*keys, "x", "y", "z"], "left")
    bad = F.col("new_label").isNull() | F.col("new_label").isin(replace)
    other = F.raise_error(F.concat(F.lit("no label to take for a voxel of label "), F.col("label").cast("string"))) if strict else F.lit(None)
    return out.withColumn("new_label", F.when(bad, other).otherwise(F.col("new_label")))


def clean_labels(grid: DataFrame, replace: list[int], keys: list[str] | None = None, strict: bool = True) -> DataFrame:
    """The grid with the labels in replace changed, all from the labels before."""
    keys = keys or []
    new = neighbour_mode(grid, replace, keys, strict).select(*keys, "x", "y", "z", "new_label")
    return grid.join(new, [*keys, "x", "y", "z"], "left").withColumn("label", F.coalesce("new_label", "label")).drop("new_label")


def changed_count(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    joined = before.join(after.withColumnRenamed("label", "_after"), keys)
    return joined.agg(F.count_if(F.col("label") != F.col("_after")).alias("n_changed"))
