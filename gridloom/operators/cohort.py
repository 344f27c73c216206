"""Which sources serve which targets, and what is still to be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import natural_key
from gridloom.session import written


def leave_one_out(sources: DataFrame, name: str = "name") -> DataFrame:
    """(target, name): each source as target of all others. Cohort tables only: the result is quadratic by nature."""
    targets = sources.select(F.col(name).alias("target"))
    return targets.crossJoin(sources.select(name)).where(F.col("target") != F.col(name))


def leave_specified_out(sources: DataFrame, left_out: DataFrame, name: str = "name") -> DataFrame:
    """(target, name): each source left out as target of all that remain."""
    rest = sources.join(left_out.select(name), name, "left_anti").select(name)
    targets = sources.join(left_out.select(name), name, "left_semi").select(F.col(name).alias("target"))
    return targets.crossJoin(rest)


def every_source(targets: DataFrame, sources: DataFrame, target: str = "target", name: str = "name", limit: int | None = None, exclude_self: bool = True) -> DataFrame:
    """(target, name): each target with every source, for the first limit targets by natural order."""
    if limit is not None:
        targets = targets.orderBy(natural_key(F.col(target)), target).limit(limit)
    out = targets.select(target).crossJoin(sources.select(name))
    return out.where(F.col(target) != F.col(name)) if exclude_self else out


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The part of a work list without a result."""
    return work.join(done.select(*keys), keys, "left_anti")


def with_position(rows: DataFrame, *order: Column | str, position: str = "position") -> DataFrame:
    """rows with their place, from 0, in an order; equal rows in any.

    Sorted over ranges of the order, one a task; a row's place is its place in
    its range after the rows of the ranges before, whose counts are a row a
    range. The sorted rows are written, so that both read the same ranges.
    """
    sorted_, _ = written(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_place", 33)
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    place = (F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)).alias(position)
    return sorted_.join(F.broadcast(before), part == F.col("_part")).select(*rows.columns, place)


def natural_rank(names: DataFrame, name: str = "name") -> DataFrame:
    """Position of each name, from 0, in natural order."""
    return with_position(names, natural_key(F.col(name)), F.col(name))


def at_positions(names: DataFrame, positions: list[int], name: str = "name") -> DataFrame:
    """The names at positions in natural order; a position outside is an error, also a negative one."""
    ranked = natural_rank(names, name)
    want = names.sparkSession.createDataFrame([(p,) for p in positions], "position int")
    joined = want.join(ranked, "position", "left")
    message = F.concat(F.lit("no name at position "), F.col("position").cast("string"))
    return joined.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(message)).otherwise(F.col(name)))


def zip_by_position(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Two name tables side by side in natural order; they must have the same length."""
    a, b = natural_rank(left.select(left_name), left_name), natural_rank(right.select(right_name), right_name)
    joined = a.join(b, "position", "full_outer")
    both = F.col(left_name).isNotNull() & F.col(right_name).isNotNull()
    return joined.select("position", F.when(both, F.col(left_name)).otherwise(F.raise_error(F.lit("the tables differ in length"))).alias(left_name), right_name)
