"""Checks as rows (check, violations), and raising on those that fail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_rows(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def holds(name: str, rows: DataFrame, condition: Column) -> DataFrame:
    return rows.agg(F.count_if(~F.coalesce(condition, F.lit(False))).alias("violations")).select(F.lit(name).alias("check"), "violations")


def has_count(name: str, rows: DataFrame, n: int) -> DataFrame:
    return rows.agg(F.abs(F.count("*") - n).alias("violations")).select(F.lit(name).alias("check"), "violations")


def not_empty(name: str, rows: DataFrame) -> DataFrame:
    return rows.limit(1).agg((1 - F.count("*")).alias("violations")).select(F.lit(name).alias("check"), "violations")


def refers(name: str, rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys of rows that known lacks."""
    return no_rows(name, rows.select(key).distinct().join(known.select(key), key, "left_anti"))


def dense_from_zero(name: str, rows: DataFrame, key: str) -> DataFrame:
    """Whether distinct keys are 0..n-1."""
    d = rows.select(key).distinct()
    return d.agg((F.when(F.count("*") == 0, 0).when((F.min(key) == 0) & (F.max(key) == F.count("*") - 1), 0).otherwise(1)).cast("long").alias("violations")).select(F.lit(name).alias("check"), "violations")


def all_of(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(checks: DataFrame) -> None:
    """Raise with the names of the checks that fail."""
    failed = [f"{r['check']} ({r['violations']})" for r in checks.where("violations > 0").collect()]
    if failed:
        raise ValueError("failed checks: " + ", ".join(sorted(failed)))
