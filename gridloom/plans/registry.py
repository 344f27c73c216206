"""Named queries over the driver's tables, each with equivalent SQL.

The modules imported at the end fill QUERIES and ORACLES.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: str | Column, digits: int = 9) -> Column:
    """Sums of floats depend on their order; results are compared rounded. The name stays."""
    out = F.round(c, digits) + F.lit(0.0)
    return out.alias(c) if isinstance(c, str) else out


from gridloom.plans import cohort_queries, evaluation_queries, fusion_queries, label_queries, source_queries, stencil_queries  # noqa: E402, F401
