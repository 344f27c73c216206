"""Affine transforms: composing them, and resampling a grid through one."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gridloom.session import let_workers_import

Affine = list[list[float]]


def compose_inverse(affine: Affine, sform: Affine) -> Affine:
    """inverse(affine) @ sform: where the moved image's voxels lie once registered."""
    return (np.linalg.inv(np.array(affine, float)) @ np.array(sform, float)).tolist()


def registered_sforms(meta: DataFrame, affine: str = "affine", sform: str = "sform", out: str = "registered") -> DataFrame:
    """compose_inverse for each row of array<array<double>> columns, a batch at a time."""
    let_workers_import(meta.sparkSession)
    schema = StructType([*meta.schema.fields, StructField(out, ArrayType(ArrayType(DoubleType())))])

    def run(batches):
        for batch in batches:
            a, s = (np.array(batch.column(c).to_pylist(), float).reshape(-1, 4, 4) for c in (affine, sform))
            got = np.linalg.inv(a) @ s if len(a) else a
            yield batch.append_column(out, pa.array(got.tolist(), pa.list_(pa.list_(pa.float64()))))

    return meta.mapInArrow(run, schema)


def _moved(affine: Affine, x: Column, y: Column, z: Column) -> list[Column]:
    return [F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z + F.lit(float(r[3])) for r in affine[:3]]


def resample_nearest(target: DataFrame, source: DataFrame, affine: Affine, label: str = "label") -> DataFrame:
    """Label of the source voxel nearest to each target voxel's image; 0 outside. One equi-join."""
    u = _moved(affine, F.col("x"), F.col("y"), F.col("z"))
    want = target.select("x", "y", "z", *(F.floor(c + 0.5).cast("int").alias(n) for c, n in zip(u, ("_x", "_y", "_z"))))
    have = source.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), F.col(label).alias(label))
    return want.join(have, ["_x", "_y", "_z"], "left").select("x", "y", "z", F.coalesce(label, F.lit(0)).alias(label))


def resample_linear(target: DataFrame, source: DataFrame, affine: Affine, value: str = "value") -> DataFrame:
    """Trilinear value at each target voxel's image; null where a corner that counts is outside."""
    u = _moved(affine, F.col("x"), F.col("y"), F.col("z"))
    placed = target.select("x", "y", "z", *(c.alias(n) for c, n in zip(u, ("_u", "_v", "_w"))))
    corners = F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip(c, ("dx", "dy", "dz")))) for c in product((0, 1), repeat=3)))
    rows = placed.select("*", F.inline(corners))
    part = lambda c, d: F.when(F.col(d) == 1, F.col(c) - F.floor(c)).otherwise(1 - (F.col(c) - F.floor(c)))
    rows = rows.select("x", "y", "z", *((F.floor(c) + F.col(d)).cast("int").alias(n) for c, d, n in (("_u", "dx", "_x"), ("_v", "dy", "_y"), ("_w", "dz", "_z"))), (part("_u", "dx") * part("_v", "dy") * part("_w", "dz")).alias("_weight")).where("_weight > 0")
    have = source.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), F.col(value).cast("double").alias("_value"))
    met = rows.join(have, ["_x", "_y", "_z"], "left").groupBy("x", "y", "z").agg(F.sum(F.col("_weight") * F.col("_value")).alias(value), F.count_if(F.col("_value").isNull()).alias("_out"))
    return met.select("x", "y", "z", F.when(F.col("_out") == 0, F.col(value)).alias(value))
