"""Work lists that grow: new items are taken up once, those done are skipped.

The batch form is an anti-join of the work list with what is done. The stream
form reads a folder of work items as a stream, so that a rerun after a stop
takes up what is new (trigger availableNow) and the checkpoint keeps the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridloom.operators.cohort import unfinished
from gridloom.session import shared_dir


def run_unfinished(work: DataFrame, done: DataFrame, keys: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of what is not done yet."""
    return run(unfinished(work, done, keys))


def follow(spark: SparkSession, folder: str, schema: StructType | str, run: Callable[[DataFrame], DataFrame], out: str, name: str) -> StreamingQuery:
    """Process the Parquet work items that a folder has and gets; results are appended to out. Ends when none is left."""
    items = spark.readStream.schema(schema).parquet(folder)

    def batch(rows: DataFrame, number: int) -> None:
        run(rows).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", f"{shared_dir(spark)}/streams/{name}").trigger(availableNow=True).start()


def windowed_votes(spark: SparkSession, folder: str, schema: StructType | str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Running weighted votes of timed rows (ts, voxel, label, weight) in windows, as a stream with a watermark."""
    rows = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window).alias("window"), "voxel", "label").agg(F.sum("weight").alias("p"))
