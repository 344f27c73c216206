"""Tables in CSV, XML and text files, file listings, and their sinks."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import base_name, int_list

STRUCTURES = "label int, name string, tissues string"
TISSUES = "label int, name string"
SCORES = "subject string, label int, dice double"
LABEL_MAP = "original int, consecutive int, description string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, read by schema; quotes are doubled inside quotes."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("enforceSchema", True).csv(path)


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """label, name and tissues as array<int> (written as a bracketed list)."""
    return read_csv(spark, path, STRUCTURES).withColumn("tissues", int_list(F.col("tissues")))


def read_tissues(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TISSUES)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SCORES)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, LABEL_MAP)


def read_xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """The elements named row of XML files."""
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def read_xml_tree(spark: SparkSession, path: str, row: str) -> DataFrame:
    """The elements named row of XML files, with the schema that they have themselves.

    Nested elements become structs and tags that repeat become arrays, at any
    depth; a column ``_name`` is an attribute.
    """
    return spark.read.format("xml").option("rowTag", row).load(path)


def read_label_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tissues, labels) of a file with tissues/item and labels/item; a label's classes as array<int>."""
    item = "array<struct<number:int,name:string,tissues:string>>"
    both = lambda tag: spark.read.format("xml").option("rowTag", tag).schema(f"item {item}").load(path).select(F.inline("item"))
    tissues = both("tissues").select(F.col("number").alias("label"), F.trim("name").alias("name"))
    ids = F.transform(F.split("tissues", ","), lambda x: F.trim(x).cast("int"))
    labels = both("labels").select(F.col("number").alias("original"), F.trim("name").alias("name"), ids.alias("tissues"))
    return tissues, labels


def read_named_labels(spark: SparkSession, path: str) -> DataFrame:
    """label and name of a file with LabelList/Label/{Number,Name}."""
    return read_xml(spark, path, "Label", "Number int, Name string").select(F.col("Number").alias("label"), F.trim("Name").alias("name"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, column, value) of text files of numbers; blank lines don't count."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    lines = text.select("path", F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("row", "line"))
    cells = lines.select("path", "row", F.posexplode(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")).alias("column", "cell"))
    return cells.select("path", "row", "column", F.col("cell").cast("double").alias("value"))


def matrices(cells: DataFrame) -> DataFrame:
    """(path, matrix array<array<double>>) of what read_matrix gives."""
    rows = cells.groupBy("path", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "value"))), lambda x: x["value"]).alias("r"))
    return rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "r"))), lambda x: x["r"]).alias("matrix"))


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, name, folder) of files below root whose name fits a glob; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path")
    return found.select("path", base_name(F.col("path")).alias("name"), F.element_at(F.split("path", "/"), -2).alias("folder"))


def first_existing(spark: SparkSession, candidates: Iterable[str]) -> str | None:
    """The first of some paths that exists, wherever Spark can look."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in candidates:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    return None


def write_csv(df: DataFrame, path: str, quote: bool = True) -> None:
    """CSV with a header; list columns as bracketed lists; quote=False writes no quotes at all."""
    lists = {c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]")) for c, t in df.dtypes if t.startswith("array")}
    out = df.withColumns(lists).write.mode("overwrite").option("header", True)
    (out.option("escape", '"') if quote else out.option("quote", "").option("escape", "\\")).csv(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Parquet with a folder for each value of by: the layout for volumes by subject or source."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def local_dirs(root: str) -> list[str]:
    """The folders in a local root, by natural order of their names' digits."""
    import re

    key = lambda n: [(int(x), "") if x.isdigit() else (-1, x) for x in re.findall(r"\d+|\D+", n)]
    return sorted((d for d in os.listdir(root) if os.path.isdir(os.path.join(root, d))), key=key)
