"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, language_id, lattice_lm, near_dedup, piece_fst, pii_semicrf, projected_ann, repair_files, tier_packing, url_rules
from gridloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"))


def op3_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.round_trip(table(spark, sf_dir, "documents"))


def op4_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op7_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_semicrf.find_personal_data(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op9_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_files.encode_to_files(table(spark, sf_dir, "documents"))


def op10_projected_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_ann.nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_exact_dedup, op2_lattice_lm, op3_piece_fst, op4_tier_packing, op5_language_id, op6_url_rules, op7_pii_semicrf, op8_near_dedup, op9_repair_files, op10_projected_ann)}
ORACLES: dict[str, str] = {"op1_exact_dedup": exact_dedup.ORACLE, "op6_url_rules": url_rules.ORACLE, "op8_near_dedup": near_dedup.ORACLE}
