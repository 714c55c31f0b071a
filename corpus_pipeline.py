"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelspark.llm.common import read, saved
from reelspark.llm.exact_dedup import stage_exact_dedup
from reelspark.llm.near_dedup import stage_near_dedup
from reelspark.llm.packing import stage_packing
from reelspark.llm.pii import stage_pii
from reelspark.llm.quality import stage_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage_quality(spark, docs, sf_dir)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage_exact_dedup(spark, docs, sf_dir)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage_near_dedup(spark, docs, sf_dir)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage_pii(spark, docs, sf_dir)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage_packing(spark, docs, sf_dir)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("near_dedup", near), ("pii", personal), ("best_fit_packing", packing)]
#: Training, trees and the genetic algorithm have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
