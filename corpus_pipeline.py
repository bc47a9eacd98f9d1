"""A training-data pipeline over documents, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayloom.llm import pipeline

STAGES = pipeline.STAGES
#: The classifier of the first stage is fitted in Python, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(spark, sf_dir, STAGES)
