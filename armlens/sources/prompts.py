"""Prompt sets and conversation dumps."""

from pyspark.sql import DataFrame, SparkSession

from armlens import schema as S


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PROMPT).json(path)


def write_prompts(prompts: DataFrame, path: str) -> None:
    """JSON lines; columns a task does not have are left out of its lines."""
    prompts.write.mode("overwrite").json(path)


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """One row per conversation with its turns in an array."""
    return spark.read.schema(S.DIALOGUE).json(path)
