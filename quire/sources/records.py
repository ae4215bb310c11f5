"""Readers and writers of JSON, JSON lines and CSV records with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RESULT = "question string, ground_truth string, system_answer string, difficulty string, generator string, refused boolean, error string, latency_seconds double"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array or object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are left out."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def carried(new: DataFrame, old: DataFrame, keys: list[str], notes: list[str]) -> DataFrame:
    """new with the annotations that old rows of the same keys carry."""
    return new.drop(*notes).join(old.select(*keys, *notes), keys, "left")
