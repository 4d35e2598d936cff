"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; columns and predicates are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Temporary views over the tables."""
    for n in names:
        load(spark, folder, n).createOrReplaceTempView(n)
