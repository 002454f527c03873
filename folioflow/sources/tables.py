"""Reading the Parquet tables that the queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, *key: str) -> DataFrame:
    """One row per key. Redelivered rows differ only in ``loaded_at``, so any of them will do."""
    return df.drop("loaded_at").dropDuplicates(list(key))
