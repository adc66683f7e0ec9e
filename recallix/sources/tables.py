"""Readers of the Parquet tables. Columns are pruned by the plans that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder; a file or a folder of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utc(at: Column) -> Column:
    """A timestamp without zone as the instant it is in UTC, whatever zone the session has."""
    return F.concat(at.cast("string"), F.lit("Z")).cast("timestamp")
