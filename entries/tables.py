"""Access to the test tables and to names nothing else uses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from almanac.session import scratch_path

DATABASE = "almanac_entries"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_table(spark: SparkSession, label: str) -> str:
    if not spark.catalog.databaseExists(DATABASE):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE} LOCATION '{scratch_path(spark, 'database')}'")
    return f"{DATABASE}.{label}_{uuid.uuid4().hex[:12]}"
