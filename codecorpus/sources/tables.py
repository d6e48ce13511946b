"""Parquet table scans of the driver tables (SRC-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over the cores when they lie in fewer splits than there are
    cores (one small file); a larger input is worked on where it is read, without a
    shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)
