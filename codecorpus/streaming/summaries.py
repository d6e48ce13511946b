"""STM-2: totals of an incremental ingest (AGG-2, AGG-3, AGG-6), kept as partial
states.

Every micro-batch leaves two small tables of its own, by test case and by size:
rows that add up, keyed by batch, so a batch that runs again replaces its rows.
Reading adds the states of all batches: the totals equal those of one batch job over
all files, without reading a file or a function again.  A test case whose files came
in several batches has a row in each and counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.functions import patterns as P
from codecorpus.operators import stats

CASES, SIZES = "case_states", "size_states"
TOTALS = ("total_functions", "positive_functions", "negative_functions")
CASE_STATE = "language string, test_case_id string, n_files bigint, " + ", ".join(f"{c} bigint" for c in TOTALS)
SIZE_STATE = "label string, lines int, n bigint"


def case_states(catalog: DataFrame, functions: DataFrame) -> DataFrame:
    """Files and functions by language and test case."""
    files = catalog.filter(F.col("language").isNotNull()).groupBy("language", "test_case_id").agg(F.count(F.lit(1)).alias("n_files"))
    found = functions.groupBy("language", "test_case_id").agg(
        F.count(F.lit(1)).alias(TOTALS[0]), F.count_if(F.col("label") == P.POSITIVE).alias(TOTALS[1]), F.count_if(F.col("label") == P.NEGATIVE).alias(TOTALS[2]))
    return files.join(found, ["language", "test_case_id"], "left").select(
        "language", "test_case_id", "n_files", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in TOTALS])


def size_states(functions: DataFrame) -> DataFrame:
    """Functions by label and size."""
    return functions.groupBy("label", "lines").agg(F.count(F.lit(1)).alias("n"))


def write_states(catalog: DataFrame, functions: DataFrame, out_path: str, batch_id: int) -> None:
    case_states(catalog, functions).write.mode("overwrite").parquet(f"{out_path}/{CASES}/batch_id={batch_id}")
    size_states(functions).write.mode("overwrite").parquet(f"{out_path}/{SIZES}/batch_id={batch_id}")


def _states(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch_id bigint").parquet(path)


def _sums() -> list:
    return [F.sum(c).cast("bigint").alias(c) for c in TOTALS]


def testcase_summary(spark: SparkSession, out_path: str) -> DataFrame:
    """AGG-2 over all batches."""
    states = _states(spark, f"{out_path}/{CASES}", CASE_STATE)
    return states.groupBy("test_case_id").agg(F.sum("n_files").cast("bigint").alias("n_files"), *_sums())


def dataset_summary(spark: SparkSession, out_path: str) -> DataFrame:
    """AGG-3 over all batches."""
    states = _states(spark, f"{out_path}/{CASES}", CASE_STATE)
    total = states.rollup("language").agg(F.count_distinct("test_case_id").alias("test_cases"), F.sum("n_files").cast("bigint").alias("files"), *_sums())
    return total.withColumn("language", F.coalesce("language", F.lit("ALL")))


def size_stats(spark: SparkSession, out_path: str) -> DataFrame:
    """AGG-6 over all batches."""
    states = _states(spark, f"{out_path}/{SIZES}", SIZE_STATE)
    return stats.stats_of_counts(states.groupBy("label", "lines").agg(F.sum("n").alias("n")))
