"""Test-case grouping and totals (AGG-1, AGG-2, AGG-3, AGG-15, TOP-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.functions import patterns as P


def testcase_groups(catalog: DataFrame) -> DataFrame:
    """AGG-1, flat: one row per test case with its file count and first/last
    path.  Membership stays a flat ``(test_case_id, path)`` table
    (``testcase_members``): no group is ever collected into one array."""
    return catalog.filter(F.col("language").isNotNull()).groupBy("test_case_id").agg(
        F.count("*").alias("n_files"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )


def testcase_members(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("language").isNotNull()).select("test_case_id", "path")


def testcase_limit(catalog: DataFrame, n: int = 5) -> DataFrame:
    """TOP-3: the files of the first ``n`` test cases, in id order (the
    reference uses file-system discovery order; ids make it deterministic).
    The id list is bounded by ``n`` and broadcast for the semi join."""
    members = testcase_members(catalog)
    first = members.select("test_case_id").distinct().orderBy("test_case_id").limit(n)
    return members.join(F.broadcast(first), "test_case_id", "left_semi")


def first_k(df: DataFrame, group_cols: list[str], order_cols: list, k: int) -> DataFrame:
    """TOP-5: the first k rows of each group.  ``row_number() <= k`` is
    planned as a window group limit, applied partially before the exchange, so
    a large group never moves whole."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def file_counts(catalog: DataFrame) -> DataFrame:
    """AGG-15: files per extension and language."""
    return catalog.groupBy("ext", "language").agg(F.count("*").alias("n_files"))


def testcase_summary(catalog: DataFrame, functions: DataFrame) -> DataFrame:
    """AGG-2: per test case the file count and function totals; a test case
    without functions keeps zeros."""
    groups = testcase_groups(catalog).select("test_case_id", "n_files")
    per = functions.groupBy("test_case_id").agg(
        F.count("*").alias("total_functions"),
        F.count_if(F.col("label") == P.POSITIVE).alias("positive_functions"),
        F.count_if(F.col("label") == P.NEGATIVE).alias("negative_functions"),
    )
    out = groups.join(per, "test_case_id", "left")
    return out.select(
        "test_case_id", "n_files",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in
          ("total_functions", "positive_functions", "negative_functions")],
    )


def dataset_summary(catalog: DataFrame, functions: DataFrame) -> DataFrame:
    """AGG-3: per language and overall ('ALL'): distinct test cases, files and
    function totals.  ``rollup`` gives the overall row in the same pass."""
    files = catalog.filter(F.col("language").isNotNull())
    f_tot = files.rollup("language").agg(
        F.count_distinct("test_case_id").alias("test_cases"), F.count("*").alias("files")
    ).withColumn("language", F.coalesce("language", F.lit("ALL")))
    fn_tot = functions.rollup("language").agg(
        F.count("*").alias("total_functions"),
        F.count_if(F.col("label") == P.POSITIVE).alias("positive_functions"),
        F.count_if(F.col("label") == P.NEGATIVE).alias("negative_functions"),
    ).withColumn("language", F.coalesce("language", F.lit("ALL")))
    out = f_tot.join(fn_tot, "language", "left")
    return out.select(
        "language", "test_cases", "files",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in
          ("total_functions", "positive_functions", "negative_functions")],
    )
