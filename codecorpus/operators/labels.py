"""Labels: PRJ-2, PRJ-5, AGG-4, EXT-1, EXT-2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.functions.code import file_suffix, function_label_note
from codecorpus.functions.text import base_name


def function_names(extracted: DataFrame) -> DataFrame:
    """AGG-4 / SET-3: distinct names of every extracted function (trivial ones
    included, as the reference's first pass) per test case, as flat rows."""
    return extracted.select("test_case_id", "name").distinct()


def function_labels(functions: DataFrame) -> DataFrame:
    """PRJ-2 + PRJ-5 per function, with the file suffix that fed the rule."""
    return functions.select(
        "path", "name", "start_line", file_suffix(base_name(F.col("path"))).alias("file_suffix"), "label"
    )


def function_labels_note(extracted: DataFrame, functions: DataFrame) -> DataFrame:
    """EXT-2: the design note's rule, which looks at whether the test case has
    a function named exactly ``badSink`` (an aggregate per test case, joined
    back; skewed test cases are split by the adaptive skew join)."""
    has = extracted.groupBy("test_case_id").agg(F.max(F.col("name") == "badSink").alias("has_badsink"))
    f = functions.join(has, "test_case_id", "left")
    return f.select(
        "path", "name", "start_line", "label",
        function_label_note(F.col("name"), file_suffix(base_name(F.col("path"))),
                            F.coalesce(F.col("has_badsink"), F.lit(False))).alias("label_note"),
    )


def line_labels(functions: DataFrame) -> DataFrame:
    """EXT-1: every line of a function carries its label (a C# line inside a
    nested reported function carries one row per enclosing function)."""
    return functions.select(
        "file_id", "name", "label",
        F.explode(F.sequence(F.col("start_line"), F.col("end_line"))).alias("line_no"),
    )
