"""Declared table schemas.  Explicit everywhere, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

TESTCASE = T.StructType([
    T.StructField("file_id", T.LongType(), False),
    T.StructField("folder", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_extension", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("cwe", T.StringType()),
    T.StructField("vulnerability_location", T.StringType()),
])

CASES = T.StructType([
    T.StructField("model_id", T.IntegerType(), False),
    T.StructField("file_name", T.StringType(), False),
    T.StructField("file_content", T.StringType()),
    T.StructField("cwe", T.StringType()),
    T.StructField("vulnerability_location", T.StringType()),
])
CASES_KEY = ["model_id", "file_name"]

VLW = T.StructType([
    T.StructField("file_name", T.StringType(), False),
    T.StructField("cwe", T.StringType()),
    T.StructField("cwe_int", T.IntegerType()),
    T.StructField("vulnerability_location", T.IntegerType()),
    T.StructField("vlw_content", T.StringType()),
    T.StructField("offset", T.IntegerType()),
    T.StructField("model_id", T.IntegerType()),
])
VLW_KEY = ["file_name"]

FUNCTIONS = T.StructType([
    T.StructField("language", T.StringType()),
    T.StructField("test_case_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("file_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("lines", T.IntegerType()),
    T.StructField("label", T.StringType()),
])

TRAINING = T.StructType([
    T.StructField("split", T.StringType()),
    T.StructField("file_id", T.LongType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("seq", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("label", T.ArrayType(T.IntegerType())),
])

EPOCHS = T.StructType([
    T.StructField("trial", T.LongType()),
    T.StructField("epoch", T.LongType()),
    T.StructField("train_loss", T.DoubleType()),
    T.StructField("valid_loss", T.DoubleType()),
    T.StructField("valid_auroc", T.DoubleType()),
])

SOURCE_FILE = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
])


def ddl(schema: T.StructType) -> str:
    """Column list for ``CREATE TABLE ... USING parquet`` (SNK-1)."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
