from pyspark.sql import functions as F

from codecorpus.functions.code import file_suffix, function_label, function_label_note
from codecorpus.functions.code import test_case_id as case_id


def test_test_case_ids(spark):
    names = ["CWE1_Foo_Bar_03b_bad.c", "CWE1_Foo__Bar_03b.c", "CWE1_F__B_81_goodG2B.c", "io_03.c",
             "CWE1_Foo__x_bad.java", "CWE78_OS_Command_Injection__char_01.cpp", "CWE15_A_Beta_07.cs", "helper.c"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(case_id(F.col("n"))).collect()]
    # T1 by hand: a number and letter go, with a _bad after them; _goodG2B stays
    assert got == ["CWE1_Foo_Bar", "CWE1_Foo__Bar", "CWE1_F__B_81_goodG2B", "io", "CWE1_Foo__x_bad",
                   "CWE78_OS_Command_Injection__char", "CWE15_A_Beta", "helper"]


def test_labels(spark):
    rows = [("bad", "_good"), ("goodB2G", "_bad"), ("helper_badSink", ""), ("main", "_bad"), ("action", "_bad"),
            ("action", "_good"), ("action", ""), ("badGood", "_bad"), ("Main", "_bad"), ("badsink_good", "")]
    df = spark.createDataFrame(rows, "name string, sfx string")
    got = [r[0] for r in df.select(function_label(F.col("name"), F.col("sfx"))).collect()]
    # names first, file suffix where the name says nothing, else secure
    assert got == ["POSITIVE", "NEGATIVE", "POSITIVE", "NEGATIVE", "POSITIVE",
                   "NEGATIVE", "NEGATIVE", "NEGATIVE", "POSITIVE", "POSITIVE"]
    assert [r[0] for r in spark.createDataFrame([("x_bad_1.c",), ("x_good.c",), ("x.c",)], "f string")
            .select(file_suffix(F.col("f"))).collect()] == ["_bad", "_good", ""]


def test_note_rule(spark):
    df = spark.createDataFrame([("badSink", False), ("bad", True), ("bad", False), ("good", False)], "n string, h boolean")
    got = [r[0] for r in df.select(function_label_note(F.col("n"), F.lit(""), F.col("h"))).collect()]
    assert got == ["POSITIVE", "NEGATIVE", "POSITIVE", "NEGATIVE"]
