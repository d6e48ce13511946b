import os

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codecorpus.functions import text as tx

ALPHABET = st.text(alphabet=list("ab /*\n\r{};x\t"), max_size=60)


def _apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_strippers_golden(spark):
    s = "a //x\nb // y\nc /* z\n w */ d\n"
    assert _apply(spark, [s], tx.strip_keep_newlines) == ["a //x\nb \nc \n d\n"]
    assert _apply(spark, [s], tx.strip_keep_layout) == ["a    \nb     \nc     \n      d\n"]
    assert _apply(spark, [s], tx.strip_all) == ["a //x\nb \nc  d\n"]
    # T2: no string-literal awareness
    assert _apply(spark, ['u = "http:// x";'], tx.strip_keep_newlines) == ['u = "http:']


def test_line_audit_trap(spark):
    # T4: last line wholly a comment without final newline -> one line fewer
    s = "p\n// end"
    out = _apply(spark, [s], tx.strip_keep_newlines)[0]
    assert out == "p\n" and _apply(spark, [out], tx.rust_line_count) == [1]
    assert _apply(spark, [s], tx.rust_line_count) == [2]
    lay = _apply(spark, [s], tx.strip_keep_layout)[0]
    assert _apply(spark, [lay], tx.rust_line_count) == [2]


@settings(max_examples=40, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=8))
def test_stripper_properties(spark, texts):
    kept = lambda a, b: all(x == y or x in " \n" for x, y in zip(a, b))
    assert all(kept(a, b) for a, b in zip(_apply(spark, texts, tx.strip_keep_layout), texts))  # blanks only
    plain = [t for t in texts if "/" not in t]
    for op in (tx.strip_keep_newlines, tx.strip_keep_layout, tx.strip_all) if plain else ():
        assert _apply(spark, plain, op) == plain
    # dropping the newlines of what keeps them is what drops all
    flat = lambda xs: [x.replace("\n", "") for x in xs]
    assert flat(_apply(spark, texts, tx.strip_keep_newlines)) == flat(_apply(spark, texts, tx.strip_all))
    lay = _apply(spark, texts, tx.strip_keep_layout)
    assert all(len(a) == len(b) and a.count("\n") == b.count("\n") for a, b in zip(lay, texts))
    nl = _apply(spark, texts, tx.strip_keep_newlines)
    assert all(a.count("\n") == b.count("\n") for a, b in zip(nl, texts))
    assert _apply(spark, texts, tx.rust_line_count) == [t.count("\n") + (not t.endswith("\n") and t != "") for t in texts]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=list(" \t\u00a0\u2003ab\x1c"), max_size=12), min_size=1, max_size=6))
def test_py_strip(spark, texts):
    assert _apply(spark, texts, tx.py_strip) == [t.strip() for t in texts]


def test_names_and_extensions(spark):
    names = ["a.b.c", "a.", ".c", "..c", "x.cpp", "noext", "CWE1_a_01.java"]
    assert _apply(spark, names, tx.extension) == [os.path.splitext(n)[1] for n in names]
    assert _apply(spark, names, tx.stem) == [os.path.splitext(n)[0] for n in names]
    assert _apply(spark, ["/a/b/c.c", "C:\\x\\y.java", "z.cs"], tx.base_name) == ["c.c", "y.java", "z.cs"]
    assert _apply(spark, ["a\nb\n", ""], lambda c: F.size(tx.split_lines(c))) == [3, 1]
