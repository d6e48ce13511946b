"""Column expressions about source files: grouping keys, languages, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus.functions import patterns as P
from codecorpus.functions.text import _col, extension, stem


def test_case_id(file_name) -> Column:
    """PRJ-3: primary pattern group 1; names it does not match (all names with
    a double underscore) fall back to the stem minus a numeric tail."""
    n = _col(file_name)
    primary = F.regexp_extract(n, P.GROUP_PRIMARY, 1)
    fallback = F.regexp_replace(stem(n), P.GROUP_FALLBACK, "")
    return F.when(primary != "", primary).otherwise(fallback)


def language(ext) -> Column:
    """PRJ-4: language by lower-cased extension; NULL = file skipped."""
    e = F.lower(_col(ext))
    out = None
    for k, v in P.LANGUAGE_BY_EXT.items():
        out = F.when(e == k, F.lit(v)) if out is None else out.when(e == k, F.lit(v))
    return out


def file_suffix(name) -> Column:
    """PRJ-2: ``_bad`` if the name contains it, else ``_good``, else empty."""
    n = _col(name)
    return F.when(n.contains("_bad"), F.lit("_bad")).when(n.contains("_good"), F.lit("_good")).otherwise(F.lit(""))


def function_label(name, suffix) -> Column:
    """PRJ-5: first matching rule wins on the lower-cased name."""
    n = _col(name)
    low = F.lower(n)
    s = _col(suffix)
    return (
        F.when((low.contains("bad") & ~low.contains("good")) | low.contains("badsink"), F.lit(P.POSITIVE))
        .when(low.contains("good") | (s == "_good"), F.lit(P.NEGATIVE))
        .when(n == "main", F.lit(P.NEGATIVE))
        .when(s == "_bad", F.lit(P.POSITIVE))
        .otherwise(F.lit(P.NEGATIVE))
    )


def function_label_note(name, suffix, case_has_badsink) -> Column:
    """EXT-2: the design note's rule: ``badSink`` in the name, or ``bad`` in the
    name when the test case has no function named ``badSink`` -> POSITIVE;
    everything else NEGATIVE."""
    n = _col(name)
    return F.when(
        n.contains("badSink") | (n.contains("bad") & ~_col(case_has_badsink)), F.lit(P.POSITIVE)
    ).otherwise(F.lit(P.NEGATIVE))


def split_name(model_id) -> Column:
    """PRJ-9: split id -> name (0 training, 1 testing, 2 validation)."""
    m = _col(model_id)
    out = None
    for name, i in P.SPLIT_IDS.items():
        out = F.when(m == i, F.lit(name)) if out is None else out.when(m == i, F.lit(name))
    return out


def cwe_number(cwe) -> Column:
    """EXT-3: numeric CWE class, NULL when absent."""
    return F.regexp_extract(_col(cwe), r"CWE-?([0-9]+)", 1).try_cast("int")


__all__ = ["test_case_id", "language", "file_suffix", "function_label", "function_label_note", "cwe_number", "extension"]
