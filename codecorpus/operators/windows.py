"""Vulnerable-line windows (J4): MTH-1..3, FLT-3, PRJ-8, STR-6, SMP-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import patterns as P
from codecorpus.functions.code import cwe_number
from codecorpus.functions.text import split_lines


def md5_int(*parts) -> Column:
    """Stable 32-bit hash: the first 8 hex digits of md5 as a number (equal in
    DuckDB as ``('0x' || substr(md5(x), 1, 8))::BIGINT``)."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("bigint")


def window_offsets(key: Column, window: int, seed: str = "vlw") -> tuple[Column, Column]:
    """MTH-1: lines before = 1 .. W-1, after = W-1-before.  The reference
    draws them unseeded; here they are a replayable hash of the row key."""
    before = F.pmod(md5_int(F.lit(seed), key.cast("string")), F.lit(window - 1)) + 1
    return before, F.lit(window - 1) - before


def line_windows(cases: DataFrame, window: int = P.WINDOW_LINES, seed: str = "vlw",
                 numeric_class: bool = False, one_based: bool = False) -> DataFrame:
    """J4: rows with a single location (no comma); the location L is a 0-based
    line index (as written, T5).  When 0 <= L < n the window is
    lines[max(0, L-before) : min(n, L+after+1)] and the new location L-start;
    otherwise the text is empty and the location NULL.  Unparseable locations
    are dropped here (``window_rejects`` lists them) instead of aborting.
    ``numeric_class`` fills ``cwe_int`` from the class name (EXT-3) instead
    of the reference's constant 0; ``one_based`` reads locations as line numbers
    from 1 (T5, MTH-2)."""
    single = cases.filter(~F.col("vulnerability_location").contains(","))
    loc = F.trim(F.col("vulnerability_location")).try_cast("int") - F.lit(int(one_based))
    lines = split_lines(F.col("file_content"))
    before, after = window_offsets(F.col("file_id"), window, seed)  # names repeat, ids do not
    t = single.select(
        "file_id", "file_name", "cwe", "model_id", loc.alias("L"), lines.alias("lines"),
        before.alias("before"), after.alias("after"),
    ).filter(F.col("L").isNotNull())
    n = F.size("lines")
    inside = (F.col("L") >= 0) & (F.col("L") < n)
    start = F.greatest(F.lit(0), F.col("L") - F.col("before"))
    end = F.least(n, F.col("L") + F.col("after") + 1)
    text = F.when(inside, F.array_join(F.slice("lines", start + 1, end - start), "\n")).otherwise(F.lit(""))
    rel = F.when(inside, F.col("L") - start)
    return t.select(
        "file_id", "file_name", "cwe",
        (F.coalesce(cwe_number(F.col("cwe")), F.lit(0)) if numeric_class else F.lit(0)).alias("cwe_int"),
        rel.cast("int").alias("vulnerability_location"),
        text.alias("vlw_content"),
        F.lit(0).alias("offset"),
        F.col("model_id").cast("int").alias("model_id"),
    )


def window_rejects(cases: DataFrame) -> DataFrame:
    """MTH-3: single-location rows whose location is not an integer."""
    single = cases.filter(~F.col("vulnerability_location").contains(","))
    return single.filter(F.trim(F.col("vulnerability_location")).try_cast("int").isNull())


def hash_split(rows: DataFrame, key: list[str], test_percent: int = 20, seed: str = "split",
               exact: bool = False) -> DataFrame:
    """SMP-1: train/test by a stable hash of the row key (no global order,
    stable when rows are appended).  ``exact`` gives the test set exactly
    ceil(test_percent% of n) rows: the first rows in hash order, numbered with
    the block method."""
    h = md5_int(F.lit(seed), *[F.col(c).cast("string") for c in key])
    if not exact:
        return rows.withColumn("split", F.when(F.pmod(h, F.lit(100)) < test_percent, "test").otherwise("train"))
    from codecorpus.operators.scan import row_index

    ranked = row_index(rows.withColumn("__h", h), ["__h", *key], name="__rn", count_as="__n")
    n_test = F.ceil(F.col("__n") * test_percent / 100)
    return ranked.withColumn("split", F.when(F.col("__rn") <= n_test, "test").otherwise("train")).drop("__h", "__rn", "__n")
