"""Function analytics (J7): totals, threshold retention, size distribution.

Everything is a grouped aggregation with map-side partial aggregation.  The
size-distribution queries first reduce functions to one row per distinct size
(sizes are few: bounded by the longest function), then work on that small
table, so no query ever sorts or windows the full function table in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecorpus.functions import patterns as P
from codecorpus.operators.scan import prefix_scan, row_index
from codecorpus.operators.staging import staged


def _pos():
    return F.col("label") == P.POSITIVE


def _neg():
    return F.col("label") == P.NEGATIVE


def _pct(a, b):
    return F.round(F.coalesce(F.try_divide(a * F.lit(100.0), b), F.lit(0.0)), 6)


def size_counts(functions: DataFrame) -> DataFrame:
    """One row per distinct function size: ``lines, n, n_pos, n_neg``."""
    return functions.groupBy("lines").agg(
        F.count("*").alias("n"), F.count_if(_pos()).alias("n_pos"), F.count_if(_neg()).alias("n_neg")
    )


def threshold_retention(functions: DataFrame, thresholds=P.DEFAULT_THRESHOLDS) -> DataFrame:
    """AGG-5 / JN-4 / PRJ-7: per minimum size t, how many functions (and of
    which label) have ``lines >= t``, against the all-functions baseline.

    The range join runs on the per-size counts (one row per distinct size), not
    on functions; the thresholds list is a parameter of fixed small size, so it
    is broadcast."""
    spark: SparkSession = functions.sparkSession
    # The NULL threshold row is the baseline: it matches every size.
    th = spark.createDataFrame([(int(t),) for t in thresholds] + [(None,)], "threshold int")
    sizes = size_counts(functions)
    per = (
        F.broadcast(th)
        .join(sizes, F.col("lines") >= F.coalesce(F.col("threshold"), F.col("lines")), "left")
        .groupBy("threshold")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"),
            F.coalesce(F.sum("n_pos"), F.lit(0)).cast("bigint").alias("positive"),
            F.coalesce(F.sum("n_neg"), F.lit(0)).cast("bigint").alias("negative"),
        )
    )
    every = Window.partitionBy()  # over len(thresholds) + 1 rows only
    out = (
        per.withColumn("baseline_total", F.max(F.when(F.col("threshold").isNull(), F.col("total"))).over(every))
        .withColumn("baseline_positive", F.max(F.when(F.col("threshold").isNull(), F.col("positive"))).over(every))
        .withColumn("baseline_negative", F.max(F.when(F.col("threshold").isNull(), F.col("negative"))).over(every))
        .filter(F.col("threshold").isNotNull())
    )
    return out.select(
        "threshold", "total", "positive", "negative",
        _pct(F.col("positive"), F.col("total")).alias("pos_pct"),
        _pct(F.col("total"), F.col("baseline_total")).alias("retained_pct"),
        _pct(F.col("positive"), F.col("baseline_positive")).alias("pos_retained_pct"),
        _pct(F.col("negative"), F.col("baseline_negative")).alias("neg_retained_pct"),
        F.coalesce("baseline_total", F.lit(0)).alias("baseline_total"),
        F.coalesce("baseline_positive", F.lit(0)).alias("baseline_positive"),
        F.coalesce("baseline_negative", F.lit(0)).alias("baseline_negative"),
    )


def _r(c, d=6):
    return F.round(c, d)


def size_stats(functions: DataFrame) -> DataFrame:
    """AGG-6: count, mean, median (interpolated), min, max and population
    standard deviation of function sizes, per label and overall ('ALL').
    Computed from per-(label, size) counts: exact integer sums, and the
    median as a frequency-weighted percentile over distinct sizes."""
    return stats_of_counts(functions.groupBy("label", "lines").agg(F.count("*").alias("n")))


def stats_of_counts(per: DataFrame) -> DataFrame:
    """AGG-6 from ``label, lines, n``."""
    agg = per.rollup("label").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("lines")).alias("s1"),
        F.sum(F.col("n") * F.col("lines") * F.col("lines")).alias("s2"),
        F.percentile(F.col("lines"), F.lit(0.5), F.col("n")).alias("median"),
        F.min("lines").alias("min_lines"),
        F.max("lines").alias("max_lines"),
    )
    mean = F.col("s1") / F.col("n")
    var = F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))
    return agg.select(
        F.coalesce("label", F.lit("ALL")).alias("label"),
        F.col("n").cast("bigint").alias("n"),
        _r(mean).alias("mean"),
        _r(F.col("median")).alias("median"),
        F.col("min_lines").cast("bigint").alias("min_lines"),
        F.col("max_lines").cast("bigint").alias("max_lines"),
        _r(F.sqrt(var)).alias("std_pop"),
    )


def size_histogram(functions: DataFrame, bins: int = P.HIST_BINS) -> DataFrame:
    """AGG-9: equal-width histogram over [min, max], last bin closed; exact
    integer bin arithmetic.  min = max widens the range by 0.5 on each side
    (all values land in the middle bin).  All bins are returned.  Everything
    after the size counts runs on tables of at most (#distinct sizes) rows."""
    every = Window.partitionBy()  # over distinct sizes / bins only
    sc = size_counts(functions).select(
        "lines", "n", F.min("lines").over(every).alias("mn"), F.max("lines").over(every).alias("mx"))
    width = F.col("mx") - F.col("mn")
    b = F.when(width == 0, F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("lines") - F.col("mn")) * bins / width), F.lit(bins - 1))
    )
    counted = sc.groupBy(b.cast("int").alias("bin")).agg(
        F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))
    frame = functions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = frame.join(counted, "bin", "left").select(
        "bin", "n", F.max("mn").over(every).alias("mn"), F.max("mx").over(every).alias("mx"))
    width = F.col("mx") - F.col("mn")
    lo0 = F.when(width == 0, F.col("mn") - 0.5).otherwise(F.col("mn").cast("double"))
    span = F.when(width == 0, F.lit(1.0)).otherwise(width.cast("double"))
    return out.select(
        F.col("bin").cast("bigint").alias("bin"),
        _r(lo0 + F.col("bin") * span / bins).alias("lo"),
        _r(lo0 + (F.col("bin") + 1) * span / bins).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
    )


def size_histogram_by_label(functions: DataFrame, edges: int = P.LABEL_HIST_EDGES) -> DataFrame:
    """AGG-10: shared edges ``linspace(0, max, edges)`` for both labels;
    every (label, bin) is returned, empty ones with 0."""
    bins = edges - 1
    every = Window.partitionBy()  # over distinct (label, size) / bins only
    per = functions.groupBy("label", "lines").agg(F.count("*").alias("n")).withColumn(
        "mx", F.max("lines").over(every))
    b = F.least(F.floor(F.col("lines") * bins / F.col("mx")), F.lit(bins - 1)).cast("int")
    counted = per.groupBy("label", b.alias("bin")).agg(F.sum("n").alias("n"), F.max("mx").alias("mx"))
    spark = functions.sparkSession
    frame = spark.createDataFrame([(P.POSITIVE,), (P.NEGATIVE,)], "label string").select(
        "label", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = frame.join(counted, ["label", "bin"], "left").withColumn("mx", F.max("mx").over(every))
    return out.select(
        "label", F.col("bin").cast("bigint").alias("bin"),
        _r(F.col("bin") * F.col("mx") / F.lit(float(bins))).alias("lo"),
        _r((F.col("bin") + 1) * F.col("mx") / F.lit(float(bins))).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
    )


def size_boxplot(functions: DataFrame, whis: float = P.WHISKER) -> DataFrame:
    """AGG-11: quartiles (linear), whiskers at the most extreme values within
    1.5 IQR, outlier count, per label; from per-(label, size) counts."""
    per = functions.groupBy("label", "lines").agg(F.count("*").alias("n"))
    by_label = Window.partitionBy("label")  # over the distinct sizes of a label
    q = F.percentile(F.col("lines"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).over(by_label)
    j = per.withColumn("q", q).select(
        "label", "lines", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    j = j.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo_lim = F.col("q1") - whis * F.col("iqr")
    hi_lim = F.col("q3") + whis * F.col("iqr")
    out = j.groupBy("label", "q1", "median", "q3", "iqr").agg(
        F.min(F.when(F.col("lines") >= lo_lim, F.col("lines"))).alias("whisker_lo"),
        F.max(F.when(F.col("lines") <= hi_lim, F.col("lines"))).alias("whisker_hi"),
        F.sum(F.when((F.col("lines") < lo_lim) | (F.col("lines") > hi_lim), F.col("n")).otherwise(0)).alias("n_outliers"),
    )
    return out.select(
        "label", _r(F.col("q1")).alias("q1"), _r(F.col("median")).alias("median"), _r(F.col("q3")).alias("q3"),
        _r(F.col("iqr")).alias("iqr"), F.col("whisker_lo").cast("bigint").alias("whisker_lo"),
        F.col("whisker_hi").cast("bigint").alias("whisker_hi"), F.col("n_outliers").cast("bigint").alias("n_outliers"),
    )


def size_ecdf(functions: DataFrame) -> DataFrame:
    """WIN-2: ECDF at each distinct size (the last point of a tie run):
    cumulative count / total.  Scanned with the block method over distinct
    sizes."""
    sc = size_counts(functions).select("lines", "n")
    cum = prefix_scan(sc, ["lines"], {"cum_n": ("sum", F.col("n"))}, totals_as={"cum_n": "total"})
    return cum.select(
        F.col("lines").cast("bigint").alias("lines"), F.col("n").cast("bigint").alias("n"),
        F.col("cum_n").cast("bigint").alias("cum_n"), _r(F.col("cum_n") / F.col("total")).alias("ecdf"),
    )


ORDER = ("lines", "test_case_id", "path", "start_line")


def size_middle(functions: DataFrame, half_width: int = 2) -> DataFrame:
    """WIN-3: the functions at sorted positions n//2-2 .. n//2+2 (0-based) of
    the size order (ties broken by test case, path, start line), by counting:
    the histogram of sizes tells which sizes reach into the slice, and only their
    functions are ordered (block method).  Functions are written once, as both steps
    read them."""
    rows = staged(functions.select("name", "label", *ORDER), "sizes")
    placed = prefix_scan(size_counts(rows), ["lines"], {"first": ("sum", F.col("n"))}, inclusive=False, totals_as={"first": "total"})
    low = F.greatest(F.floor(F.col("total") / 2) - half_width, F.lit(0))
    high = F.floor(F.col("total") / 2) + half_width
    # a size holds one function or more, so at most as many sizes as positions
    held = placed.filter((F.col("first") <= high) & (F.col("first") + F.col("n") > low)).select("lines", "first", low.alias("low"), high.alias("high"))
    deciding = row_index(rows.join(F.broadcast(held), "lines"), list(ORDER[1:]), ["lines"], name="rn")
    pos = F.col("first") + F.col("rn") - 1
    return deciding.filter((pos >= F.col("low")) & (pos <= F.col("high"))).select(
        pos.cast("bigint").alias("pos"), "name", F.col("lines").cast("bigint").alias("lines"), "label",
        "test_case_id", "path", F.col("start_line").cast("bigint").alias("start_line"),
    )


def _top(functions: DataFrame, k: int, desc: bool) -> DataFrame:
    keys = [F.col(c).desc() if desc else F.col(c).asc() for c in ORDER]
    return functions.orderBy(*keys).limit(k).select(
        "name", F.col("lines").cast("bigint").alias("lines"), "label", "test_case_id", "path",
        F.col("start_line").cast("bigint").alias("start_line"),
    )


def size_smallest(functions: DataFrame, k: int = 5) -> DataFrame:
    """TOP-1: the k smallest functions (distributed top-k, k is the feature)."""
    return _top(functions, k, desc=False)


def size_largest(functions: DataFrame, k: int = 5) -> DataFrame:
    """TOP-2: the k largest functions."""
    return _top(functions, k, desc=True)
