import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from codecorpus.operators import stats
from codecorpus.operators.scan import prefix_scan, row_index


def test_prefix_scan_with_hot_group(spark):
    rng = random.Random(3)
    # one group holds most rows (skew), values with ties broken by id
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 20), rng.randint(0, 50), i, rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v int, id int, x double")
    got = prefix_scan(df, ["v", "id"], {"s": ("sum", F.col("v")), "mn": ("min", F.col("x")), "mx": ("max", F.col("x"))},
                      ["g"], inclusive=False, blocks=6)
    w = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("g", "id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s2"),
                     F.min("x").over(w).alias("mn2"), F.max("x").over(w).alias("mx2"))
    bad = got.join(want, ["g", "id"]).filter("s <> s2 OR NOT (mn <=> mn2) OR NOT (mx <=> mx2)").count()
    assert bad == 0
    rn = row_index(df, ["v", "id"], ["g"], count_as="n")
    want2 = df.select("g", "id", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).alias("r2"),
                      F.count("*").over(Window.partitionBy("g")).alias("n2"))
    assert rn.join(want2, ["g", "id"]).filter("rn <> r2 OR n <> n2").count() == 0


def _functions(spark, sizes_labels):
    rows = [("c", f"t{i % 3}", f"/p/{i}", i, "f", 1, s, s, lab) for i, (s, lab) in enumerate(sizes_labels)]
    return spark.createDataFrame(
        rows, "language string, test_case_id string, path string, file_id long, name string, start_line int, "
              "end_line int, lines int, label string")


def test_threshold_zero_functions(spark):
    # T14: no functions -> zeros, no division error
    out = stats.threshold_retention(_functions(spark, []), (10, 20)).orderBy("threshold").collect()
    assert [(r.threshold, r.total, r.pos_pct, r.retained_pct) for r in out] == [(10, 0, 0.0, 0.0), (20, 0, 0.0, 0.0)]


def test_histograms_and_boxplot_match_numpy(spark):
    rng = random.Random(5)
    data = [(rng.choice([1, 2, 3, 5, 8, 13, 40, 90, 400]) + rng.randint(0, 3), rng.choice(["POSITIVE", "NEGATIVE"]))
            for _ in range(500)]
    f = _functions(spark, data)
    v = np.array([s for s, _ in data])
    h = stats.size_histogram(f).orderBy("bin").collect()
    counts, edges = np.histogram(v, bins=50)
    assert [r.n for r in h] == counts.tolist()
    assert np.allclose([r.lo for r in h], edges[:-1], atol=1e-5)
    hl = {(r.label, r.bin): r.n for r in stats.size_histogram_by_label(f).collect()}
    e = np.linspace(0, v.max(), 30)
    for lab in ("POSITIVE", "NEGATIVE"):
        c, _ = np.histogram([s for s, l in data if l == lab], bins=e)
        assert [hl[(lab, b)] for b in range(29)] == c.tolist()
    for r in stats.size_boxplot(f).collect():
        x = np.array([s for s, l in data if l == r.label])
        q1, q3 = np.percentile(x, [25, 75])
        assert abs(r.q1 - q1) < 1e-6 and abs(r.q3 - q3) < 1e-6
        assert r.whisker_hi == x[x <= q3 + 1.5 * (q3 - q1)].max()
        assert r.whisker_lo == x[x >= q1 - 1.5 * (q3 - q1)].min()
    st = {r.label: r for r in stats.size_stats(f).collect()}
    assert abs(st["ALL"].std_pop - np.std(v)) < 1e-5 and abs(st["ALL"].median - np.median(v)) < 1e-9


def test_single_size_histogram(spark):
    h = stats.size_histogram(_functions(spark, [(7, "POSITIVE")] * 3)).collect()
    counts, _ = np.histogram(np.array([7, 7, 7]), bins=50)
    assert [r.n for r in sorted(h, key=lambda r: r.bin)] == counts.tolist()


def test_middle_and_ecdf(spark):
    data = [(s, "NEGATIVE") for s in [5, 1, 9, 3, 3, 7, 2, 8, 6, 4, 10]]
    f = _functions(spark, data)
    mid = stats.size_middle(f).orderBy("pos").collect()
    srt = sorted(s for s, _ in data)
    n = len(srt)
    assert [r.lines for r in mid] == srt[n // 2 - 2: n // 2 + 3]
    ecdf = {r.lines: r.ecdf for r in stats.size_ecdf(f).collect()}
    assert ecdf[3] == round(4 / n, 6) and ecdf[10] == 1.0
    assert [r.lines for r in stats.size_smallest(f, 3).collect()] == [1, 2, 3]
