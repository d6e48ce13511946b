"""Quality classifier: random Fourier features of document statistics.

A document becomes ``STATISTICS`` numbers about its words, characters and lines.
Standardised, they pass through ``features`` random Fourier features, cosines of
random projections whose inner products approximate a Gaussian kernel; ridge
regression on them is then a kernel classifier with a model of fixed size.  Its
normal equations are sums over rows: every task sums its own rows, Spark adds the
partial sums, and the driver solves one system of ``features + 1`` unknowns.
Labelled rows kept out of the equations calibrate the score: their ridge scores,
counted in ``bins`` equal steps, are fitted by isotonic regression.

At most ``max_rows`` labelled documents (those of the smallest id hashes) train
the model; every document is scored.

Defined results: null and empty texts are scored by their statistics (all 0); a null
label or id is no training row; rows repeated in ``labels`` count as often as they
stand there; without training rows every score is 0.5; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 20_000
FEATURES = 256
RIDGE = 1e-3
WIDTH = 3.0
BINS = 200
SEED = 11
#: Share of the labelled rows (by hash) that calibrate.
CALIBRATE = 4
SYMBOLS = b"#*$%&|<>{}[]=_~^\\@+"
STATISTICS = 18


def statistics(text: str | None) -> list[float]:
    """Numbers about a text; ratios are of words, lines or bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(1, len(data))
    if not n:
        return [0.0] * STATISTICS
    left = lambda drop: len(data) - len(data.translate(None, drop))
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = Counter(words)
    top = counts.most_common(1)[0][1]
    triples = set(zip(words, words[1:], words[2:], strict=False))
    lower, upper = left(b"abcdefghijklmnopqrstuvwxyz"), left(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    bare = sum(1 for w in words if len(w) == 1 and not w.isalnum())
    marked = len(re.findall(rb"[^\s\w.,;:'\"()\x80-\xff-]{2}", data))
    return [
        np.log1p(n), np.log1p(len(lines)), (len(data) - len(words)) / n, len(counts) / n, top / n,
        len(triples) / max(1, n - 2), len(set(lines)) / len(lines), n / len(lines) / 100, left(SYMBOLS) / size * 10,
        left(b"0123456789") / size * 10, upper / size, lower / size, left(b"!?") / size * 10, left(b".,;:") / size * 10,
        bare / n, marked / n, sum(1 for x in lines if x.rstrip()[-1:] in b".!?") / len(lines), left(b"|") / size * 10]


def projection(features: int, seed: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.normal(0, 1 / width, (STATISTICS, features)), r.uniform(0, 2 * np.pi, features)


def lifted(x: np.ndarray, model: dict) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    w, b = projection(model["features"], model["seed"], model["width"])
    z = np.clip((x - model["mean"]) / model["spread"], -5, 5)
    return np.hstack([np.cos(z @ w + b) * np.sqrt(2 / model["features"]), np.ones((len(x), 1))])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """``x, y, fold`` of at most ``max_rows`` labelled documents: their ids are
    few enough to broadcast, so documents are not shuffled."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
    rows = rows.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    found = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(rows), "id")
    return found.select(measured("text").alias("x"), "y", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(CALIBRATE)).alias("fold"))


def _summed(rows: DataFrame, product) -> np.ndarray:
    """Sum of ``product(x, y)``, a matrix, over all rows: one partial sum a task,
    entries added by Spark; the driver gets one matrix."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                p = product(np.stack(b["x"].to_list()), b["y"].to_numpy(float))
                total = p if total is None else total + p
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    sums = rows.select("x", "y").mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if not len(sums):
        return np.zeros((0, 0))
    out = np.zeros((sums["i"].max() + 1, sums["j"].max() + 1))
    out[sums["i"], sums["j"]] = sums["v"]
    return out


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in pools])


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, bins: int = BINS, seed: int = SEED) -> dict | None:
    """The model of fixed size, or None without training rows."""
    moments = _summed(rows, lambda x, y: np.stack([np.ones(STATISTICS) * len(x), x.sum(0), (x * x).sum(0)]))
    if not moments.size:
        return None
    mean = moments[1] / moments[0]
    spread = np.sqrt(np.maximum(moments[2] / moments[0] - mean**2, 1e-8))
    model = {"mean": mean, "spread": spread, "features": features, "seed": seed, "width": width}

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = lifted(x, model)
        return z.T @ np.column_stack([z, y])

    sums = _summed(rows.filter("fold <> 0"), equations)
    if not sums.size:
        sums = _summed(rows, equations)
    a, b = sums[:, :-1], sums[:, -1]
    model["weights"] = np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) / features * np.eye(len(a)), b)

    def counted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip((lifted(x, model) @ model["weights"] + 0.5) / 2 * bins, 0, bins - 1).astype(int)
        return np.stack([np.bincount(at, minlength=bins), np.bincount(at, y, bins)]).astype(float)

    held = _summed(rows.filter("fold = 0"), counted)
    if not held.size:
        held = _summed(rows, counted)
    n, good = held
    used = np.flatnonzero(n)
    curve = isotonic(good[used] / n[used], n[used])
    model["curve"] = np.clip(np.interp(np.arange(bins), used, curve), 0, 1)
    return model


def scored(docs: DataFrame, model: dict | None, text: str = "text") -> Column:
    """Score between 0 and 1 of each text."""
    @F.pandas_udf("double")
    def udf(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        raw = lifted(np.array([statistics(t) for t in texts]), model) @ model["weights"]
        # steps of the calibration curve, and within a step by the raw score, so ranks stay
        bins = len(model["curve"])
        at = np.clip((raw + 0.5) / 2 * bins - 0.5, 0, bins - 1)
        return pd.Series(np.interp(at, np.arange(bins), model["curve"]))

    return udf(F.col(text))


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", cut: float = 0.7, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted``; labels of rows that meet
    ``held_out`` (over ``doc_id``) are never read."""
    model = fit(training_rows(docs, labels, label, ~held_out), **options)
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), scored(docs, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))
