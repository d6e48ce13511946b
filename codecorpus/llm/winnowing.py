"""Benchmark passages in documents, found by winnowing.

A window is ``span`` consecutive words of an item (all words of a shorter one).
Of the k-grams inside a window the one of smallest hash is its fingerprint;
consecutive windows mostly share one, so a text leaves few.  Equal windows have
equal fingerprints wherever they stand: joining the fingerprints of documents
and items loses no shared span of ``span`` words.  Shorter items make windows of
their own length, and documents leave fingerprints for every length that occurs
(at most ``span`` of them).

A fingerprint of a document names the run of windows that chose it.  Where an
item has the same one, these windows are extended to their whole words and
joined with the items' windows by an MD5 digest of the words, so a hit is a shared
span and not just a shared k-gram.  Neither join multiplies: the first asks only
whether any item has the fingerprint, the second whether any has the window, and
each window that a document holds meets its items once a document.  Which side is
small is left to Spark's planner, as the items' tables are written first and their
size is known.

Defined results: null has no words; an item without words has no windows;
repeated item ids are one item; an item with a null id marks words as hit but
is not named; rows repeated with one id and text share one result; empty tables
give an empty result or documents without hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm import exchange as X
from codecorpus.llm.common import staged, text_batches
from codecorpus.llm.terms import Terms, hashes, terms

SPAN = 10
SPANS = "array<struct<first: bigint, last: bigint>>"


def gram(span: int) -> int:
    """Words of a k-gram; a window holds ``span - gram + 1`` of them."""
    return (span + 1) // 2


def minima(h: np.ndarray, row: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First word (place in ``h``) of every window and its smallest k-gram hash."""
    k, n = gram(span), len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = h[:len(h) - k + 1].copy()
    for j in range(1, k):
        grams = X.joined_hash(grams, h[j:len(h) - k + 1 + j])
    least = grams[:n].copy()
    for j in range(1, span - k + 1):
        np.minimum(least, grams[j:n + j], out=least)
    at = np.flatnonzero(row[:n] == row[span - 1:])
    return at, least[at]


def prints(h: np.ndarray, row: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Fingerprints: row, hash, first window that chose it, number of windows."""
    at, least = minima(h, row, span)
    of = row[at]
    head = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (least[1:] != least[:-1])][:len(at)])
    return of[head], least[head], at[head] - first[of[head]], np.diff(np.r_[head, len(at)])


def digest(t: Terms, at: int, span: int) -> bytes:
    return hashlib.md5(b" ".join(t.text(i) for i in range(at, at + span)), usedforsecurity=False).digest()


def item_windows(items: DataFrame, span: int = SPAN, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item, span, print, window``: every window of every item."""
    schema = pa.schema([("item", pa.string()), ("span", pa.int32()), ("print", pa.int64()), ("window", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in X.chunks(batches):
            t = terms(chunk)
            h, n = hashes(t), t.counts()
            ids = chunk.column("item").to_pylist()
            for size in sorted({min(span, int(x)) for x in n} - {0}):
                at, least = minima(h, t.row, size)
                mine = np.minimum(n[t.row[at]], span) == size
                at, least = at[mine], least[mine]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[r] for r in t.row[at]], pa.string()), pa.array(np.full(len(at), size, np.int32)),
                    pa.array(least.view(np.int64)), pa.array([digest(t, a, size) for a in at], pa.binary())], schema=schema)

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"), F.lit(0).cast("bigint").alias(X.ORDER))
    return rows.mapInArrow(cut, "item string, span int, print bigint, window binary").distinct()


def fingerprints(keyed: DataFrame, spans: list[int]) -> DataFrame:
    """``doc_order, doc_key, span, print, at, n`` of documents with those keys."""
    names = [X.ORDER, X.KEY, "span", "print", "at", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in X.chunks(batches):
            t = terms(chunk)
            h, n = hashes(t), t.counts()
            first = np.cumsum(n) - n
            order, key = chunk.column(X.ORDER).to_numpy(), chunk.column(X.KEY).to_numpy()
            for size in spans:
                of, least, at, many = prints(h, t.row, first, size)
                arrays = [order[of], key[of], np.full(len(of), size, np.int32), least.view(np.int64), at, many]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(arrays, kinds, strict=True)], names=names)

    return keyed.select("text", X.ORDER, X.KEY).mapInArrow(cut, f"{X.ORDER} bigint, {X.KEY} bigint, span int, print bigint, at bigint, n bigint")


def extended(asked: DataFrame) -> DataFrame:
    """``doc_id, doc_order, doc_key, n_words, windows`` (struct of first word, span,
    digest) for documents with the runs of windows (``runs``) to look at."""
    doc_type = asked.schema["doc_id"].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int64()), ("span", pa.int32()), ("window", pa.binary())]))
        for chunk in X.chunks(batches):
            t = terms(chunk)
            n = t.counts()
            first, runs = np.cumsum(n) - n, chunk.column("runs")
            found = [None] * chunk.num_rows
            for r in np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False)):
                places = sorted({(a, x["span"]) for x in runs[int(r)].as_py() for a in range(x["at"], x["at"] + x["n"])})
                found[r] = [{"at": a, "span": s, "window": digest(t, int(first[r]) + a, s)} for a, s in places]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column(X.ORDER), chunk.column(X.KEY), pa.array(n, pa.int64()),
                                              pa.array(found, kind)], names=["doc_id", X.ORDER, X.KEY, "n_words", "windows"])

    return asked.mapInArrow(read, f"doc_id {doc_type.simpleString()}, {X.ORDER} bigint, {X.KEY} bigint, n_words bigint, "
                                  "windows array<struct<at: bigint, span: int, window: binary>>")


def joined_spans(places: pd.Series) -> pd.Series:
    """Maximal runs of hit words."""
    out = []
    for row in places:
        runs: list[list[int]] = []
        for a, b in sorted((p["at"], p["at"] + p["span"] - 1) for p in row):
            if runs and a <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        out.append([{"first": a, "last": b} for a, b in runs])
    return pd.Series(out)


def overlaps(docs: DataFrame, items: DataFrame, span: int = SPAN, text: str = "text", doc_id: str = "doc_id",
             item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document ``doc_id, n_words, spans`` (first and last word of maximal
    hit runs, from 0) ``, items`` (ids as strings, sorted)."""
    text_batches(docs.sparkSession)
    keyed = X.keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "doc_id")
    known = staged(item_windows(items, span, item_id, item_text), "item-windows")
    spans = sorted(r.span for r in known.select("span").distinct().collect())  # at most ``span`` rows
    key = [X.ORDER, X.KEY]
    met = fingerprints(keyed, spans).join(known.select("span", "print").distinct(), ["span", "print"], "left_semi")
    runs = staged(met.groupBy(*key).agg(F.collect_set(F.struct("span", "at", "n")).alias("runs")), "shared-fingerprints")
    read = staged(extended(keyed.join(runs, key, "left")), "extended-windows")

    joined_runs = F.pandas_udf(joined_spans, SPANS)
    places = read.select(*key, F.explode("windows").alias("w")).select(*key, "w.*")
    hits = places.join(known.select("window").distinct(), "window", "left_semi")
    spans_of = hits.groupBy(*key).agg(F.collect_set(F.struct("at", "span")).alias("places")).select(*key, joined_runs("places").alias("spans"))
    named = known.filter(F.col("item").isNotNull()).select("window", "item").distinct()
    items_of = (hits.select(*key, "window").distinct().join(named, "window").select(*key, "item").distinct()
                .groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items")))
    joined = read.select("doc_id", *key, "n_words").join(spans_of, key, "left").join(items_of, key, "left")
    return joined.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
                         F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digests(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: words, hit words, items met and their hash, verdict."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    rows = overlaps(docs, items, **options).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                                                   F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)
