"""Exact removal of repeated word sequences by prefix-partitioned suffix trees.

Every window of ``threshold`` words is a suffix cut at that depth.  Suffixes are
dealt out by a prefix of variable length: the first word where that group fits
in memory, else the first 2, 4, 8 words, and at last all of them.  A counting pass
over the whole corpus gives the size of every prefix group (hashed into a fixed
number of cells, partial sums leave each task); groups that fit are put together
into bins of ``bin_windows`` suffixes.

A bin holds whole subtrees.  A subtree's internal nodes at depth ``threshold``
are the sets of suffixes with one path label down to there; an internal node has
two leaves or more, so these nodes are exactly the repeats, and neighbouring leaves
that repeat join into maximal repeats when the answers of a document meet (a
bin answers with one row for a group of documents, not one a document).  Only
that depth matters for the result, so a path label travels as its 64-bit hash and
shallower nodes are never built.

A group that cannot be split, one passage in very many documents, stays small:
each task first sends on only the earliest of equal windows in its chunk of text.

Defined results: a null or empty text has no words; texts shorter than the
window lose nothing; a null id is after all others; rows repeated with one id do
not remove each other's words; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm import exchange as X
from codecorpus.llm.common import fresh, partitions

THRESHOLD = 20
BIN_WINDOWS = 3_000_000
CELLS = 4096
#: Prefix lengths in words; the whole window comes after them.
LENGTHS = (1, 2, 4, 8)


def windows(batch: pa.RecordBatch, threshold: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each window's prefixes (LENGTHS, then all), row and first word."""
    buf, offsets = X.text_buffer(batch)
    whole = buf[offsets[0]:offsets[-1]].tobytes()
    cut = (offsets - offsets[0]).tolist()
    words = [whole[a:b].split() for a, b in zip(cut, cut[1:], strict=False)]
    n = np.array([len(w) for w in words], np.int64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(x) for w in words for x in w), np.uint64, int(n.sum()))
    starts = np.cumsum(n) - n
    counts = np.maximum(0, n - threshold + 1)
    row = np.repeat(np.arange(len(n)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = at + starts[row]
    # prefixes of doubling lengths, joined into the whole window
    spans = {1: h}
    size = 1
    while size * 2 <= threshold and len(h) >= size * 2:
        spans[size * 2] = X.joined_hash(spans[size][:len(spans[size]) - size], spans[size][size:])
        size *= 2
    if not len(place):
        return [np.zeros(0, np.uint64)] * (len(LENGTHS) + 1), row, at, place
    full, done = spans[size][place], size
    while done < threshold:
        while size > threshold - done:
            size //= 2
        full = X.joined_hash(full, spans[size][place + done])
        done += size
    return [*(spans[x][place] for x in LENGTHS), full], row, at, place


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return (X.mixed(h * X.K3) >> np.uint64(32)).astype(np.int64) % cells


def prefix_counts(docs: DataFrame, threshold: int, cells: int) -> np.ndarray:
    """Windows by (prefix length, cell): a table of fixed size."""
    schema = pa.schema([("level", pa.int32()), ("cell", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LENGTHS) + 1, cells), np.int64)
        for chunk in X.chunks(batches):
            for level, h in enumerate(windows(chunk, threshold)[0]):
                total[level] += np.bincount(_cell(h, cells), minlength=cells)
        level, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(cell, pa.int32()), pa.array(total[level, cell])], schema=schema)

    sums = docs.mapInArrow(count, "level int, cell int, n bigint").groupBy("level", "cell").agg(F.sum("n").alias("n"))
    out = np.zeros((len(LENGTHS) + 1, cells), np.int64)
    for r in sums.collect():  # at most (prefix lengths) x cells rows
        out[r.level, r.cell] = r.n
    return out


def bins_of(counts: np.ndarray, bin_windows: int) -> tuple[np.ndarray, int]:
    """Bin of each (prefix length, cell), -1 where the prefix must grow, and the
    number of bins."""
    out, filled, share = np.full(counts.shape, -1, np.int64), 0.0, 1.0
    total = max(1, counts[0].sum())
    for level, n in enumerate(counts):
        fits = n * share <= bin_windows / 2 if level < len(counts) - 1 else np.ones(len(n), bool)
        ends = filled + np.cumsum(np.where(fits, n * share, 0))
        out[level][fits] = (ends[fits] // bin_windows).astype(np.int64)
        filled = float(ends[-1])
        share = float(n[~fits].sum()) * share / total
    return out, int(filled // bin_windows) + 1


def located(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: int = THRESHOLD,
            bin_windows: int = BIN_WINDOWS, cells: int = CELLS) -> tuple[DataFrame, str]:
    """``docs`` and the packed first words of the windows to remove, and that
    column's name."""
    docs, back = X.apart(docs)
    keyed = X.keyed(docs, text, doc_id)
    narrow = keyed.select(F.col(text).alias("text"), X.ORDER, X.KEY)
    counts = prefix_counts(narrow, threshold, cells)
    table, bins = bins_of(counts, max(1, min(bin_windows, int(counts[0].sum()) // partitions(docs) + 1)))

    def pack(batch: pa.RecordBatch) -> Iterator[dict]:
        order, key = batch.column(X.ORDER).to_numpy(), batch.column(X.KEY).to_numpy()
        prefixes, row, at, _ = windows(batch, threshold)
        path = prefixes[-1]
        if not len(path):
            return
        gone = X.removed([path], order[row], key[row], at, within=True)
        if gone.any():
            yield from X.as_rows(X.answers(order[row[gone]], key[row[gone]], at[gone], None, 0), bins)
        left = np.flatnonzero(~gone)
        bin_ = np.full(len(left), -1, np.int64)
        for level, h in enumerate(prefixes):
            todo = np.flatnonzero(bin_ < 0)
            if len(todo):
                bin_[todo] = table[level][_cell(h[left[todo]], cells)]
        yield from X.packed(bin_, {"path": path[left]}, row[left], at[left], order, key)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        order, key, at, x = X.unpacked(frame, {"path": "<u8"})
        gone = X.removed([x["path"]], order, key, at, within=True)
        return X.answers(order[gone], key[gone], at[gone], None, 0)

    name = fresh(docs, "repeat_at")
    found = X.by_document(X.shuffled(narrow, pack, solve, ["path"], groups=bins), name)
    joined = keyed.join(found, [X.ORDER, X.KEY], "left")
    return joined.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in docs.columns], F.coalesce(F.col(name), F.lit(b"")).alias(name)), name


def kept_words(words: list[bytes], found: bytes, threshold: int) -> list[bytes]:
    at = np.frombuffer(found, "<u4").astype(np.int64)
    if not len(at):
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + threshold, -1)
    return [w for w, c in zip(words, np.cumsum(cover[:-1]).tolist(), strict=True) if not c]


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: int = THRESHOLD, **options) -> DataFrame:
    """Per document: words, words removed, hash of the kept words."""
    rows, name = located(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), threshold=threshold, **options)

    @F.pandas_udf("n_words bigint, n_removed bigint, kept_sha256 string")
    def udf(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for t, f in zip(texts, found, strict=True):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            kept = kept_words(words, f, threshold)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"]).astype({"kept_sha256": object})

    return rows.select("doc_id", udf("text", name).alias("d")).select("doc_id", "d.*")
