"""Exact removal of repeated byte strings by a depth-limited radix sort.

A suffix matters only through its first ``threshold`` bytes, and equal groups of
a most-significant-digit sort cut at that depth are exactly the repeated windows.
Not every suffix need be sorted on its own: each window of ``threshold`` bytes
is dealt to its anchor, the place in it whose ``GRAM``-byte string has the smallest
hash (the leftmost of equals).  Equal windows have equal anchors at equal places,
so windows of different anchor strings never have to meet.  An anchor's windows
are neighbours; together they are one *stretch* of text.

1. Digit one is the anchor string: stretches go to bins by it, groups of a
   single document leave.  Digit two is the whole stretch: in a group of equal
   stretches all but those of the smallest id are covered whole.
2. Where an anchor has several different stretches (at the ends of copied
   passages) the first of each is taken apart: its windows, each with
   all bytes through the threshold, go to bins by their content; equal groups are
   the repeated windows, and those not of the smallest id are covered.

About one byte in fourteen is an anchor, so the first sort moves less than the
text itself.  Groups are compared by 64 bits of hashes or more inside their bins.

Defined results: a null or empty text has no bytes; texts shorter than the
threshold lose nothing; a null id is after all others; rows repeated with one id
do not remove each other; an empty table gives an empty result.
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
from codecorpus.llm.common import fresh, partitions, staged

THRESHOLD = 50
GRAM = 24
#: Bytes of text whose stretches make one bin.
BIN_BYTES = 24 << 20
PIECE = 2 << 20
RESOLVED, OPEN, WINDOW = 0, 1, 2


def _loads(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Little-endian 64-bit words at any places."""
    return np.ndarray((max(0, len(buf) - 7),), "<u8", buf.data, strides=(1,))[at]


def _grams(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place."""
    n = len(buf) - GRAM + 1
    u = np.ndarray((len(buf) - 7,), "<u8", buf.data, strides=(1,)).astype(np.uint64)
    h = X.joined_hash(u[:n], u[8:8 + n])
    return X.joined_hash(h, u[GRAM - 8:GRAM - 8 + n])


def stretches(buf: np.ndarray, starts: np.ndarray, counts: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """Of the windows that start at ``starts[i] .. + counts[i]``: first window and
    number of further windows of each stretch, hash of its anchor string, hash of
    the whole stretch, and its row ``i``."""
    none = np.zeros(0, np.int64)
    rows = np.flatnonzero(counts > 0)
    if not len(rows):
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    width = threshold - GRAM + 1
    h = _grams(buf)
    rank = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least, size = rank, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[:len(least) - (width - size)], least[width - size:])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window at each place
    first = np.zeros(len(anchor) + 1, np.int32)
    np.add.at(first, starts[rows], 1)
    np.add.at(first, starts[rows] + counts[rows], -1)
    valid = np.cumsum(first[:-1]) > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    new[starts[rows]] = True
    j = np.flatnonzero(new)
    owner = rows[np.searchsorted(starts[rows], j, side="right") - 1]
    end = np.minimum(np.r_[j[1:], len(anchor)], starts[owner] + counts[owner])
    span = end - j - 1
    a, late = anchor[j], threshold + span - GRAM
    whole = (span * 256 + (a - j)).astype(np.uint64)
    for part in range(0, threshold + width - 1, GRAM):  # parts of GRAM bytes, the last ones flush with the end
        whole = X.joined_hash(whole, h[j + np.minimum(part, late)])
    return j, span, h[a], whole, owner


def _segments(batch: pa.RecordBatch, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row starts, windows a row, place of byte 0) over pieces of bounded size."""
    buf, offsets = X.text_buffer(batch)
    counts = np.maximum(0, np.diff(offsets) - threshold + 1)
    base = int(offsets[0])
    if offsets[-1] - base <= 2 * PIECE:
        yield buf[base:offsets[-1]], offsets[:-1] - base, counts, offsets[:-1] - base
        return
    for i in np.flatnonzero(counts):
        for at in range(0, int(counts[i]), PIECE):
            n = min(PIECE, int(counts[i]) - at)
            own = np.zeros(len(counts), np.int64)
            own[i] = n
            begin = int(offsets[i]) + at
            yield buf[begin:begin + n + threshold - 1], np.zeros(len(counts), np.int64), own, np.full(len(counts), -at)


def _resolve(anchor, whole, order, key, at, span, last: bool):
    """(resolved mask, open mask): equal stretches after the smallest id, and the
    first of each stretch where an anchor string has several."""
    resolved = X.removed([anchor, whole], order, key, at, within=False)
    open_ = np.zeros(len(order), bool)
    if last:
        live, group = X.refined(np.flatnonzero(~resolved), np.zeros(int((~resolved).sum()), np.int64), anchor)
        if len(live):
            by = np.lexsort((order[live], group))
            live, group = live[by], group[by]
            head = np.r_[True, group[1:] != group[:-1]]
            number = np.cumsum(head) - 1
            docs = np.zeros(number[-1] + 1, np.int64)
            np.add.at(docs, number[1:], ~head[1:] & (order[live][1:] != order[live][:-1]))
            open_[live[docs[number] > 0]] = True
    return resolved, open_


def stretch_answers(docs: DataFrame, bins: int, threshold: int) -> DataFrame:
    def pack(batch: pa.RecordBatch) -> Iterator[dict]:
        order, key = batch.column(X.ORDER).to_numpy(), batch.column(X.KEY).to_numpy()
        for buf, starts, counts, base in _segments(batch, threshold):
            j, span, anchor, whole, row = stretches(buf, starts, counts, threshold)
            if not len(j):
                continue
            gone, _ = _resolve(anchor, whole, order[row], key[row], j, span, last=False)
            if gone.any():
                found = X.answers(order[row[gone]], key[row[gone]], j[gone] - base[row[gone]], span[gone], RESOLVED)
                yield from X.as_rows(found, bins)
            left = ~gone
            # 32 and 40 bits tell stretches apart: only those of one bin are ever compared
            arrays = {"anchor": (anchor[left] >> np.uint64(8)).astype(np.uint32), "whole": whole[left].astype(np.uint32),
                      "more": (whole[left] >> np.uint64(32)).astype(np.uint8), "span": span[left].astype(np.uint8)}
            yield from X.packed(((anchor[left] >> np.uint64(40)) % np.uint64(bins)).astype(np.int64), arrays, row[left],
                                (j - base[row])[left], order, key)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        order, key, at, x = X.unpacked(frame, {"anchor": "<u4", "whole": "<u4", "more": "u1", "span": "u1"})
        whole = x["whole"].astype(np.uint64) | x["more"].astype(np.uint64) << np.uint64(32)
        gone, open_ = _resolve(x["anchor"], whole, order, key, at, x["span"], last=True)
        return pd.concat([X.answers(order[m], key[m], at[m], x["span"][m], kind) for m, kind in ((gone, RESOLVED), (open_, OPEN))])

    return X.shuffled(docs, pack, solve, ["anchor", "whole", "more", "span"])


def window_answers(docs: DataFrame, bins: int, threshold: int) -> DataFrame:
    """``docs`` has the packed open stretches of each document in ``open_at`` and
    ``open_span`` (arrays of binary)."""
    def pack(batch: pa.RecordBatch) -> Iterator[dict]:
        order, key = batch.column(X.ORDER).to_numpy(), batch.column(X.KEY).to_numpy()
        buf, offsets = X.text_buffer(batch)
        at, row = [], []
        for i, (a, s) in enumerate(zip(batch.column("open_at").to_pylist(), batch.column("open_span").to_pylist(), strict=True)):
            j = np.frombuffer(b"".join(a), "<u4").astype(np.int64)
            n = np.frombuffer(b"".join(s), "u1").astype(np.int64) + 1
            places = np.repeat(j - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            at.append(np.unique(places))
            row.append(np.full(len(at[-1]), i))
        at, row = np.concatenate(at), np.concatenate(row)
        if not len(at):
            return
        place = at + offsets[:-1][row]
        h = X.mixed(_loads(buf, place) * X.K1)
        for shift in [*range(8, threshold - 8, 8), threshold - 8]:
            h = X.joined_hash(h, _loads(buf, place + shift))
        gone = X.removed([h], order[row], key[row], at, within=False)
        if gone.any():
            yield from X.as_rows(X.answers(order[row[gone]], key[row[gone]], at[gone], None, WINDOW), bins)
        left = ~gone
        yield from X.packed((h[left] % np.uint64(bins)).astype(np.int64), {"window": h[left]}, row[left], at[left], order, key)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        order, key, at, x = X.unpacked(frame, {"window": "<u8"})
        gone = X.removed([x["window"]], order, key, at, within=False)
        return X.answers(order[gone], key[gone], at[gone], None, WINDOW)

    return X.shuffled(docs, pack, solve, ["window"])


def _covered(n: int, whole_at, whole_span, window_at, threshold: int) -> np.ndarray:
    """Ends of the removed runs of a text of ``n`` bytes, as rows (start, end)."""
    a = np.frombuffer(b"".join(whole_at), "<u4").astype(np.int64)
    s = np.frombuffer(b"".join(whole_span), "u1").astype(np.int64)
    w = np.frombuffer(b"".join(window_at), "<u4").astype(np.int64)
    start, end = np.r_[a, w], np.r_[a + s, w] + threshold
    if not len(start):
        return np.zeros((0, 2), np.int64)
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    new = np.r_[True, start[1:] > end[:-1]]
    return np.stack([start[new], end[np.r_[new[1:], True]]], axis=1)


def located(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: int = THRESHOLD) -> tuple[DataFrame, list[str]]:
    """``docs`` and the packed places found: names of the three array columns."""
    docs, back = X.apart(docs)
    own = docs.columns
    keyed = X.keyed(docs, text, doc_id)
    size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))))).head()[0] or 0
    bins = max(partitions(docs), -(-size // BIN_BYTES))
    narrow = keyed.select(F.col(text).alias("text"), X.ORDER, X.KEY)
    found = staged(stretch_answers(narrow, bins, threshold), "suffix-stretches")
    gathered = lambda rows, *cs: rows.groupBy(X.ORDER, X.KEY).agg(*[F.collect_set(F.struct("at", "span")).alias(c) for c in cs])
    part = lambda c, f: F.transform(c, lambda x: x[f])
    open_ = gathered(found.filter(F.col("kind") == OPEN), "o").select(
        X.ORDER, X.KEY, part("o", "at").alias("open_at"), part("o", "span").alias("open_span"))
    # both joins read one shuffle of the documents: the same columns on the same key
    asked = keyed.join(open_, [X.ORDER, X.KEY]).select(F.col(text).alias("text"), *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)],
                                                       X.ORDER, X.KEY, "open_at", "open_span")
    windows = window_answers(asked, bins, threshold)
    both = found.filter(F.col("kind") == RESOLVED).unionByName(windows)
    names = [fresh(docs, n) for n in ("whole_at", "whole_span", "window_at")]
    of = lambda k: F.filter(F.col("all"), lambda x: x["kind"] == k)
    per_doc = both.groupBy(X.ORDER, X.KEY).agg(F.collect_set(F.struct("kind", "at", "span")).alias("all")).select(
        X.ORDER, X.KEY, part(of(RESOLVED), "at").alias(names[0]), part(of(RESOLVED), "span").alias(names[1]), part(of(WINDOW), "at").alias(names[2]))
    empty = F.array().cast("array<binary>")
    joined = keyed.join(per_doc, [X.ORDER, X.KEY], "left")
    return joined.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in own], *[F.coalesce(F.col(n), empty).alias(n) for n in names]), names


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """Per document: bytes, bytes removed, removed runs, hash of what is left."""
    rows, names = located(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), threshold=threshold)

    @F.pandas_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    def udf(texts: pd.Series, a: pd.Series, s: pd.Series, w: pd.Series) -> pd.DataFrame:
        out = []
        for t, *found in zip(texts, a, s, w, strict=True):
            data = (t or "").encode("utf-8", "surrogatepass")
            runs = _covered(len(data), *found, threshold)
            digest, at = hashlib.sha256(), 0
            for b, e in runs.tolist():
                digest.update(data[at:b])
                at = e
            digest.update(data[at:])
            out.append((len(data), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), digest.hexdigest()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"kept_sha256": object})

    return rows.select("doc_id", udf("text", *names).alias("d")).select("doc_id", "d.*")


def cleaned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text (a character of which
    only a part would stay goes too); other columns as they are."""
    rows, names = located(docs, text, doc_id, threshold)

    @F.pandas_udf("string")
    def udf(texts: pd.Series, a: pd.Series, s: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for t, *found in zip(texts, a, s, w, strict=True):
            if t is not None and any(len(x) for x in found):
                data, kept, at = t.encode("utf-8", "surrogatepass"), [], 0
                for b, e in _covered(len(data), *found, threshold).tolist():
                    kept.append(data[at:b])
                    at = e
                t = b"".join([*kept, data[at:]]).decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    return rows.select(*[udf(F.col(text), *names).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
