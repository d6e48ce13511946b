"""Packed exchange of text windows between tasks (shared by the two exact
repeat finders).

Windows are far more numerous than documents, so they travel packed: a task
cuts its documents into chunks and sends one row per chunk and bin, holding the
windows' hashes, their places as byte planes of gaps (small numbers shrink when
the shuffle compresses them) and the documents concerned.  A reducer answers
with rows per document; the answers join the documents again by key.

A document is known by its order (its id; a null id comes after all) and a hash
of id and text, so rows repeated with one id and text share all answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import fresh

#: Bytes of text that a task packs at a time.
CHUNK = 2 << 20
LAST = (1 << 63) - 1
K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
ORDER, KEY = "doc_order", "doc_key"
ANSWER = f"{ORDER} bigint, {KEY} bigint, kind int, at binary, span binary"
GROUPED = "part bigint, orders binary, keys binary, sizes binary, at binary"


def mixed(a: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, in place."""
    a ^= a >> np.uint64(32)
    a *= K2
    a ^= a >> np.uint64(29)
    return a


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a * K1) + b)


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of the keys' names renamed, and the way back."""
    there = {c: fresh(docs, f"own_{c}") for c in docs.columns if c.lower() in (ORDER, KEY)}
    return docs.withColumnsRenamed(there), {new: old for old, new in there.items()}


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``docs`` with the two columns that name a document in answers."""
    order = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST))
    return docs.select("*", order.alias(ORDER), F.xxhash64(F.col(doc_id), F.col(text)).alias(KEY))


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(b: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text (one row at least), by order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_buffer(batch)[1]
        piece = (offsets[1:] - offsets[0]) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            order = part.column(ORDER).to_numpy()
            yield part if (np.diff(order) >= 0).all() else part.take(pa.array(np.argsort(order, kind="stable")))


def text_buffer(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the column and the offsets of its rows (null: empty)."""
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], "<i8", col.offset + len(col) + 1)[col.offset:]
    data = col.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def removed(hashes: list[np.ndarray], order: np.ndarray, key: np.ndarray, at: np.ndarray, within: bool) -> np.ndarray:
    """Which windows also start in a document of smaller order (``within``: or
    earlier in their own).  Windows of one hash are one group; groups are
    refined hash by hash, and a window alone in its group is dropped at once."""
    live, group = np.arange(len(order)), np.zeros(len(order), np.int64)
    for h in hashes:
        live, group = refined(live, group, h)
    out = np.zeros(len(order), bool)
    if len(live):
        by = np.lexsort((at[live], key[live], order[live], group))
        live, group = live[by], group[by]
        head = np.r_[True, group[1:] != group[:-1]]
        first = order[live][head][np.cumsum(head) - 1]
        hit = order[live] > first
        if within:
            again = (key[live][1:] == key[live][:-1]) & (at[live][1:] != at[live][:-1]) & ~head[1:]
            hit[1:] |= again & (order[live][1:] == order[live][:-1])
        out[live[hit]] = True
    return out


def refined(live: np.ndarray, group: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of a most-significant-digit sort: members of each group ordered
    by their next digit; groups of one member leave."""
    d = digit[live]
    by = np.argsort(d) if not group.any() else np.lexsort((d, group))
    d, g = d[by], group[by]
    new = np.r_[True, (d[1:] != d[:-1]) | (g[1:] != g[:-1])] if len(d) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    many = np.bincount(number)[number] > 1 if len(d) else new
    return live[by][many], number[many]


def packed(bin_of: np.ndarray, arrays: dict[str, np.ndarray], doc: np.ndarray, at: np.ndarray,
           order: np.ndarray, key: np.ndarray) -> Iterator[dict]:
    """Rows for the shuffle: per bin the arrays of its windows, by place."""
    by = np.argsort(bin_of, kind="stable")
    cuts = np.flatnonzero(np.diff(bin_of[by])) + 1
    for part in np.split(by, cuts):
        if not len(part):
            continue
        docs, index = np.unique(doc[part], return_inverse=True)
        step = np.diff(index, prepend=-1)
        gap = np.where(step > 0, at[part], np.diff(at[part], prepend=0))  # from the document's start, then from the last
        yield {"bin": int(bin_of[part[0]]), "kind": -1, "at": planes(gap.astype(np.uint32)), "doc": planes(step.astype(np.uint32)),
               "orders": planes(order[docs]), "keys": key[docs].tobytes(),
               **{name: x[part].tobytes() for name, x in arrays.items()}}


def answers(order: np.ndarray, key: np.ndarray, at: np.ndarray, span: np.ndarray | None, kind: int) -> pd.DataFrame:
    """One row per document with the places found in it."""
    by = np.lexsort((at, key, order))
    order, key, at = order[by], key[by], at[by].astype(np.uint32)
    cuts = np.flatnonzero((np.diff(order) != 0) | (np.diff(key) != 0)) + 1
    heads = np.r_[0, cuts] if len(order) else cuts
    spans = [b""] * len(heads) if span is None else [x.tobytes() for x in np.split(span[by].astype(np.uint8), cuts)]
    return pd.DataFrame({ORDER: order[heads], KEY: key[heads], "kind": np.full(len(heads), kind, np.int32),
                         "at": [x.tobytes() for x in np.split(at, cuts)][:len(heads)], "span": spans[:len(heads)]})


def unpacked(frame: pd.DataFrame, names: dict[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """order, key, place and the named arrays of all windows of a bin."""
    order, key, at, rest = [], [], [], {n: [] for n in names}
    for row in frame.itertuples(index=False):
        step, gap = unplanes(row.doc, "<u4").astype(np.int64), unplanes(row.at, "<u4").astype(np.int64)
        doc, sums, new = np.cumsum(step) - 1, np.cumsum(gap), np.flatnonzero(step)
        order.append(unplanes(row.orders, "<i8")[doc])
        key.append(np.frombuffer(row.keys, "<i8")[doc])
        at.append(sums - (sums[new] - gap[new])[doc])
        for n, kind in names.items():
            rest[n].append(np.frombuffer(getattr(row, n), kind))
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return cat(order, "<i8"), cat(key, "<i8"), cat(at, "<i8"), {n: cat(xs, names[n]) for n, xs in rest.items()}


def packed_schema(names: list[str]) -> str:
    return ", ".join(["bin bigint", "kind int", "at binary", "doc binary", "orders binary", "keys binary", "span binary",
                      *(f"{n} binary" for n in names if n != "span")])


def shuffled(docs: DataFrame, pack: Callable, solve: Callable, names: list[str], groups: int = 0) -> DataFrame:
    """Packed windows to their bins, answers back.  ``pack`` maps record batches
    to rows; rows of ``kind >= 0`` are answers already and pass through;
    ``solve`` turns a bin's windows into answers; with ``groups`` these leave as one
    row for each of so many groups of documents (see ``by_document``)."""
    fields = [x.split(" ")[0] for x in packed_schema(names).split(", ")]
    kinds = {"bin": pa.int64(), "kind": pa.int32()}
    schema = pa.schema([(f, kinds.get(f, pa.binary())) for f in fields])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            rows = list(pack(chunk))
            if rows:
                yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in fields} for r in rows], schema=schema)

    def reduced(frame: pd.DataFrame) -> pd.DataFrame:
        known = frame["kind"] >= 0
        parts = [solve(frame[~known])]
        for row in frame[known].itertuples(index=False):
            parts.append(pd.DataFrame({ORDER: np.frombuffer(row.orders, "<i8"), KEY: np.frombuffer(row.keys, "<i8"),
                                       "kind": np.int32(row.kind), "at": [row.at], "span": [row.span or b""]}))
        out = pd.concat(parts, ignore_index=True)
        return grouped(out, groups) if groups else out

    return docs.mapInArrow(mapped, packed_schema(names)).groupBy("bin").applyInPandas(reduced, GROUPED if groups else ANSWER)


def grouped(found: pd.DataFrame, groups: int) -> pd.DataFrame:
    """Answers packed by group of documents (a hash of the document's key):
    orders, keys, number of places, and the places one document after another."""
    of = (found[KEY].to_numpy(np.int64).view(np.uint64) % np.uint64(groups)).astype(np.int64)
    out = []
    for group, part in found.groupby(of):
        sizes = np.array([len(x) // 4 for x in part["at"]], np.int64)
        out.append((int(group), part[ORDER].to_numpy("<i8").tobytes(), part[KEY].to_numpy("<i8").tobytes(), sizes.tobytes(), b"".join(part["at"])))
    return pd.DataFrame(out, columns=["part", "orders", "keys", "sizes", "at"])


def by_document(packed_answers: DataFrame, name: str) -> DataFrame:
    """One row per document of grouped answers: its places, sorted, each once."""
    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        read = lambda c, kind: np.frombuffer(b"".join(frame[c]), kind)
        sizes = read("sizes", "<i8")
        order, key, at = np.repeat(read("orders", "<i8"), sizes), np.repeat(read("keys", "<i8"), sizes), read("at", "<u4")
        by = np.lexsort((at, key, order))
        order, key, at = order[by], key[by], at[by]
        first = np.r_[True, (np.diff(order) != 0) | (np.diff(key) != 0) | (np.diff(at.astype(np.int64)) != 0)][:len(at)]
        out = answers(order[first], key[first], at[first], None, 0)
        return out[[ORDER, KEY, "at"]].rename(columns={"at": name})

    return packed_answers.groupBy("part").applyInPandas(merged, f"{ORDER} bigint, {KEY} bigint, `{name}` binary")


def as_rows(found: pd.DataFrame, bins: int) -> Iterator[dict]:
    """Answers known before the shuffle, as rows that pass through it."""
    for r in found.itertuples(index=False):
        order = np.int64(r.doc_order)
        yield {"bin": int(order) % bins, "kind": int(r.kind), "at": r.at, "span": r.span,
               "orders": order.tobytes(), "keys": np.int64(r.doc_key).tobytes()}
