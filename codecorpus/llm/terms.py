"""Terms of texts as arrays: runs of ASCII letters, digits and all characters
beyond ASCII, with A-Z lower-cased (shared by the lexical operators)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from codecorpus.llm import exchange as X

#: The same terms as a pattern over a text whose A-Z are lower-cased.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INSIDE = np.ones(256, bool)
_INSIDE[:48] = _INSIDE[58:97] = _INSIDE[123:128] = False
_BASE = 0x9E3779B97F4A7C55
#: Terms hashed at a time, which bounds the sums over their bytes.
_RUN = 1 << 16


class Terms(NamedTuple):
    data: np.ndarray  # folded bytes of all rows
    start: np.ndarray  # first byte of each term
    end: np.ndarray
    row: np.ndarray
    rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def terms(batch: pa.RecordBatch, column: str = "text") -> Terms:
    buf, offsets = X.text_buffer(batch, column)
    cuts = offsets - offsets[0]
    data = _FOLD[buf[offsets[0]:offsets[-1]]]
    inside = _INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return Terms(data, start, np.flatnonzero(last) + 1, np.searchsorted(cuts, start, "right") - 1, batch.num_rows)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def hashes(t: Terms) -> np.ndarray:
    """64-bit hashes: a term's polynomial is a difference of running sums."""
    out = np.empty(len(t.start), np.uint64)
    up = down = np.zeros(0, np.uint64)
    for a in range(0, len(out), _RUN):
        start, end = t.start[a:a + _RUN], t.end[a:a + _RUN]
        low, size = start[0], int(end[-1] - start[0])
        if size > len(up):
            up, down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((t.data[low:low + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        out[a:a + _RUN] = (sums[end - low] - sums[start - low]) * down[start - low] + (end - start).astype(np.uint64)
    return X.mixed(out * X.K1)
