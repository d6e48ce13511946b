"""Ranked lexical search over a K2-treap of every shard of documents.

A shard is a run of documents of bounded text, and its grid has a row for each
term (by falling document count, rows ``2 ** STRETCH`` apart, so that a cell holds more
documents than terms and its maximum tells more) and a column for each document (by id).  A point
is a posting, its value the term's impact, the part of the score that needs no term
weight.  The grid is halved in both directions down to single points; each
quadtree cell stores its children's mask and, as the difference to its parent, the
largest impact in it; a cell of one point ends there and keeps the rest of its
coordinates.  Cells stand level by level, so a child's place is a count of mask bits.
The index covers every document and term, needs nothing of the queries but the
corpus's size, and can be stored and searched many times.

An item descends the rows of its terms together.  A range of documents holds one cell
for each term that may occur there; its bound is the weighted sum of the cells'
maxima.  The range of highest bound (then of smallest first document) is halved
next, and when it is a single document the bound is its score: nothing left can beat
it, ties included.  A step opens the best ranges of all items of a block at once.
Ranges below the ``k``-th score that earlier shards of the task gave are not opened.

Shards are few rows and much data, so they stay where they are stored: items come in
blocks of bounded size, a row each, and every block goes to every partition of the
index.  A task reads its shards one after the other; the ``k`` best of every item and
task are left, and of these the best by item.  Shards are compressed where they are
built and stored in row groups of about one shard, which bounds what a reader holds.

Defined results: null text has no terms; rows with one item id are one item; each
document row ranks for itself, a null id last among equal scores; terms that no
document holds, and scores of 0, give nothing; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm import exchange as X
from codecorpus.llm.common import staged, text_batches
from codecorpus.llm.terms import LOWER, PATTERN, UPPER, Terms, hashes, terms

K = 20
#: Bytes of text in a shard.
SHARD = 4 << 20
#: How an index is stored: a shard fills a row group, and the size is looked at after every row.
STORED = {"parquet.block.size": str(1 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
STRETCH = 6
#: One shard in so many is searched first, for the floors.
FIRST = 16
ITEMS, TERMS = 1024, 65_536
#: Ranges of an item that a step opens.
OPEN = 8
_BITS = np.array([bin(x).count("1") for x in range(16)], np.int64)


# ---- index -----------------------------------------------------------------

def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for chunk in X.chunks(batches):
            counts = terms(chunk).counts()
            n, total = n + int((counts > 0).sum()), total + int(counts.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    row = docs.mapInArrow(count, "n bigint, total bigint").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return row.n or 0, row.total or 0


def spread(x: np.ndarray) -> np.ndarray:
    """32 bits to the even places of 64."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def gathered(x: np.ndarray) -> np.ndarray:
    """The even places of 64 bits."""
    x = x & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | x >> np.uint64(shift)) & np.uint64(mask)
    return x.astype(np.int64)


def postings(t: Terms) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms by falling document count, these counts, and the points: term, row of
    the chunk, frequency."""
    _, head, index = np.unique(hashes(t), return_index=True, return_inverse=True)
    pair, tf = np.unique(index.astype(np.int64) * t.rows + t.row, return_counts=True)
    of, doc = pair // t.rows, pair % t.rows
    df = np.bincount(of, minlength=len(head))
    by = np.argsort(-df, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return [t.text(i) for i in head[by]], df[by], place[of], doc, tf


def quadtree(row: np.ndarray, col: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells level by level: child mask (0: one point), loss of the maximum
    against the parent (the root: the maximum), and for cells of one point the rest
    of its coordinates, interleaved."""
    code = spread(row) << np.uint64(1) | spread(col)
    by = np.argsort(code)
    code, value = code[by], value[by].astype(np.int64)
    top = np.array([value.max()])
    if len(code) == 1:
        return np.zeros(1, np.uint8), top, code
    group = np.zeros(len(code), np.int64)
    losses, masks, cells = [top], [], []
    for left in range(bits - 1, -1, -1):  # the points of cells with several, dealt to their quarters
        quarter = (code >> np.uint64(2 * left)) & np.uint64(3)
        new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (quarter[1:] != quarter[:-1])])
        parent, size = group[new], np.diff(np.r_[new, len(code)])
        masks.append(np.add.reduceat(1 << quarter[new].astype(np.int64), np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])))
        best = np.maximum.reduceat(value, new)
        losses.append(top[parent] - best)
        several = size > 1
        cells.append((several, code[new] & ((np.uint64(1) << np.uint64(2 * left)) - np.uint64(1))))
        live = np.repeat(several, size)
        group, code, value, top = np.repeat(np.cumsum(several) - 1, size)[live], code[live], value[live], best[several]
        if not len(code):
            break
    mask, rest = [masks[0]], []
    for (several, low), inner in zip(cells, [*masks[1:], np.zeros(0, np.int64)], strict=True):
        m = np.zeros(len(several), np.int64)
        m[several] = inner
        mask.append(m)
        rest.append(low[~several])
    return np.concatenate(mask).astype(np.uint8), np.concatenate(losses), np.concatenate(rest)


def packed(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, as many as the largest needs."""
    size = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return X.planes(x.astype(np.uint64))[:size * len(x)]


def unpacked(b: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros((8, n), np.uint8)
    out[:len(b) // n] = np.frombuffer(b, np.uint8).reshape(-1, n)
    return np.ascontiguousarray(out.T).view("<u8").ravel()


def squeezed(b: bytes) -> bytes:
    """Compressed, behind its length."""
    return len(b).to_bytes(8, "little") + pa.compress(b, "zstd", asbytes=True)


def expanded(b: pa.Buffer) -> bytes:
    return pa.decompress(b.slice(8), int.from_bytes(b.slice(0, 8).to_pybytes(), "little"), "zstd", asbytes=True)


def filled(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``limit`` bytes, so that short documents make no small shards."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


INDEX = "shard bigint, bits int, n_docs int, ids binary, known binary, words binary, dfs binary, masks binary, losses binary, rests binary"


def index(docs: DataFrame, size: tuple[int, int], text: str = "text", doc_id: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """A row for each shard; ``size``: what ``corpus_size`` gave."""
    n_docs, total = size
    names = [x.split(" ")[0] for x in INDEX.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for chunk in X.chunks(filled(batches, shard), shard):
            t = terms(chunk)
            if not len(t.start):
                continue
            known = chunk.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            ids = chunk.column(X.ORDER).to_numpy()
            by = np.lexsort((ids, ~known))  # columns by id, null ids last
            column = np.empty(len(by), np.int64)
            column[by] = np.arange(len(by))
            words, df, row, doc, tf = postings(t)
            m = 75 + 25 * t.counts().astype(np.int64) * n_docs // total
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
            bits = max(1, int(max((len(words) - 1) << STRETCH, len(ids) - 1)).bit_length())
            masks, losses, rests = quadtree(row << STRETCH, column[doc], impact, bits)
            data = (X.planes(ids[by]), known[by].tobytes(), b"\n".join(words), packed(df), masks.tobytes(), packed(losses), packed(rests))
            values = [number, bits, len(ids), *map(squeezed, data)]
            yield pa.RecordBatch.from_pydict(dict(zip(names, [[v] for v in values], strict=True)), schema=pa.schema(
                [(n, pa.int64() if n == "shard" else pa.int32() if n in ("bits", "n_docs") else pa.binary()) for n in names]))
            number += 1

    order = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(X.LAST)).alias(X.ORDER)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), order).mapInArrow(build, INDEX)


# ---- search ----------------------------------------------------------------

class Treap:
    """A shard, ready to descend."""

    def __init__(self, bits: int, masks: bytes, losses: bytes, rests: bytes):
        self.bits, self.mask = bits, np.frombuffer(masks, np.uint8)
        children = _BITS[self.mask]
        self.first = (1 + np.cumsum(children) - children).astype(np.int32)
        self.top = unpacked(losses, len(children)).astype(np.int32)
        parent = np.repeat(np.arange(len(children), dtype=np.int32), children)  # of cells 1, 2, ...
        a, b = 1, 1 + int(children[0])
        while a < b:  # a level at a time
            self.top[a:b] = self.top[parent[a - 1:b - 1]] - self.top[a:b]
            a, b = b, 1 + int(np.searchsorted(parent, b))
        self.row, self.col = np.zeros(len(children), np.int32), np.zeros(len(children), np.int32)
        alone = self.mask == 0
        rest = unpacked(rests, int(alone.sum()))
        self.row[alone], self.col[alone] = gathered(rest >> np.uint64(1)), gathered(rest)

    def halves(self, node: np.ndarray, row: np.ndarray, left: np.ndarray, right: int) -> tuple[np.ndarray, np.ndarray]:
        """For cells of ranges of ``2 ** left`` documents: which rows may occur in
        the first (0) or second half, and in which cell."""
        mask = self.mask[node]
        quarter = ((row >> (left - 1)) & 1) * 2 + right
        child = self.first[node] + _BITS[mask & ((1 << quarter) - 1)]
        alone = mask == 0
        child = np.where(alone, node, np.minimum(child, len(self.mask) - 1))
        there = np.where(alone, ((self.col[node] >> (left - 1)) & 1) == right, ((mask >> quarter) & 1) == 1)
        # a cell of one point, met now, must be of this row
        other = ~alone & (self.mask[child] == 0) & (self.row[child] != (row & ((1 << (left - 1)) - 1)))
        return there & ~other, child


def best_documents(treap: Treap, items: list[tuple[np.ndarray, np.ndarray]], k: int, floors: list[int]) -> list[list[tuple[int, int]]]:
    """Per item (rows, weights) its ``k`` best (score, column) of those scoring
    ``floor`` (1 at least) or more."""
    found: list[list[tuple[int, int]]] = [[] for _ in items]
    heaps: list[list] = []
    for rows, weights in items:
        node = np.zeros(len(rows), np.int64)
        live = (treap.mask[node] != 0) | (treap.row[node] == rows)
        bound = int(weights[live].sum()) * int(treap.top[0])
        heaps.append([(-bound, 0, treap.bits, rows[live], weights[live], node[live])] if bound else [])
    ready = [i for i, h in enumerate(heaps) if h]
    while ready:
        opened, still = [], []
        for i in ready:
            heap, n = heaps[i], 0
            while heap and n < OPEN and len(found[i]) < k and -heap[0][0] >= floors[i]:
                if heap[0][2]:
                    opened.append((i, *heapq.heappop(heap)[1:]))
                    n += 1
                elif n:
                    break
                else:
                    score, column, *_ = heapq.heappop(heap)
                    found[i].append((-score, column))
            if n:
                still.append(i)
        ready = still
        if not opened:
            break
        sizes = np.array([len(x[5]) for x in opened])
        row, weight, node = (np.concatenate([x[c] for x in opened]) for c in (3, 4, 5))
        left = np.repeat([x[2] for x in opened], sizes)
        ends, floor = np.cumsum(sizes), np.array([floors[x[0]] for x in opened])
        for right in (0, 1):
            there, child = treap.halves(node, row, left, right)
            gain = np.where(there, weight * treap.top[child], 0)
            bounds = np.diff(np.r_[0, np.cumsum(gain)[ends - 1]])
            kept = np.r_[0, np.cumsum(there)[ends - 1]]
            rows, weights, nodes = row[there], weight[there], child[there]
            settled = np.diff(np.r_[0, np.cumsum(there & (treap.mask[child] != 0))[ends - 1]]) == 0
            for e in np.flatnonzero(bounds >= floor):
                i, column, bits = opened[e][:3]
                part, start = slice(kept[e], kept[e + 1]), column + (right << (bits - 1))
                if settled[e]:  # single points only: their documents' scores
                    at, each = np.unique(treap.col[nodes[part]] & ((1 << (bits - 1)) - 1), return_inverse=True)
                    scores = np.zeros(len(at), np.int64)
                    np.add.at(scores, each, weights[part] * treap.top[nodes[part]])
                    for c, s in zip(at.tolist(), scores.tolist(), strict=True):
                        if s >= floors[i]:
                            heapq.heappush(heaps[i], (-s, start + c, 0))
                else:
                    heapq.heappush(heaps[i], (-int(bounds[e]), start, bits - 1, rows[part], weights[part], nodes[part]))
    return found


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, term, times``."""
    folded = F.translate(F.col(text), UPPER, LOWER)
    found = items.select(F.col(item_id).alias("item_id"), F.explode(F.regexp_extract_all(folded, F.lit(PATTERN), F.lit(0))).alias("term"))
    return found.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def met(asked: DataFrame, blocks: int, index: DataFrame) -> DataFrame:
    """Every shard beside every block (column ``block``, one row each)."""
    return index.crossJoin(asked.repartition(blocks).hint("shuffle_replicate_nl"))


def block_of(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def document_counts(asked: DataFrame, index: DataFrame) -> DataFrame:
    """``term, df`` over all shards for the column ``term`` of ``asked``."""
    blocks = max(1, -(-asked.count() // TERMS))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[int, dict[bytes, int]] = {}
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                if block not in counted:
                    counted[block] = {x.encode(): 0 for x in batch.column("asked")[i].as_py()}
                wanted = counted[block]
                held = expanded(batch.column("words")[i].as_buffer()).split(b"\n")
                for w, n in zip(held, unpacked(expanded(batch.column("dfs")[i].as_buffer()), len(held)).tolist(), strict=True):
                    if w in wanted:
                        wanted[w] += n
        for wanted in counted.values():
            found = {w: n for w, n in wanted.items() if n}
            yield pa.RecordBatch.from_pydict({"term": [w.decode() for w in found], "df": pa.array(found.values(), pa.int64())})

    packed = asked.groupBy(block_of("term", blocks).alias("block")).agg(F.collect_list("term").alias("asked"))
    return met(packed, blocks, index.select("words", "dfs")).mapInArrow(look, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def search(index: DataFrame, items: DataFrame, n_docs: int, k: int = K, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score`` from a stored index."""
    said = staged(item_terms(items, item_id, text), "item-terms")
    counts = document_counts(said.select("term").distinct(), index)
    weight = F.floor(1000 * F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df").cast("double") + 1))).cast("bigint")
    weighed = said.join(counts, "term").select("item_id", "term", (weight * F.col("times")).alias("weight")).filter("weight > 0")
    asked = weighed.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    asked = staged(asked.select("item_id", F.col("terms.term").alias("terms"), F.col("terms.weight").alias("weights")), "items")
    blocks = max(1, -(-asked.count() // ITEMS))
    asked = asked.withColumn("block", block_of("item_id", blocks))
    sample = index.filter(F.pmod(F.xxhash64("shard", F.lit(FIRST)), F.lit(FIRST)) == 0)
    first = best_of(scored(asked.withColumn("floor", F.lit(1).cast("bigint")), blocks, sample, k), k)
    # a null item id is an item
    floors = first.filter(F.col("rank") == k).select(F.col("item_id").alias("of"), F.col("score").alias("least"))
    floored = asked.join(floors, F.col("item_id").eqNullSafe(F.col("of")), "left").select(*asked.columns, F.coalesce("least", F.lit(1)).alias("floor"))
    return best_of(scored(staged(floored, "floored-items"), blocks, index, k), k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: What a search reads of a shard.
SEARCHED = ["bits", "ids", "known", "words", "masks", "losses", "rests"]


def scored(asked: DataFrame, blocks: int, index: DataFrame, k: int) -> DataFrame:
    """``item_id, doc_id, score``: the best of each task that reach the item's floor."""
    schema = f"item_id {asked.schema['item_id'].dataType.simpleString()}, doc_id bigint, score bigint"

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: dict[int, Block] = {}
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                if block not in here:
                    here[block] = Block(batch.column("asked")[i].values, k)
                here[block].descend(*(batch.column(c)[i] for c in SEARCHED))
        for x in here.values():
            yield x.result()

    packed = asked.groupBy("block").agg(F.collect_list(F.struct("item_id", "terms", "weights", "floor")).alias("asked"))
    return met(packed, blocks, index.select(*SEARCHED)).mapInArrow(descend, schema)


class Block:
    """A block's items and their best documents so far."""

    def __init__(self, asked: pa.StructArray, k: int):
        ids, terms, weights, floors = asked.flatten()
        # a copy: a view would hold the whole batch with its shards
        self.ids, self.k, self.least = ids.take(pa.array(range(len(ids)), pa.int64())), k, floors.to_pylist()
        self.asked = [([t.encode() for t in ts], np.asarray(ws, np.int64)) for ts, ws in zip(terms.to_pylist(), weights.to_pylist(), strict=True)]
        self.wanted = {t for ts, _ in self.asked for t in ts}
        self.best: list[list[tuple]] = [[] for _ in self.asked]

    def descend(self, bits: pa.Scalar, *data: pa.Scalar) -> None:
        ids, known, words, masks, losses, rests = (expanded(x.as_buffer()) for x in data)
        place = {w: i << STRETCH for i, w in enumerate(words.split(b"\n")) if w in self.wanted}
        here = [[j for j, t in enumerate(terms) if t in place] for terms, _ in self.asked]
        rows = [(np.array([place[terms[j]] for j in js], np.int64), weights[js]) for js, (terms, weights) in zip(here, self.asked, strict=True)]
        k = self.k
        floors = [max(low, y[k - 1][0]) if len(y) == k else low for low, y in zip(self.least, self.best, strict=True)]
        ids, known = X.unplanes(ids, "<i8"), np.frombuffer(known, bool)
        for i, found in enumerate(best_documents(Treap(bits.as_py(), masks, losses, rests), rows, k, floors)):
            found = [(score, bool(known[c]), int(ids[c])) for score, c in found]
            self.best[i] = sorted(self.best[i] + found, key=lambda y: (-y[0], not y[1], y[2]))[:k]

    def result(self) -> pa.RecordBatch:
        place = pa.array([i for i, found in enumerate(self.best) for _ in found], pa.int64())
        docs = pa.array([doc if known else None for x in self.best for _, known, doc in x], pa.int64())
        return pa.RecordBatch.from_arrays([self.ids.take(place), docs, pa.array([score for x in self.best for score, _, _ in x], pa.int64())], ["item_id", "doc_id", "score"])


def ranked(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
           item_text: str = "text", shard: int = SHARD) -> DataFrame:
    """The ``k`` best documents of each item."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # the counting pass needs no ids
    size = corpus_size(rows.select("text", F.lit(0).cast("bigint").alias(X.ORDER)))
    if not size[1]:
        return items.sparkSession.createDataFrame([], f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    return search(staged(index(rows, size, shard=shard), "treaps", STORED), items, size[0], k, item_id, item_text)
