"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 values of
its word shingles.  Bit ``i`` carries the code ``1 + i mod 15`` of four bits; the
mask of ``v`` (1 to 15) holds the bits whose code has an odd number of ones in
common with ``v``.  For any three differing bits some ``v`` is orthogonal to all
three codes, so the pair agrees on that mask: each pair within the radius of 3
meets in one of 15 tables, none is missed (``radius + 1`` code bits in general).

Equal fingerprints are one row before the tables are built, so copies cost
nothing.  A table's bucket with more than ``bucket_limit`` fingerprints is
divided by further bits: its free bits form ``radius + 1`` chunks, of which
a close pair shares one unchanged, so the division loses nothing either.  It
repeats until every bucket is small; inside a bucket distances are computed in one
array and only a spanning forest of the links leaves (less than one edge a
fingerprint, never all pairs).  Components come from large-star and small-star
rounds over staged edge tables; nothing is collected.

Defined results: null and empty texts have fingerprint zero and link like any
other; a null id takes part, but names a component only if all its ids are null;
repeated rows share a component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import fresh, partitions, staged

SHINGLE = 3
RADIUS = 3
SEED = 42
BUCKET_LIMIT = 2048


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of one text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < shingle:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(h), 1 << 16):
        part = h[start:start + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    @F.pandas_udf("bigint")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle, seed) for t in texts], dtype="int64")

    return udf(text)


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Masks of which at least one leaves out any given ``radius`` bits."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if ((1 + i % n) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _divided(mask: int, radius: int) -> list[int]:
    """The mask with each of ``radius + 1`` chunks of its free bits added."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[c::radius + 1]) for c in range(radius + 1)]


def _tables(fps: DataFrame, masks: list[int]) -> DataFrame:
    pairs = F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")
    return fps.select("fp", pairs).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def _forest(radius: int):
    """Edges of a spanning forest of each bucket; buckets arrive one after
    another, sorted, possibly over several batches."""
    def links(fps: np.ndarray) -> Iterator[tuple[int, int]]:
        rest = fps
        while len(rest) > 1:
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                near, grown = np.full(len(rest), -1), []
                for k, x in enumerate(front):
                    hit = (np.bitwise_count(rest ^ x) <= radius) & (near < 0)
                    near[hit] = k
                found = near >= 0
                yield from zip(front[near[found]].tolist(), rest[found].tolist(), strict=True)
                grown, rest = rest[found], rest[~found]
                front = grown

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        def flush(frame: pd.DataFrame) -> pd.DataFrame:
            fp = frame["fp"].to_numpy().view(np.uint64)
            cut = np.flatnonzero((np.diff(frame["mask"].to_numpy()) != 0) | (np.diff(frame["key"].to_numpy()) != 0)) + 1
            out = [e for part in np.split(fp, cut) if len(part) > 1 for e in links(part)]
            return pd.DataFrame(np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            frame = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            last = (frame["mask"] == frame["mask"].iat[-1]) & (frame["key"] == frame["key"].iat[-1])
            kept, done = frame[last], frame[~last]
            if len(done):
                yield flush(done)
        if kept is not None:
            yield flush(kept)

    return edges


def links(fps: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints ``fp`` whose closure is
    that of all pairs within ``radius`` bits."""
    masks = covering_masks(radius)
    todo, found = _tables(fps, masks), None
    while True:
        sizes = todo.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        # a bucket whose mask leaves few free bits cannot hold more than their values
        small = todo.join(sizes.filter(F.col("n") <= bucket_limit).select("mask", "key"), ["mask", "key"], "left_semi")
        grouped = small.repartition(partitions(fps), "mask", "key").sortWithinPartitions("mask", "key", "fp")
        edges = grouped.mapInPandas(_forest(radius), "a bigint, b bigint")
        found = edges if found is None else found.unionByName(edges)
        big = staged(todo.join(sizes.filter(F.col("n") > bucket_limit).select("mask", "key"), ["mask", "key"], "left_semi"), "simhash-big")
        if big.isEmpty():
            return found.distinct()
        split = {m: _divided(m, radius) for m in masks}
        masks = sorted({x for xs in split.values() for x in xs})
        steps = F.create_map(*[x for m, xs in split.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in xs]))])
        todo = big.select("fp", F.explode(F.element_at(steps, F.col("mask"))).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def roots(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges``: root is the smallest node of
    its component.  Rounds of large-star and small-star until nothing changes."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.filter("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        near = both.join(least, "a")
        if large:
            return near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    state, mark = staged(edges.filter("a <> b"), "simhash-edges"), None
    while True:
        state = staged(star(star(state, True), False), "simhash-stars")
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if now == mark:
            break
        mark = now
    leaves = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(leaves.select(F.col("root").alias("node"), "root").distinct())


def components(fingerprints: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``fp, first_id, component_id, root`` for each distinct fingerprint of the
    rows ``doc_id, fp``; ``first_id``: smallest id that has this fingerprint;
    ``root``: smallest fingerprint of the component."""
    distinct = staged(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    root = staged(roots(links(distinct.select("fp"), radius, bucket_limit)), "simhash-roots")
    rooted = distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(named, "root").select("fp", "first_id", "component_id", "root")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                    radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` per row."""
    rows = staged(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")), "simhash-rows")
    comps = components(rows, radius, bucket_limit).select("fp", "component_id")
    return rows.join(comps, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row of each component, own columns: of its smallest id, then smallest
    fingerprint, then any of the rows repeated with both (only null ids: smallest
    fingerprint).  The join key holds the id, so a group of copies is spread over all
    tasks."""
    rows = staged(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")), "simhash-rows")
    first = components(rows, radius, bucket_limit).filter(F.col("first_id").eqNullSafe(F.col("component_id")))
    fp = fresh(docs, "simhash_fp")
    marked = docs.withColumn(fp, fingerprint(F.col(text), shingle))
    kept_fp, kept_id = fresh(marked, "kept_fp"), fresh(marked, "kept_id")
    keep = first.groupBy("root").agg(F.min("fp").alias(kept_fp), F.first("component_id").alias(kept_id)).drop("root")
    kept = marked.join(keep, (F.col(fp) == F.col(kept_fp)) & F.col(doc_id).eqNullSafe(F.col(kept_id)), "left_semi")
    return kept.dropDuplicates([fp, doc_id]).drop(fp)
