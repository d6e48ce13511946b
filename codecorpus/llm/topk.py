"""Exact top-k inner products by tiled matrix products and a merging tree.

Components become whole numbers, ``floor(scale * x)``.  Queries form blocks, all
vectors form shards, both by a hash of the id and of bounded size; a tile is
one block against one shard, computed as one matrix product in a task that holds
nothing else.  Of each tile only the ``k`` best of every query leave.  These
lists merge in a tree: ``fan_in`` neighbouring shards at a time, ``k`` entries a
query going on from each node, so no task gathers more than ``fan_in * k``
entries for a query however many shards there are.

Products are exact: as doubles while every partial sum stays below 2**53, else
as Python integers (a score outside 64 bits is set to the nearest such value).

Defined results: vectors that are null or hold a null or a non-finite component
take no part; missing components of a shorter vector count as 0; a null id is no
query, and comes last among equal scores; all rows of a query's own id are its
own and never its candidates; rows repeated with one id and vector are one query,
and as many candidates as there are rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import partitions, staged

SCALE = 256
QUERY_BLOCK = 4096
SHARD = 32_768
FAN_IN = 16
LAST = (1 << 63) - 1


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id`` (null: the largest long), ``vec``, packed doubles, and ``n``, rows
    that have both."""
    fine = F.col(embedding).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(fine).select(F.coalesce(F.col(vec_id).cast("bigint"), F.lit(LAST)).alias("vec_id"), F.col(embedding).alias("embedding"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "vec": [np.floor(np.asarray(e, np.float64) * scale).tobytes() for e in b["embedding"]]})

    return rows.mapInPandas(pack, "vec_id bigint, vec binary").groupBy("vec_id", "vec").agg(F.count(F.lit(1)).alias("n"))


def _matrix(vecs: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vecs), dim))
    for i, v in enumerate(vecs):
        row = np.frombuffer(v)
        out[i, :len(row)] = row
    return out


def tile(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best rows of the shard for each query of the block."""
    rows = rows.sort_values("vec_id", kind="stable")
    dim = max(len(v) // 8 for part in (queries["vec"], rows["vec"]) for v in part)
    q, c = _matrix(queries["vec"], dim), _matrix(rows["vec"], dim)
    ids, n, copies = rows["vec_id"].to_numpy(), len(rows), np.minimum(rows["n"].to_numpy(), k)
    bound = dim * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0))
    out = []
    for a in range(0, len(q), 256):  # a strip of the tile at a time
        block, own = q[a:a + 256], queries["vec_id"].to_numpy()[a:a + 256]
        if bound < 2**53 and bound * 2 * n < 2**62:
            ranked = (block @ c.T).astype(np.int64) * n + (n - 1 - np.arange(n))  # score, then smaller id
        else:
            exact = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
            held = np.frompyfunc(lambda x: max(-LAST - 1, min(LAST, x)), 1, 1)
            ranked = held(exact(block) @ exact(c).T) * n + (n - 1 - np.arange(n)).astype(object)
        for i, row in enumerate(ranked):
            live = np.flatnonzero(ids != own[i])
            if len(live) > k and row.dtype != object:
                live = live[np.argpartition(row[live], len(live) - k)[-k:]]
            elif len(live) > k:
                live = np.array(sorted(live, key=lambda j: -row[j])[:k])
            out += [x for j in live for x in [(own[i], ids[j], int(row[j]) // n)] * copies[j]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def best(k: int) -> Column:
    return F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k)


def search(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE,
           query_block: int = QUERY_BLOCK, shard: int = SHARD, fan_in: int = FAN_IN) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id meets the
    condition ``queries`` (over the column ``vec_id``)."""
    rows = staged(whole_numbers(vectors, vec_id, embedding, scale), "vectors")  # counted twice, read by both sides
    asked = rows.filter(queries & (F.col("vec_id") != LAST))
    n_rows, n_asked = rows.count(), asked.count()
    blocks, shards = max(1, -(-n_asked // query_block)), max(partitions(vectors), -(-n_rows // shard))
    # by id and vector: one id, or none, may stand at many rows
    cell = lambda n, seed: F.pmod(F.xxhash64("vec_id", "vec", F.lit(seed)), F.lit(n)).cast("int")
    left = asked.select("vec_id", "vec", cell(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = rows.select("vec_id", "vec", "n", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), cell(shards, 2).alias("shard"))

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "shard": []})
        return tile(a, b, k).assign(shard=int(b["shard"].iat[0]))

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(
        product, "query_id bigint, vec_id bigint, score decimal(20,0), shard int".replace("decimal(20,0)", "bigint"))
    # -1 - score falls as the score rises and cannot overflow
    lists = found.groupBy("query_id", "shard").agg(F.collect_list(F.struct((-1 - F.col("score")).alias("worse"), "vec_id")).alias("found"))
    while shards > 1:
        lists = lists.groupBy("query_id", F.floor(F.col("shard") / fan_in).alias("shard")).agg(best(k).alias("found"))
        shards = -(-shards // fan_in)
    ranked = lists.select("query_id", F.posexplode(F.slice(F.sort_array("found"), 1, k)).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.nullif(F.col("x.vec_id"), F.lit(LAST)).alias("vec_id"),
                         (-1 - F.col("x.worse")).alias("score"))
