"""Prefix trie of conversations, its subtree sums by the Euler-tour technique.

Turns are numbered by a block scan, so a conversation of any length is spread
over tasks.  A prefix is known by the exclusive or of 128 hash bits of each of its
turns (place, role, SHA-256 of the text), again a block scan; rows with equal
prefixes group into nodes.  A node's name is (smallest member, depth): a member
has one node at each depth, so names are unique and no node is a hot key.

The tour has an arc into and an arc out of every node.  An arc's successor follows
from the node's first child, its next sibling (children by smallest member, found
by a block scan) and its parent.  The list is ranked in three steps:

1. arcs are range-partitioned by name, where neighbours of the tour mostly lie
   together; a task contracts each chain inside its partition to one segment;
2. while more than ``base`` segments are left, each with a coin of heads absorbs
   its successor if that has tails (a quarter of the list a round, one join);
3. the rest, at most ``base`` rows, is ranked by one task, and the positions go
   back through the rounds to the segments and arcs.

Ranks carry the running numbers of childless nodes and of saved tokens, so the sum
over a subtree is a difference between its arc out and its arc in.

Ids of the conversations that end at a node, which may be most of all, are gathered
in blocks of 65,536 ids and hashed block after block as a stream.

Defined results: rows with a null id belong to no conversation; a null role or text is
empty; turns of one number stand by role, then by hash of the text; repeated rows
are turns of their own; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import partitions, staged
from codecorpus.operators.scan import prefix_scan, row_index

#: Conversations c share turns with c - c % SHARED; they take crc32(c) % LIMIT of them.
SHARED, LIMIT = 5, 9
ID_BLOCK = 1 << 16
BASE = 4096
ARCS = 400_000
HALVES = ("a", "b")
SUMS = ("rank", "leaves", "saved")


def taken_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % LIMIT


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, at`` (from 1)``, role, text_hash, n_bytes``."""
    said = F.coalesce(F.col(text), F.lit(""))
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.sha2(said.cast("binary"), 256).alias("text_hash"), F.octet_length(said).cast("bigint").alias("n_bytes"))
    return row_index(rows, ["turn", "role", "text_hash"], ["conv_id"], name="at").drop("turn")


def rebuilt(numbered: DataFrame) -> DataFrame:
    """``conv_id, depth, role, text_hash, n_bytes`` of every turn of the rebuilt
    conversations, and a row of depth 0 for each; ``n_turns`` on all of them."""
    h, base = taken_turns(F.col("conv_id")), F.col("conv_id") - F.col("conv_id") % SHARED
    own = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    first = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = own.select("conv_id", "n", base.alias("base"), h.alias("h")).join(first, "base", "left")
    shared = F.least("h", F.coalesce("n_base", F.lit(0).cast("bigint")))
    convs = convs.select("conv_id", "base", "h", shared.alias("shared"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    columns = ["conv_id", "depth", "role", "text_hash", "n_bytes", "n_turns"]
    root = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit("").alias("role"), F.lit("").alias("text_hash"),
                        F.lit(0).cast("bigint").alias("n_bytes"), "n_turns")
    heads = numbered.filter((F.col("at") < LIMIT) & (F.col("conv_id") % SHARED == 0)).withColumnRenamed("conv_id", "base")
    head = convs.join(heads, "base").filter(F.col("at") <= F.col("h")).withColumnRenamed("at", "depth").select(columns)
    tail = (numbered.join(convs, "conv_id").filter(F.col("at") > F.col("h"))
            .withColumn("depth", F.col("shared") + F.col("at") - F.col("h")).select(columns))
    return root.unionByName(head).unionByName(tail)


def members(turn_rows: DataFrame) -> DataFrame:
    """Each conversation at each depth: prefix (``a, b``), the one before it
    (``up_a, up_b``), bytes of the last text, whether it ends here."""
    own = {x: F.xxhash64(F.lit(x), "depth", "role", "text_hash") for x in HALVES}
    scanned = prefix_scan(turn_rows, ["depth"], {x: ("xor", own[x]) for x in HALVES}, ["conv_id"])
    return scanned.select("conv_id", "depth", *HALVES, *[F.col(x).bitwiseXOR(own[x]).alias(f"up_{x}") for x in HALVES],
                          "n_bytes", (F.col("depth") == F.col("n_turns")).alias("ends"))


def id_hashes(ends: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256``: hash of the sorted ids of each prefix."""
    block = F.floor(F.col("conv_id") / F.lit(ID_BLOCK)).cast("bigint")
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    key = ["depth", *HALVES]
    blocks = ends.groupBy(*key, block.alias("block")).agg(text.alias("ids"))
    ordered = blocks.repartition(partitions(ends), *key).sortWithinPartitions(*key, "block")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, hashlib.sha256(), []
        for batch in batches:
            for depth, a, b, _, ids in batch.itertuples(index=False):
                if (depth, a, b) == now:
                    state.update(b",")
                else:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (depth, a, b), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=[*key, "ends_sha256"])
            out = []
        if now:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*key, "ends_sha256"])

    return ordered.select(*key, "block", "ids").mapInPandas(stream, "depth bigint, a bigint, b bigint, ends_sha256 string")


def nodes(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, saved, ends_sha256,
    n_children, first_child``."""
    key = ["depth", *HALVES]
    found = rows.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
                                   *[F.max(f"up_{x}").alias(f"up_{x}") for x in HALVES])
    found = staged(found, "trie-nodes")
    above = found.select((F.col("depth") + 1).alias("depth"), *[F.col(x).alias(f"up_{x}") for x in HALVES], F.col("conv_id").alias("parent_conv_id"))
    linked = found.join(above, ["depth", *[f"up_{x}" for x in HALVES]], "left").join(id_hashes(rows.filter("ends")), key, "left")
    linked = staged(linked.select("conv_id", "depth", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
                                  F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")), "trie-linked")
    below = linked.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("first_child"))
    return linked.join(below, ["conv_id", "depth"], "left").fillna(0, ["n_children"])


def arcs(trie: DataFrame) -> DataFrame:
    """The tour: per node the successors of its arc in and its arc out.  An arc
    is (smallest member, 2 * depth) in and (smallest member, 2 * depth + 1) out."""
    # siblings by falling id: the largest ~id before a row is that of the next sibling
    falling = prefix_scan(trie.withColumn("falling", F.bitwise_not("conv_id")), ["falling"], {"before": ("max", F.col("falling"))},
                          ["depth", "parent_conv_id"], inclusive=False)
    sibling, depth = F.bitwise_not("before"), F.col("depth")
    return falling.select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("bigint").alias("leaves"), "saved",
        F.coalesce("first_child", "conv_id").alias("in_conv"),
        F.when(F.col("first_child").isNull(), 2 * depth + 1).otherwise(2 * depth + 2).alias("in_at"),
        F.coalesce(sibling, "parent_conv_id").alias("out_conv"),
        F.when(F.col("before").isNotNull(), 2 * depth).when(depth > 0, 2 * depth - 1).alias("out_at"))


def chains(nxt: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Head of each element's chain and the weights before it (``nxt`` -1: end),
    by jumping over predecessors."""
    n = len(nxt)
    before = np.full(n, -1, np.int64)
    linked = np.flatnonzero(nxt >= 0)
    before[nxt[linked]] = linked
    sums = np.where((before >= 0)[:, None], weights[before], 0)
    head = np.where(before >= 0, before, np.arange(n))
    jump = before
    while (jump >= 0).any():
        live = np.flatnonzero(jump >= 0)
        over = jump[live]
        sums[live] += sums[over]
        head[live] = head[over]
        further = jump.copy()
        further[live] = jump[over]
        jump = further
    return head, sums


def places(conv: np.ndarray, at: np.ndarray, want_conv: np.ndarray, want_at: np.ndarray) -> np.ndarray:
    """Index of each wanted (conv, at), -1 where it is elsewhere."""
    n = len(conv)
    if not n:
        return np.full(len(want_conv), -1, np.int64)
    ids, group = np.unique(conv, return_inverse=True)
    slot = np.minimum(np.searchsorted(ids, want_conv), len(ids) - 1)
    wide = int(at.max()) + 2
    key, want = group * wide + at, slot * wide + np.clip(want_at, 0, wide - 1)
    by = np.argsort(key)
    found = by[np.minimum(np.searchsorted(key[by], want), n - 1)]
    return np.where((conv[found] == want_conv) & (at[found] == want_at), found, -1)


def contracted(tour: DataFrame) -> DataFrame:
    """One row per node: for both arcs their segment's head and the sums before
    them in it; an arc that is a head also has its segment (successor, sums)."""
    name = lambda side: [f"{side}_{c}" for c in ("head_conv", "head_at", *SUMS)]
    segment = "array<struct<conv: bigint, at: bigint, next_conv: bigint, next_at: bigint, rank: bigint, leaves: bigint, saved: bigint>>"
    schema = "conv_id bigint, depth bigint, " + ", ".join(f"{c} bigint" for side in ("in", "out") for c in name(side)) + f", segments {segment}"

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        f = pd.concat(frames, ignore_index=True)
        n = len(f)
        # arcs in, then arcs out
        conv = np.tile(f["conv_id"].to_numpy(np.int64), 2)
        at = np.r_[2 * f["depth"].to_numpy(np.int64), 2 * f["depth"].to_numpy(np.int64) + 1]
        next_conv = pd.concat([f["in_conv"], f["out_conv"]]).astype("Int64")
        next_at = pd.concat([f["in_at"], f["out_at"]]).astype("Int64")
        last = next_at.isna().to_numpy()
        to_conv, to_at = next_conv.fillna(0).to_numpy(np.int64), next_at.fillna(-1).to_numpy(np.int64)
        nxt = places(conv, at, to_conv, to_at)
        zero = np.zeros(n, np.int64)
        weights = np.stack([np.ones(2 * n, np.int64), np.r_[f["leaves"].to_numpy(np.int64), zero], np.r_[f["saved"].to_numpy(np.int64), zero]], axis=1)
        head, sums = chains(nxt, weights)
        out = {"conv_id": f["conv_id"], "depth": f["depth"]}
        for side, part in (("in", slice(0, n)), ("out", slice(n, 2 * n))):
            values = [conv[head[part]], at[head[part]], *sums[part].T]
            out |= dict(zip(name(side), values, strict=True))
        segments: list[list[dict]] = [[] for _ in range(n)]
        for e in np.flatnonzero(nxt < 0):
            h, total = int(head[e]), sums[e] + weights[e]
            segments[h % n].append({"conv": int(conv[h]), "at": int(at[h]), "next_conv": None if last[e] else int(to_conv[e]),
                                    "next_at": None if last[e] else int(to_at[e]), **dict(zip(SUMS, map(int, total), strict=True))})
        out["segments"] = pd.Series(segments, dtype=object)
        yield pd.DataFrame(out)

    return tour.mapInPandas(contract, schema)


def ranked(segments: DataFrame) -> DataFrame:
    """``conv, at`` and the sums before each segment, of a list that one task holds."""
    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        f = pd.concat(frames, ignore_index=True)
        conv, at = f["conv"].to_numpy(np.int64), f["at"].to_numpy(np.int64)
        end = f["next_at"].isna().to_numpy()
        nxt = places(conv, at, f["next_conv"].astype("Int64").fillna(0).to_numpy(np.int64), f["next_at"].astype("Int64").fillna(-1).to_numpy(np.int64))
        nxt[end] = -1
        sums = chains(nxt, f[list(SUMS)].to_numpy(np.int64))[1]
        yield pd.DataFrame({"conv": conv, "at": at, **dict(zip(SUMS, sums.T, strict=True))})

    return segments.coalesce(1).mapInPandas(rank, "conv bigint, at bigint, rank bigint, leaves bigint, saved bigint")


def positions(segments: DataFrame, base: int = BASE) -> DataFrame:
    """``conv, at`` and the sums before each segment, by random mates."""
    rounds, size = [], segments.count()
    while size > base:
        coin = lambda conv, at: F.pmod(F.xxhash64(conv, at, F.lit(len(rounds))), F.lit(2)) == 1
        absorbs = F.coalesce(coin("conv", "at") & ~coin("next_conv", "next_at") & F.col("next_at").isNotNull(), F.lit(False))
        mates = segments.filter(absorbs).select(F.col("next_conv").alias("conv"), F.col("next_at").alias("at"), F.col("conv").alias("by_conv"),
                                                F.col("at").alias("by_at"), *[F.col(c).alias(f"by_{c}") for c in SUMS])
        met = staged(segments.withColumn("absorbs", absorbs).join(mates, ["conv", "at"], "left"), "tour-round")
        gone = met.filter(F.col("by_at").isNotNull())
        rounds.append(gone.select("conv", "at", "by_conv", "by_at", *[f"by_{c}" for c in SUMS]))
        merged = gone.select(F.col("by_conv").alias("conv"), F.col("by_at").alias("at"), "next_conv", "next_at",
                             *[(F.col(c) + F.col(f"by_{c}")).alias(c) for c in SUMS])
        segments = merged.unionByName(met.filter(F.col("by_at").isNull() & ~F.col("absorbs")).select(merged.columns))
        size = segments.count()
    found = staged(ranked(segments), "tour-base")
    for gone in reversed(rounds):
        at = found.select(F.col("conv").alias("by_conv"), F.col("at").alias("by_at"), *[F.col(c).alias(f"at_{c}") for c in SUMS])
        found = staged(found.unionByName(gone.join(at, ["by_conv", "by_at"]).select(
            "conv", "at", *[(F.col(f"at_{c}") + F.col(f"by_{c}")).alias(c) for c in SUMS])), "tour-positions")
    return found


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                base: int = BASE, arcs_a_task: int = ARCS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, enter_at, exit_at`` (places of its arcs in
    the tour)."""
    rows = staged(members(rebuilt(staged(turns(conversations, conv_id, turn, role, text), "numbered-turns"))), "trie-members")
    trie = staged(nodes(rows), "trie")
    tour = staged(arcs(trie), "tour")
    tasks = max(partitions(tour), -(-2 * tour.count() // arcs_a_task))
    parts = staged(contracted(tour.repartitionByRange(tasks, "conv_id", "depth")), "tour-parts")
    found = positions(parts.select(F.explode("segments").alias("s")).select("s.*"), base)
    for side in ("in", "out"):
        at = found.select(F.col("conv").alias(f"{side}_head_conv"), F.col("at").alias(f"{side}_head_at"), *[F.col(c).alias(f"{side}_{c}_0") for c in SUMS])
        parts = parts.join(at, [f"{side}_head_conv", f"{side}_head_at"])
    total = lambda side, c: F.col(f"{side}_{c}") + F.col(f"{side}_{c}_0")
    sums = parts.select("conv_id", "depth", (total("out", "leaves") - total("in", "leaves")).alias("n_leaves"),
                        (total("out", "saved") - total("in", "saved")).alias("saved_tokens"),
                        total("in", "rank").alias("enter_at"), total("out", "rank").alias("exit_at"))
    return trie.join(sums, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                                        "ends_sha256", "enter_at", "exit_at")
