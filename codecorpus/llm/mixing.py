"""Mixing sources to target weights by Pfair windows and earliest deadline first.

Each source's documents, in order of ``doc_id``, form blocks of ``block_rows``
documents.  A source of weight ``a / period`` (whole ``a``, the weights of all
sources sum to ``period``) releases its ``k``-th block (from 0) at slot
``floor(k * period / a)`` and must place it before slot
``ceil((k + 1) * period / a)``.  One stream with full use of its slots can always
meet these windows by earliest deadline first, and then after any number of
slots each source is less than one block away from its exact share.

Windows repeat every ``period`` slots, so earliest deadline first runs once over
one period (a fold inside one row over ``period`` numbers, each looking at the
distinct weights only; 1,000 slots, or two a source beyond 500 sources) and block ``k`` of a source takes slot
``period * floor(k / a) + pattern(source, k mod a)``.  Numbering the blocks needs
no ordered window over a whole source: documents are cut into ranges of ids,
ranges are numbered by a running sum over their counts (one row a range and
source), documents inside their own range only, so a source that holds a third
of all rows is spread over as many tasks as any.

A source that runs out leaves its later slots empty; the order of the others
stays, so they go on in proportion to their weights.  No document is dropped
or repeated.

Defined results: a null source is a source of its own; null ids come last in
their source, in parts by the hash of their row; repeated rows are numbered in turn; an empty table gives an empty
result.  Columns of ``docs`` keep their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecorpus.llm.common import fresh, let, staged

PERIOD = 1000
BLOCK_ROWS = 64
#: Documents are numbered inside ranges of so many ids.
ID_RANGE = 1024
#: Documents without an id are numbered in so many parts.
NULL_PARTS = 1024
#: The slots of a period are broadcast up to this size, else joined by source and turn.
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 10_000_000


def target_weights(counts: DataFrame, period: int = PERIOD) -> DataFrame:
    """Whole weights that sum to ``period`` for the rows ``(source, n)`` of
    ``counts``: in proportion to the square root of a source's documents (small
    sources are raised, large ones held down), at least 1 each, by largest
    remainders.  More sources than ``period / 2`` double the period."""
    alone = Window.partitionBy()  # one row a source
    total = F.sum(F.sqrt("n")).over(alone)
    sources = F.count(F.lit(1)).over(alone)
    scale = F.greatest(F.lit(period), 2 * sources).cast("bigint")
    spare = (F.col("period") - F.col("sources")).cast("double")
    shares = counts.select("source", "n", scale.alias("period"), sources.alias("sources"), F.sqrt("n").alias("root"), total.alias("total"))
    shares = shares.withColumn("share", F.round(F.col("root") / F.col("total"), 12) * spare)
    shares = shares.withColumn("floor", F.floor("share")).withColumn("left", F.col("period") - F.col("sources") - F.sum("floor").over(alone))
    rank = F.row_number().over(Window.orderBy(F.round(F.col("share") - F.col("floor"), 6).desc(), F.col("source").asc_nulls_last()))
    return shares.select("source", "n", "period", (1 + F.col("floor") + (rank <= F.col("left")).cast("int")).cast("bigint").alias("weight"))


def _fold(weights: Column, members: Column, period: Column, piece: int = 512) -> Column:
    """Which source (its place) takes each slot of one period: among the blocks
    released the one with the earliest deadline, ties to the first place.  Sources of
    one weight have the same windows and take turns, so a step looks at one count for
    each distinct weight (fewer than ``sqrt(2 * period)``), ``members`` holding the
    places of each; slots are gathered a piece at a time."""
    def step(state: Column, t: Column) -> Column:
        def window(j: Column, c: Column) -> Column:
            def bounds(k: Column) -> Column:
                w = F.get(weights, c)
                due = F.floor(((k + 1) * period + w - 1) / w)
                place = F.get(F.get(members, c), F.pmod(j, F.size(F.get(members, c))).cast("int"))
                return F.when(F.floor(k * period / w) <= t, F.struct(due.alias("due"), place.alias("i"), c.alias("c")))

            return let(F.floor(j / F.size(F.get(members, c))), bounds)

        pick = F.array_min(F.filter(F.transform(state["done"], window), lambda x: x.isNotNull()))
        return let(pick, lambda p: F.struct(
            F.transform(state["done"], lambda j, c: j + F.coalesce((c == p["c"]).cast("bigint"), F.lit(0).cast("bigint"))).alias("done"),
            F.concat(state["slots"], F.array(p["i"])).alias("slots")))

    def pieces(state: Column, first: Column) -> Column:
        start = F.struct(state["done"].alias("done"), F.array().cast("array<int>").alias("slots"))
        times = F.sequence(first, F.least(first + piece, period) - 1)
        return let(F.aggregate(times, start, step), lambda r: F.struct(r["done"].alias("done"), F.concat(state["all"], F.array(r["slots"])).alias("all")))

    start = F.struct(F.transform(weights, lambda x: F.lit(0).cast("bigint")).alias("done"), F.array().cast("array<array<int>>").alias("all"))
    firsts = F.sequence(F.lit(0).cast("bigint"), period - 1, F.lit(piece).cast("bigint"))
    return F.flatten(F.aggregate(firsts, start, pieces, lambda s: s["all"]))


def pattern(weights: DataFrame) -> DataFrame:
    """``(source, weight, period, turn, slot)``: the slots of one period."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row a source
    placed = weights.select("source", "weight", "period", place.alias("i"))
    alike = placed.groupBy("weight").agg(F.sort_array(F.collect_list("i")).alias("members"), F.first("period").alias("period"))
    one = alike.agg(F.sort_array(F.collect_list(F.struct("weight", "members"))).alias("s"), F.first("period").alias("period")).filter(F.size("s") > 0)
    slots = one.select(F.posexplode(_fold(F.col("s.weight"), F.col("s.members"), F.col("period"))).alias("slot", "i"))
    turn = F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1
    turns = slots.select("i", F.col("slot").cast("bigint").alias("slot"), turn.cast("bigint").alias("turn"))
    return turns.join(placed, "i").select("source", "weight", "period", "turn", "slot")


def _small(slots: DataFrame) -> bool:
    """Whether the slots of a period may be broadcast: a bounded number of rows and characters."""
    size = slots.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.col("source").cast("string"))).alias("chars")).first()
    return size["n"] <= BROADCAST_ROWS and (size["chars"] or 0) <= BROADCAST_CHARS


def placed(docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", source: str = "source",
           block_rows: int = BLOCK_ROWS, period: int = PERIOD, id_range: int = ID_RANGE) -> tuple[DataFrame, str]:
    """``docs`` and one more column, a struct ``block, release, deadline, slot,
    rank`` (rank: place inside the block, from 0), and that column's name.
    ``weights`` has one row ``(source, weight, period)`` for every source of
    ``docs``; without it the weights come from ``target_weights``."""
    name = fresh(docs, "mix_place")
    cell = fresh(docs, "mix_range")
    part = fresh(docs, "mix_part")
    # rows without an id have no order among them: their content spreads them over parts
    content = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    spread = F.pmod(F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in content]), F.lit(NULL_PARTS)).cast("int")
    rows = docs.withColumn(cell, F.floor(F.col(doc_id) / id_range)).withColumn(part, F.when(F.col(doc_id).isNull(), spread).otherwise(0))
    counts = staged(rows.groupBy(F.col(source).alias("source"), F.col(cell).alias("cell"), F.col(part).alias("part")).agg(
        F.count(F.lit(1)).alias("n")), "mixing-counts")
    if weights is None:
        weights = target_weights(counts.groupBy("source").agg(F.sum("n").alias("n")), period)
    slots = staged(pattern(weights), "mixing-slots")  # one row a slot of one period
    before = Window.partitionBy("source").orderBy(F.col("cell").asc_nulls_last(), "part").rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).alias("c")
    each = slots.filter("turn = 0").select("source", "weight", "period").alias("w")
    offsets = summed.join(each, F.col("c.source").eqNullSafe(F.col("w.source"))).select("c.*", "w.weight", "w.period")
    within = Window.partitionBy(source, cell, part).orderBy(F.col(doc_id).asc_nulls_last())
    numbered = rows.withColumn(name, F.row_number().over(within) - 1)
    r, o = numbered.alias("r"), offsets.alias("o")
    same = (F.col(f"r.{source}").eqNullSafe(F.col("o.source")) & F.col(f"r.{cell}").eqNullSafe(F.col("o.cell"))
            & (F.col(f"r.{part}") == F.col("o.part")))
    at = F.col("o.before") + F.col(f"r.{name}")
    own = [F.col(f"r.`{c}`") for c in docs.columns]
    blocks = r.join(o, same).select(*own, F.col("o.source").alias(cell), F.struct(
        F.floor(at / block_rows).alias("block"), F.pmod(at, F.lit(block_rows)).alias("rank"), "o.weight", "o.period").alias(name)).alias("r")
    place = F.col(f"r.{name}")
    k, weight, cycle = place["block"], place["weight"], place["period"]
    s = (F.broadcast(slots) if _small(slots) else slots).select("source", "turn", "slot").alias("s")
    out = blocks.join(s, F.col(f"r.{cell}").eqNullSafe(F.col("s.source")) & (F.pmod(k, weight) == F.col("s.turn")))
    return out.select(*own, F.struct(
        k.alias("block"), F.floor(k * cycle / weight).alias("release"),
        F.floor(((k + 1) * cycle + weight - 1) / weight).alias("deadline"),
        (cycle * F.floor(k / weight) + F.col("s.slot")).alias("slot"), place["rank"].alias("rank")).alias(name)), name


def interleave(docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """All documents, own columns, written in the order of their slots."""
    out, name = placed(docs, weights, doc_id, source, **options)
    p = F.col(name)
    return out.orderBy(p["slot"], p["rank"], F.col(doc_id)).drop(name)
