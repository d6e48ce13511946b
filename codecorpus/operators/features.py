"""Training features (J5) and vector pooling: STR-13, ARR-1..5, AGG-8,
FLT-4, JN-6, JN-7, SMP-3, AGG-16, AGG-17, WIN-8.

Vectors have any length, one for the whole table; it is read from the table and a
table of mixed lengths is refused.

Rows stay keyed (``file_id``) end to end: sequences and labels live on one
row, so nothing is ever zipped by position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import patterns as P
from codecorpus.functions.text import split_lines
from codecorpus.operators.scan import row_index
from codecorpus.operators.staging import staged
from codecorpus.operators.windows import md5_int


def window_tokens(windows: DataFrame, first_lines: int) -> DataFrame:
    """TOP-4 + STR-13 (default tokeniser): the first ``first_lines`` lines of
    each window, split on single spaces, empties dropped; one row per token
    occurrence ``(file_id, line_no, pos, token)``."""
    lines = windows.select(
        "file_id", F.posexplode(F.slice(split_lines(F.col("vlw_content")), 1, first_lines)).alias("line_no", "line")
    )
    toks = lines.select("file_id", "line_no", F.posexplode(F.split(F.col("line"), " ", -1)).alias("pos", "token"))
    return toks.filter(F.col("token") != "")


def vocab(tokens: DataFrame) -> DataFrame:
    """Frequency-ranked vocabulary: id 1 = most frequent (ties by token),
    0 is padding.  Counting is a partial aggregation; ranking uses the block
    method, so the vocabulary is never sorted in one task."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    ranked = row_index(counts.withColumn("neg_n", -F.col("n")), ["neg_n", "token"], name="token_id")
    return ranked.select("token", F.col("n").cast("bigint").alias("n"), F.col("token_id").cast("bigint").alias("token_id"))


def encode(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Token ids per line, in token order: ``(file_id, line_no, ids)``.  The
    vocabulary join is an equi-join on the token (a hot token is split by the
    adaptive skew join; the vocabulary is broadcast only when its measured
    size allows it).  One shuffle by file_id then serves both the per-line
    grouping here and the per-window grouping of ``training_rows``."""
    j = tokens.join(vocabulary.select("token", F.col("token_id").cast("int").alias("token_id")), "token")
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_line = j.repartition(n, "file_id").groupBy("file_id", "line_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("p"))
    return per_line.select("file_id", "line_no", F.col("p.token_id").alias("ids"))


def longest_line(windows: DataFrame, first_lines: int) -> DataFrame:
    """AGG-8 input: ``windows`` with ``n_tokens``, the most tokens of one of
    their first lines (every token has an id, so that is the longest id list);
    windows without tokens are left out.  Counted inside the row."""
    per_line = F.transform(F.slice(split_lines(F.col("vlw_content")), 1, first_lines),
                           lambda line: F.size(F.filter(F.split(line, " ", -1), lambda t: t != "")))
    return windows.withColumn("n_tokens", F.array_max(per_line)).filter("n_tokens > 0")


def pad_truncate(ids: Column, width: int = P.TOKENS_PER_LINE) -> Column:
    """ARR-1: zeros appended up to ``width``; longer lists keep their last
    ``width`` ids (pre-truncation)."""
    kept = F.when(F.size(ids) > width, F.slice(ids, -width, width)).otherwise(ids)
    return F.concat(kept, F.array_repeat(F.lit(0).cast("int"), F.greatest(F.lit(width) - F.size(ids), F.lit(0))))


def one_hot(index: Column, width: int) -> Column:
    """ARR-2: one-hot vector of ``width``; NULL when out of range."""
    return F.when(
        (index >= 0) & (index < width),
        F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == index).cast("int")),
    )


def training_labels(windows: DataFrame, window: int = P.WINDOW_LINES) -> DataFrame:
    """``file_id, file_name, split`` and the one-hot location of the complete
    windows (exactly ``window`` lines, FLT-4)."""
    n_lines = F.size(F.slice(split_lines(F.col("vlw_content")), 1, window))
    return windows.filter(n_lines == window).select(
        "file_id", "file_name", "split", one_hot(F.col("vulnerability_location"), window).alias("label"))


def training_rejects(windows: DataFrame, window: int = P.WINDOW_LINES) -> DataFrame:
    """FLT-4 and ARR-2: the windows that give no training row or one without a label, with
    the ``reason``: ``lines`` (fewer than ``window``; the location is then not asked),
    ``no location``, or ``location out of range`` (where the reference stops)."""
    n_lines = F.size(split_lines(F.coalesce("vlw_content", F.lit(""))))
    at = F.col("vulnerability_location")
    reason = (F.when(n_lines < window, "lines").when(at.isNull(), "no location")
              .when((at < 0) | (at >= window), "location out of range"))
    return windows.select("file_id", "file_name", "split", n_lines.alias("n_lines"), "vulnerability_location", reason.alias("reason")).filter(
        F.col("reason").isNotNull())


def training_rows(windows: DataFrame, encoded: DataFrame, window: int = P.WINDOW_LINES,
                  width: int = P.TOKENS_PER_LINE) -> DataFrame:
    """J5: per complete window the first ``window`` lines as padded id lists and
    the one-hot location (a window that goes takes its label with it: same row).  Lines
    are padded first, gathered per window as a line -> ids map, and the sequence
    is read from the map line by line; lines without tokens become zeros."""
    padded = encoded.select("file_id", "line_no", pad_truncate(F.col("ids"), width).alias("ids"))
    per_window = padded.groupBy("file_id").agg(
        F.map_from_entries(F.collect_list(F.struct("line_no", "ids"))).alias("m"))
    rows = training_labels(windows, window).join(per_window, "file_id", "left")
    zeros = F.array_repeat(F.lit(0).cast("int"), width)
    seq = F.transform(F.sequence(F.lit(0), F.lit(window - 1)),
                      lambda l: F.coalesce(F.try_element_at(F.col("m"), l), zeros))
    return rows.select("file_id", "file_name", "split", seq.alias("seq"), "label")


def shape_audit(rows: DataFrame, window: int = P.WINDOW_LINES, width: int = P.TOKENS_PER_LINE) -> DataFrame:
    """ARR-5: rows, rows whose sequence is not window x width, rows whose label
    is not exactly one-hot."""
    bad_seq = (F.size("seq") != window) | F.exists("seq", lambda x: F.size(x) != width)
    bad_label = F.col("label").isNull() | (F.size("label") != window) | (
        F.aggregate("label", F.lit(0), lambda a, x: a + x) != 1)
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(bad_seq).alias("bad_seq"),
        F.count_if(bad_label).alias("bad_label"),
    )


def batches(rows: DataFrame, batch_size: int = P.BATCH_SIZE, seed: str = "batch") -> DataFrame:
    """SMP-3: shuffled fixed-size batches per split, last partial batch
    dropped.  The shuffle is a stable hash order; positions come from the
    block method."""
    # only the columns the batches need: the (wide) sequences are never built
    keyed = rows.select("split", "file_id", "label").withColumn("h", md5_int(F.lit(seed), F.col("file_id").cast("string")))
    ranked = row_index(keyed, ["h", "file_id"], ["split"], name="rn")
    b = ranked.withColumn("batch_id", F.floor((F.col("rn") - 1) / batch_size).cast("bigint"))
    full = b.groupBy("split", "batch_id").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.array_position("label", 1) - 1).alias("label_pos_sum"),
        F.min("file_id").alias("first_file_id"),
    )
    return full.filter(F.col("n_rows") == batch_size)


#: Token ids up to this, and with no more numbers in their vectors, are joined by broadcast (as floats 32 MB at
#: most): ids rank tokens by frequency, so these are the hot keys.
HOT_TOKENS, HOT_NUMBERS = 1 << 17, 1 << 23
#: Scores of one step apart differ by a factor of e**STEP, which doubles hold with room to spare.
STEP = 64


def vector_length(embeddings: DataFrame) -> int:
    """Length of the table's vectors, 0 for an empty table."""
    r = embeddings.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if r.least != r.most:
        raise ValueError(f"vectors of {r.least} to {r.most} dimensions in one table")
    return r.most or 0


def token_ids(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``file_id, line_no, pos, token_id`` of every token."""
    return tokens.join(vocabulary.select("token", "token_id"), "token").select("file_id", "line_no", "pos", "token_id")


def hot_tokens(length: int) -> int:
    """How many tokens are joined by broadcast with vectors of this length."""
    return min(HOT_TOKENS, HOT_NUMBERS // max(length, 1))


def with_vectors(ids: DataFrame, embeddings: DataFrame, hot: int = HOT_TOKENS, made: dict[str, Callable[[Column], Column]] | None = None,
                 key: str = "file_id") -> DataFrame:
    """JN-6: rows with a ``token_id`` and its vector ``vec`` (``vec_id`` = vocabulary
    id; null without one), and with what is ``made`` of it, once a vector; rows of one
    ``key`` lie in one partition.  The rows of the ``hot`` most frequent tokens, which may
    be most of all, are brought to their key's partition as ids and meet their vectors
    there, by broadcast of at most ``hot`` rows; only the others' vectors are shuffled, as
    the table's own numbers, and none of those tokens is frequent."""
    ids = staged(ids, "ids")  # both kinds of tokens read one result
    doubles = lambda vec: F.col(vec).cast("array<double>")
    vectors = embeddings.filter(F.col("embedding").isNotNull()).groupBy(F.col("vec_id").alias("token_id")).agg(F.max("embedding").alias("vec"))
    vectors = vectors.withColumns({name: f(doubles("vec")) for name, f in (made or {}).items()})
    frequent = F.coalesce(F.col("token_id").between(1, hot), F.lit(False))
    found = {f.name: f.dataType for f in vectors.schema if f.name != "token_id"}
    rare = ids.filter(~frequent).join(vectors.filter(~frequent), "token_id", "left")
    later = ids.filter(frequent).select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in found.items()])
    near = vectors.filter(frequent).select("token_id", *[F.col(c).alias(f"hot_{c}") for c in found])
    both = rare.unionByName(later).repartition(key).join(F.broadcast(near), "token_id", "left")
    either = both.select(*ids.columns, *[F.coalesce(c, f"hot_{c}").alias(c) for c in found])
    return either.withColumn("vec", doubles("vec"))


def sequence_vectors(ids: DataFrame, embeddings: DataFrame, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """JN-6 with its order: ``file_id, line_no, vectors``, the vectors of a line's
    tokens in token order, or their ``form``, made once a vector; a token without one
    has zeros, as padding does."""
    length = vector_length(embeddings)
    form = form or (lambda vec: vec)
    zeros = F.lit(ids.sparkSession.range(1).select(form(F.array_repeat(F.lit(0.0), length))).first()[0])
    placed = with_vectors(ids, embeddings, hot_tokens(length), {"form": form}).select(
        "file_id", "line_no", F.struct("pos", F.coalesce("form", zeros).alias("vec")).alias("p"))
    return placed.groupBy("file_id", "line_no").agg(F.array_sort(F.collect_list("p")).alias("p")).select(
        "file_id", "line_no", F.col("p.vec").alias("vectors"))


def token_counts(ids: DataFrame, embeddings: DataFrame, length: int, made: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``file_id, vec, n``: a file's distinct tokens with their vectors and
    numbers (pooling does not ask for the order; counted before vectors travel)."""
    return with_vectors(ids.groupBy("file_id", "token_id").agg(F.count(F.lit(1)).alias("n")), embeddings, hot_tokens(length), made)


def weighted_sum(vec: Column, weight: Column) -> Column:
    """Sum of weight * vector over a group, for vectors of any one length."""
    return vector_to_array(Summarizer.metrics("sum").summary(array_to_vector(vec), weight)["sum"])


def token_vectors(tokens: DataFrame, vocabulary: DataFrame, embeddings: DataFrame) -> DataFrame:
    """JN-6 + AGG-16: the mean of the vectors of a row's tokens, as flat ``(file_id,
    dim, n_tokens, n_matched, value)``.  A token without a vector counts as zeros."""
    length = vector_length(embeddings)
    counted = token_counts(token_ids(tokens, vocabulary), embeddings, length)
    zeros = F.array_repeat(F.lit(0.0), length)
    sums = counted.groupBy("file_id").agg(
        F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("vec").isNotNull(), F.col("n")).otherwise(0)).alias("n_matched"),
        weighted_sum(F.coalesce("vec", zeros), F.col("n").cast("double")).alias("sums"))
    return sums.select("file_id", F.posexplode("sums").alias("dim", "s"), "n_tokens", "n_matched").select(
        "file_id", F.col("dim").cast("bigint").alias("dim"), F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.col("n_matched").cast("bigint").alias("n_matched"), F.round(F.col("s") / F.col("n_tokens"), 4).alias("value"))


def mean_pool(embeddings: DataFrame, key: str = "label") -> DataFrame:
    """AGG-16: per group the mean of each dimension, as flat (key, dim, value)."""
    e = embeddings.select(key, F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy(key, "dim").agg(F.round(F.avg("x"), 5).alias("value"), F.count("*").alias("n")).select(
        key, F.col("dim").cast("bigint").alias("dim"), "value", F.col("n").cast("bigint").alias("n"))


def attention_score(vec: Column, weights: list[float] | None = None) -> Column:
    """Linear score of a vector of any length; without given weights dimension d
    weighs ((d mod 7) - 3) / 10."""
    weigh = (lambda x, d: x * ((d % 7 - 3) / F.lit(10.0))) if weights is None else (
        lambda x, d: x * F.get(F.array(*[F.lit(float(w)) for w in weights]), d))
    return F.aggregate(F.transform(vec, weigh), F.lit(0.0), lambda acc, x: acc + x)


def softmax_pool(rows: DataFrame, key: str, weights: list[float] | None = None) -> DataFrame:
    """AGG-17 + WIN-8 + MTH-5 over rows ``key, vec, n`` (``n`` equal positions): score
    = <w, v> (or the rows' own ``s``), softmax over a key's positions, pooled value = sum of weight * v, as
    ``key, pooled``.  States of one key merge in any order: scores fall into steps,
    a state holds the sums of e**(score - its step) and of that times the vector, and
    states of different steps are scaled to the highest one.  So no maximum has
    to be known before the sums, partial states leave each task, and a key that holds
    most rows is no hot one."""
    scored = (rows if "s" in rows.columns else rows.withColumn("s", attention_score(F.col("vec"), weights))).withColumn("step", F.floor(F.col("s") / STEP))
    e = F.col("n") * F.exp(F.col("s") - F.col("step") * STEP)
    states = scored.groupBy(key, "step").agg(F.sum(e).alias("z"), weighted_sum(F.col("vec"), e).alias("sums"))
    top = F.array_max(F.transform("states", lambda x: x["step"]))
    merged = states.groupBy(key).agg(F.collect_list(F.struct("step", "z", "sums")).alias("states"))  # a few steps a key
    scale = lambda x: F.exp((x["step"] - F.col("top")) * F.lit(float(STEP)))
    total = F.aggregate("states", F.lit(0.0), lambda acc, x: acc + x["z"] * scale(x))
    summed = F.aggregate("states", F.transform(F.col("states")[0]["sums"], lambda x: F.lit(0.0)),
                         lambda acc, x: F.zip_with(acc, x["sums"], lambda a, b: a + b * scale(x)))
    return merged.withColumn("top", top).select(key, F.transform(summed, lambda x: x / total).alias("pooled"))


def attention_pool(embeddings: DataFrame, key: str = "label", weights: list[float] | None = None) -> DataFrame:
    """AGG-17 over a table of vectors, as flat (key, dim, value)."""
    rows = embeddings.filter(F.col("embedding").isNotNull()).select(key, F.col("embedding").cast("array<double>").alias("vec"), F.lit(1).alias("n"))
    return _flat(softmax_pool(rows, key, weights), key, 5)


def sequence_attention(tokens: DataFrame, vocabulary: DataFrame, embeddings: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """AGG-17 per sequence row: the tokens of a window are its positions."""
    length = vector_length(embeddings)
    zeros = F.array_repeat(F.lit(0.0), length)
    counted = token_counts(token_ids(tokens, vocabulary), embeddings, length, {"s": lambda vec: attention_score(vec, weights)})
    counted = counted.withColumns({"s": F.when(F.col("vec").isNull(), 0.0).otherwise(F.col("s")), "vec": F.coalesce("vec", zeros)})
    return _flat(softmax_pool(counted, "file_id", weights), "file_id", 4)


def _flat(pooled: DataFrame, key: str, digits: int) -> DataFrame:
    return pooled.select(key, F.posexplode("pooled").alias("dim", "value")).select(
        key, F.col("dim").cast("bigint").alias("dim"), F.round("value", digits).alias("value"))
