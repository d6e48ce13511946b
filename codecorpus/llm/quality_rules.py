"""Quality rules: base text rules plus a hashed n-gram likelihood ratio.

Every word and every pair of neighbouring words falls into one of ``buckets``
hash buckets.  Two multinomials over the buckets are counted: one over the
whole raw corpus, one over the trusted target documents.  A bucket's ratio
``log(p_target / p_raw)`` is the log of its count in the target over the count
expected there at the raw frequency, both smoothed by ``prior`` counts, so buckets
with little evidence weigh little, however small the target.  A document's score
is the mean ratio of its n-grams; it is kept when no base rule fails and the
score is at least ``threshold``.

The ratio table has ``buckets`` doubles, a fixed size, and reaches the tasks as
the value of a scalar subquery: documents are never shuffled or joined on
their words, each is judged inside its own row, and the row keeps all columns.

Defined results: a null or empty text has no words, fails the base rule and is
not kept; repeated rows are judged alike; an empty table gives an empty result;
without trusted documents every ratio is 0, so only the base rules decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import BLANKS, fresh, let, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BUCKETS = 1 << 16
PRIOR = 4.0
#: Mean log ratio that a kept document reaches; chosen between the labelled classes (see README).
THRESHOLD = -0.12
#: At most so many labelled documents form the trusted target (smallest hashes first).
MAX_TRUSTED = 20_000


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> DataFrame:
    """Ids of labelled documents of good quality that are not toxic: a bounded,
    deterministic sample, small enough to broadcast (8 bytes a row)."""
    good = labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id").filter(F.col("doc_id").isNotNull())
    return good.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _grams(w: Column, buckets: int) -> Column:
    """Bucket numbers of the words and of the neighbouring pairs of ``w``."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.when(F.size(w) > 1, F.transform(
        F.sequence(F.lit(1), F.size(w) - 1),
        lambda i: F.pmod(F.xxhash64(F.get(w, i - 1), F.get(w, i)), F.lit(buckets)).cast("int")))
    return F.concat(one, F.coalesce(two, F.array().cast("array<int>")))


def ratio_table(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id",
                buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row, one column: the array of ``log(p_target / p_raw)`` by bucket.
    The counts cover every document; partial sums leave each task, at most
    ``buckets`` rows of them."""
    ids = trusted.select(F.col("doc_id").alias("__t")).withColumn("__in", F.lit(1))
    marked = docs.select(F.col(doc_id).alias("__t"), F.col(text).alias("__x")).join(F.broadcast(ids), "__t", "left")
    grams = marked.select(F.coalesce("__in", F.lit(0)).alias("hit"), F.explode(let(words("__x"), lambda w: _grams(w, buckets))).alias("b"))
    seen = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("hit").alias("target"))
    cells = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(seen, "b", "left").na.fill(0)
    rows = cells.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("cells"),
                     F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    expected = lambda c: F.col("n_target") * c["raw"] / F.greatest(F.col("n_raw"), F.lit(1))
    llr = F.transform("cells", lambda c: F.log((c["target"] + prior) / (expected(c) + prior)))
    return rows.select(llr.alias("llr"))


def repeat_words(w: Column) -> Column:
    """Words inside a three-word window that occurs twice or more in the text.
    The windows' hashes are sorted with their starts; neighbours with one hash
    repeat; their starts, sorted, each cover three words less the overlap."""
    def covered(starts: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(0), F.size(starts) - 1),
                           lambda j: F.coalesce(F.least(F.lit(3), F.get(starts, j + 1) - F.get(starts, j)), F.lit(3)))
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda a, b: a + b))

    def repeated(s: Column) -> Column:
        at = lambda j: F.get(s, j)["h"]
        twice = lambda j: F.coalesce(at(j) == at(j - 1), F.lit(False)) | F.coalesce(at(j) == at(j + 1), F.lit(False))
        found = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(twice(j), F.get(s, j)["i"]))
        return F.sort_array(F.filter(found, lambda x: x.isNotNull()))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                          lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(let(F.sort_array(windows), repeated), covered))


def judge(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS,
          prior: float = PRIOR, threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct of the measures and the verdict,
    and the name of that column (one that ``docs`` does not have)."""
    name = fresh(docs, "quality_verdict")
    x = F.coalesce(F.col(text), F.lit(""))
    table = fresh(docs, "quality_ratios")
    llr = F.col(table)
    lines = F.filter(F.split(x, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    chars = F.length(F.translate(x, BLANKS, ""))
    symbols = F.length(x) - F.length(F.translate(x, SYMBOLS, ""))
    dup_lines = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))

    def mean_ratio(w: Column) -> Column:
        total = let(llr, lambda t: F.aggregate(_grams(w, buckets), F.lit(0.0), lambda s, g: s + F.get(t, g)))
        return F.when(F.size(w) > 0, total / (2 * F.size(w) - 1))

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        return F.struct(m["n_words"].alias("n_words"), chars.cast("bigint").alias("word_chars"), symbols.cast("bigint").alias("n_symbols"),
                        dup_lines.cast("bigint").alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
                        failed.alias("base_failed"), (~failed & (F.coalesce(m["llr"], F.lit(float("-inf"))) >= threshold)).alias("kept"),
                        m["llr"].alias("llr"))

    # one expression that names its parts: a filter on the verdict evaluates it once
    measures = let(words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), repeat_words(w).cast("bigint").alias("n_repeat_words"), mean_ratio(w).alias("llr")))
    rated = docs.withColumn(table, ratio_table(docs, trusted, text, doc_id, buckets, prior).scalar())
    return rated.select(*[F.col(f"`{c}`") for c in docs.columns], let(measures, verdict).alias(name)), name


def keep(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns."""
    judged, name = judge(docs, trusted, **options)
    return judged.filter(F.col(name)["kept"]).drop(name)
