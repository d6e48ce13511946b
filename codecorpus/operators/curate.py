"""Curation jobs J1, J2 and the key checks (JN-1, JN-2, WIN-1, SNK-2..4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import patterns as P
from codecorpus.functions.text import base_name, extension, rust_line_count, strip_keep_newlines
from codecorpus.operators.scan import row_index
from codecorpus.operators.staging import staged


def ingest_files(corpus: DataFrame) -> DataFrame:
    """SRC-2/SRC-3: files below the root (never directly in it) named
    ``CWE*`` with extension exactly ``.java``, ``.c`` or ``.cpp``."""
    name = base_name(F.col("path"))
    folder = F.regexp_extract(F.col("path"), r"^(.*)[/\\][^/\\]+$", 1)
    files = corpus.select(
        "file_id", "path", folder.alias("folder"), name.alias("file_name"),
        extension(name).alias("file_extension"), "content",
    )
    return files.filter(
        F.col("file_name").startswith("CWE")
        & F.col("file_extension").isin(*P.INGEST_EXTENSIONS)
        & (F.col("folder") != "")
    )


def last_wins(flaws: DataFrame) -> DataFrame:
    """JN-2: one manifest entry per base name, the last in document order."""
    return flaws.withColumn("file_name", base_name(F.col("file_name"))).groupBy("file_name").agg(
        F.max_by(F.struct("cwe", "vulnerability_location"), F.struct("doc_pos", "file_pos")).alias("m")
    ).select("file_name", "m.cwe", "m.vulnerability_location")


def testcase_table(files: DataFrame, flaws: DataFrame) -> DataFrame:
    """J1 / JN-1: files x manifest on base name (inner).  The manifest side is
    reduced to one row per distinct name first and written once: every reader of
    the result would parse it again, and its size is known before the files are
    read, so no text moves when it is below the broadcast threshold; otherwise
    both sides are shuffled."""
    return files.join(staged(last_wins(flaws), "manifest"), "file_name", "inner").select(
        "file_id", "folder", "path", "file_name", "file_extension", "content", "cwe", "vulnerability_location"
    )


def prefix_split(testcases: DataFrame, split=P.SPLIT_PERCENT, also: list[str] | None = None) -> DataFrame:
    """J2 / WIN-1 / FLT-2 / SET-2: per language (exact extension) the first
    trunc(70% n) rows in (path, file_id) order are training (0), the next
    trunc(20% n) testing (1), the rest validation (2); text cleaned with the
    newline-keeping stripper.  Only the keys are numbered (block method); the two
    last keys of training and testing per language, at most one row a language, are
    broadcast and every file compares its own key with them, so no text moves.
    ``also``: columns of the input to keep."""
    t = testcases.filter(F.col("file_extension").isin(*P.INGEST_EXTENSIONS))
    ranked = row_index(t.select("file_extension", "path", "file_id"), ["path", "file_id"], ["file_extension"], name="rn", count_as="n")
    n_train = F.floor(F.col("n") * split[0] / 100)
    n_test = F.floor(F.col("n") * split[1] / 100)
    key = F.struct("path", "file_id")
    cuts = ranked.filter(F.col("rn").isin(n_train, n_train + n_test)).groupBy("file_extension").agg(
        F.max(F.when(F.col("rn") == n_train, key)).alias("train_end"),
        F.max(F.when(F.col("rn") == n_train + n_test, key)).alias("test_end"))
    model_id = F.when(key <= F.col("train_end"), 0).when(key <= F.col("test_end"), 1).otherwise(2)
    return t.join(F.broadcast(cuts), "file_extension", "left").select(
        "file_id", model_id.alias("model_id"), "file_name", "file_extension",
        strip_keep_newlines(F.col("content")).alias("file_content"), "cwe", "vulnerability_location", *(also or []),
    )


def audited_cases(testcases: DataFrame, split=P.SPLIT_PERCENT) -> tuple[DataFrame, DataFrame]:
    """J2 with its audit (STR-4): the cases whose cleaned text has as many lines as
    the file, and the keys and line counts of the others.  The split is made before
    the audit, as in the reference, so it does not move with the rejects."""
    rows = prefix_split(testcases.withColumn("lines_before", rust_line_count(F.col("content")).cast("bigint")), split, ["lines_before"])
    columns = [c for c in rows.columns if c not in ("file_content", "lines_before")]
    # the cleaned text is made once, and its row stays if it passes
    passed = F.explode(F.filter(F.array("file_content"), lambda t: rust_line_count(t) == F.col("lines_before"))).alias("file_content")
    after = rust_line_count(F.col("file_content")).cast("bigint")
    rejects = rows.select(*columns, "lines_before", after.alias("lines_after")).filter(F.col("lines_before") != F.col("lines_after"))
    return rows.select(*columns, passed), rejects.select("file_id", "model_id", "file_name", "file_extension", "lines_before", "lines_after")


def key_violations(df: DataFrame, key: list[str], table_name: str) -> DataFrame:
    """SNK-3/SNK-4 guard: keys that occur more than once.  A load writes only
    when this is empty (all-or-nothing), see ``sinks.write_checked``."""
    dup = df.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    model = F.col("model_id").cast("bigint") if "model_id" in key else F.lit(None).cast("bigint")
    return dup.select(F.lit(table_name).alias("table_name"), model.alias("model_id"), "file_name",
                      F.col("n").cast("bigint").alias("n"))


def class_histogram(windows: DataFrame) -> DataFrame:
    """AGG-7 / TOP-6: windows per class, largest first (a NULL class counts 0,
    as counting the column does)."""
    return windows.groupBy("cwe").agg(F.count("cwe").alias("total")).orderBy(F.desc("total"), "cwe")
