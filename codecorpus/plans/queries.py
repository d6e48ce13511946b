"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Each builds its plan from the driver tables through the library operators; the
matching DuckDB SQL lives in ``plans.oracle_sql``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.functions import patterns as P
from codecorpus.functions import text as tx
from codecorpus.functions.sql import register_sql_functions
from codecorpus.operators import functions as fx
from codecorpus.operators import curate, evaluate, features, grouping, labels, search, stats, windows
from codecorpus.operators.staging import staged
from codecorpus.sources import files as fs
from codecorpus.sources import manifest as mf
from codecorpus.sources.corpus import virtual_corpus
from codecorpus.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return virtual_corpus(table(spark, sf, "documents"))


def long_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Curation input: files that hold whole windows."""
    return virtual_corpus(table(spark, sf, "documents"), long=True)


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Mining input: mining is a narrow stage, so only an input of too few splits
    is dealt out first."""
    return fx.source_files(virtual_corpus(spread(table(spark, sf, "documents"), "doc_id")))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return fx.catalog(corpus(spark, sf))


def extracted_df(spark: SparkSession, sf: str) -> DataFrame:
    return fx.extracted_functions(files(spark, sf))


def functions_df(spark: SparkSession, sf: str) -> DataFrame:
    return fx.functions(files(spark, sf))


def _long(*cols):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


# --- step 1: text -----------------------------------------------------------
def q_lines(spark, sf):
    lines = fx.exploded_lines(fx.by_file(files(spark, sf)))
    return lines.select("file_id", (F.col("i") + 1).cast("bigint").alias("line_no"), "line",
                        F.col("c").cast("bigint").alias("depth"))


def q_strip_keep_newlines(spark, sf):
    return corpus(spark, sf).select("file_id", tx.strip_keep_newlines("content").alias("content"))


def q_strip_keep_layout(spark, sf):
    return corpus(spark, sf).select("file_id", tx.strip_keep_layout("content").alias("content"))


def q_strip_all(spark, sf):
    return corpus(spark, sf).select("file_id", tx.strip_all("content").alias("content"))


def q_comment_audit(spark, sf):
    c = corpus(spark, sf)
    before = tx.rust_line_count("content")
    nl = tx.rust_line_count(tx.strip_keep_newlines("content"))
    lay = tx.rust_line_count(tx.strip_keep_layout("content"))
    out = c.select("file_id", before.alias("lines_before"), nl.alias("lines_newlines"), lay.alias("lines_layout"))
    return out.select(
        *_long("file_id", "lines_before", "lines_newlines", "lines_layout"),
        (F.col("lines_before") == F.col("lines_newlines")).alias("ok_newlines"),
        (F.col("lines_before") == F.col("lines_layout")).alias("ok_layout"),
    )


def q_audit_rejects(spark, sf):
    """Files whose line count the newline-keeping stripper changes."""
    out = corpus(spark, sf).select("file_id", "path", tx.rust_line_count("content").cast("bigint").alias("lines_before"),
                                   tx.rust_line_count(tx.strip_keep_newlines("content")).cast("bigint").alias("lines_after"))
    return out.filter(F.col("lines_before") != F.col("lines_after"))


# --- step 2: grouping -------------------------------------------------------
def q_testcase_groups(spark, sf):
    return grouping.testcase_groups(catalog(spark, sf))


def q_testcase_limit(spark, sf):
    return grouping.testcase_limit(catalog(spark, sf), 5)


def q_testcase_members(spark, sf):
    return grouping.testcase_members(catalog(spark, sf))


def q_file_counts(spark, sf):
    return grouping.file_counts(catalog(spark, sf))


def q_subfolders(spark, sf):
    """Files by the sub-folder row they join."""
    placed = fs.with_subfolders(corpus(spark, sf).select("file_id", "path"))
    return placed.groupBy("folder_name").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path"))


# --- step 3: functions ------------------------------------------------------
def q_functions(spark, sf):
    return functions_df(spark, sf).select(
        "language", "test_case_id", "path", "file_id", "name",
        *_long("start_line", "end_line", "lines"), "label",
    )


def q_first_functions(spark, sf):
    f = functions_df(spark, sf).select("test_case_id", "path", *_long("start_line"), "name")
    return grouping.first_k(f, ["test_case_id"], ["path", "start_line", "name"], 3).withColumn("rank", F.col("rank").cast("bigint"))


def q_function_names(spark, sf):
    return labels.function_names(extracted_df(spark, sf))


def q_function_labels(spark, sf):
    return labels.function_labels(functions_df(spark, sf)).withColumn("start_line", F.col("start_line").cast("bigint"))


def q_function_labels_note(spark, sf):
    ex = extracted_df(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)  # read by two branches
    return labels.function_labels_note(ex, fx.label_functions(ex)).withColumn(
        "start_line", F.col("start_line").cast("bigint"))


def q_line_labels(spark, sf):
    return labels.line_labels(functions_df(spark, sf)).select("file_id", "name", "label", *_long("line_no"))


# --- step 4: analytics ------------------------------------------------------
def q_testcase_summary(spark, sf):
    return grouping.testcase_summary(catalog(spark, sf), functions_df(spark, sf))


def q_dataset_summary(spark, sf):
    return grouping.dataset_summary(catalog(spark, sf), functions_df(spark, sf))


def q_threshold_retention(spark, sf):
    return stats.threshold_retention(functions_df(spark, sf), P.NOTEBOOK_THRESHOLDS)


def _fn_stat(op):
    return lambda spark, sf: op(functions_df(spark, sf))


# --- step 5: curation -------------------------------------------------------
def flaws_df(spark, sf):
    return mf.manifest_flaws(mf.manifest_from_corpus(long_corpus(spark, sf)))


def testcase_df(spark, sf):
    return curate.testcase_table(curate.ingest_files(long_corpus(spark, sf)), flaws_df(spark, sf))


def cases_df(spark, sf):
    return curate.prefix_split(testcase_df(spark, sf))


def windows_df(spark, sf):
    return windows.line_windows(cases_df(spark, sf))


def split_windows_df(spark, sf):
    return windows.hash_split(windows_df(spark, sf), ["file_id"])


def _flaw_rows(flaws):
    return flaws.select(F.col("doc_pos").cast("bigint").alias("doc_pos"), F.col("file_pos").cast("bigint").alias("file_pos"),
                        "file_name", "cwe", "vulnerability_location", "n_lines")


def q_manifest_flaws(spark, sf):
    return _flaw_rows(flaws_df(spark, sf))


def q_manifest_nested(spark, sf):
    return _flaw_rows(mf.manifest_flaws(mf.nested_manifest(corpus(spark, sf))))


def q_manifest_rejects(spark, sf):
    return mf.manifest_rejects(mf.nested_manifest(corpus(spark, sf))).select("doc_pos", F.length("xml").cast("bigint").alias("n_chars"))


def q_manifest_join(spark, sf):
    return testcase_df(spark, sf).drop("content")


def q_prefix_split(spark, sf):
    c = cases_df(spark, sf)
    return c.select("file_id", F.col("model_id").cast("bigint").alias("model_id"), "file_name", "file_extension", "cwe",
                    "vulnerability_location", F.md5("file_content").alias("content_md5"))


def q_cases(spark, sf):
    """The Cases load: audited rows."""
    good, _ = curate.audited_cases(testcase_df(spark, sf))
    return good.select("file_id", F.col("model_id").cast("bigint").alias("model_id"), "file_name", "cwe", "vulnerability_location",
                       F.md5("file_content").alias("content_md5"))


def q_case_rejects(spark, sf):
    _, bad = curate.audited_cases(testcase_df(spark, sf))
    return bad.withColumn("model_id", F.col("model_id").cast("bigint"))


def q_line_windows_one_based(spark, sf):
    w = windows.line_windows(cases_df(spark, sf), numeric_class=True, one_based=True)
    return w.select("file_id", *_long("cwe_int", "vulnerability_location"), F.md5("vlw_content").alias("content_md5"))


def q_window_rejects(spark, sf):
    """Rows whose location is no number (several locations are no single-location rows)."""
    odd = cases_df(spark, sf).withColumn("vulnerability_location", F.when(F.col("file_id") % 9 == 0, F.concat(F.lit("L"), "vulnerability_location"))
                                         .otherwise(F.col("vulnerability_location")))
    return windows.window_rejects(odd).select("file_id", "file_name", "vulnerability_location")


def q_pk_violations(spark, sf):
    cases = cases_df(spark, sf)
    return curate.key_violations(cases, ["model_id", "file_name"], "Cases").unionByName(
        curate.key_violations(windows.line_windows(cases), ["file_name"], "VLW2"))


def q_class_histogram(spark, sf):
    return curate.class_histogram(windows_df(spark, sf)).withColumn("total", F.col("total").cast("bigint"))


# --- step 6: windows and features --------------------------------------------
def q_line_windows(spark, sf):
    return windows_df(spark, sf).select(
        "file_id", "file_name", "cwe", *_long("cwe_int", "vulnerability_location", "offset", "model_id"), "vlw_content")


def q_hash_split(spark, sf):
    return split_windows_df(spark, sf).select("file_id", "file_name", F.col("model_id").cast("bigint").alias("model_id"), "split")


def q_exact_split(spark, sf):
    return windows.hash_split(windows_df(spark, sf).select("file_id"), ["file_id"], exact=True)


def staged_windows(spark, sf):
    """Windows with their split, for queries that read them more than once."""
    return staged(windows.hash_split(windows_df(spark, sf), ["file_id"]), "windows")


def tokens_of(w):
    return features.window_tokens(w, P.WINDOW_LINES)


def q_vocab(spark, sf):
    return features.vocab(tokens_of(windows_df(spark, sf)))


def encoded_of(w):
    t = tokens_of(w)
    return features.encode(t, features.vocab(t))


def q_token_encode(spark, sf):
    return encoded_of(staged_windows(spark, sf)).select(
        "file_id", F.col("line_no").cast("bigint").alias("line_no"), F.array_join("ids", " ").alias("ids"))


def q_token_lengths(spark, sf):
    longest = features.longest_line(split_windows_df(spark, sf), P.WINDOW_LINES)
    return longest.rollup("split").agg(F.max("n_tokens").cast("bigint").alias("max_tokens")).select(
        F.coalesce("split", F.lit("ALL")).alias("split"), "max_tokens")


def training_df(spark, sf):
    w = staged_windows(spark, sf)
    return features.training_rows(w, encoded_of(w), P.WINDOW_LINES, P.TOKENS_PER_LINE)


def q_training_rows(spark, sf):
    t = training_df(spark, sf)
    seq = F.array_join(F.transform("seq", lambda x: F.array_join(x, ",")), "|")
    return t.select("file_id", "file_name", "split", seq.alias("seq"), F.array_join("label", ",").alias("label"))


def q_training_rejects(spark, sf):
    """Every seventh location is moved past the window, so that both kinds of rejects stand in the result."""
    moved = split_windows_df(spark, sf).withColumn("vulnerability_location", F.col("vulnerability_location") + F.when(
        F.col("file_id") % 7 == 0, P.WINDOW_LINES).otherwise(0))
    r = features.training_rejects(moved, P.WINDOW_LINES)
    return r.select("file_id", "file_name", "split", *_long("n_lines", "vulnerability_location"), "reason")


def q_window_lines(spark, sf):
    """The lines of every window by the SQL table function."""
    register_sql_functions(spark)
    before, after = windows.window_offsets(F.col("file_id"), P.WINDOW_LINES)
    located = cases_df(spark, sf).filter(~F.col("vulnerability_location").contains(",")).select(
        "file_id", "file_content", F.trim("vulnerability_location").try_cast("int").alias("location"),
        before.cast("int").alias("lines_before"), after.cast("int").alias("lines_after"))
    return spark.sql("SELECT c.file_id, CAST(w.line_no AS BIGINT) AS line_no, w.line, w.line_no = least(c.location, c.lines_before) AS is_location "
                     "FROM {cases} c, LATERAL window_lines(c.file_content, c.location, c.lines_before, c.lines_after) w", cases=located)


def q_shape_audit(spark, sf):
    a = features.shape_audit(training_df(spark, sf), P.WINDOW_LINES, P.TOKENS_PER_LINE)
    return a.select(*[F.col(c).cast("bigint").alias(c) for c in a.columns])


def q_batches(spark, sf):
    # written once: the block scan samples its input before it reads it
    rows = staged(features.training_labels(split_windows_df(spark, sf), P.WINDOW_LINES), "labels")
    b = features.batches(rows)
    return b.select("split", "batch_id", *_long("n_rows", "label_pos_sum", "first_file_id"))


# --- step 7: vectors ----------------------------------------------------------
def _vector_inputs(spark, sf):
    t = tokens_of(staged_windows(spark, sf))
    return t, features.vocab(t), table(spark, sf, "embeddings")


def q_embedding_lookup(spark, sf):
    return features.token_vectors(*_vector_inputs(spark, sf))


def q_sequence_vectors(spark, sf):
    """The ordered vectors of each line as whole numbers, hashed."""
    t, vocabulary, vectors = _vector_inputs(spark, sf)
    digits = lambda v: F.array_join(F.transform(v, lambda x: F.round(x * 10000).cast("bigint").cast("string")), ",")
    lines = features.sequence_vectors(features.token_ids(t, vocabulary), vectors, digits)
    return lines.select("file_id", F.col("line_no").cast("bigint").alias("line_no"), F.size("vectors").cast("bigint").alias("n_tokens"),
                        F.md5(F.array_join("vectors", ";")).alias("vectors_md5"))


def q_sequence_attention(spark, sf):
    return features.sequence_attention(*_vector_inputs(spark, sf))


def q_mean_pool(spark, sf):
    return features.mean_pool(table(spark, sf, "embeddings"))


def q_attention_pool(spark, sf):
    return features.attention_pool(table(spark, sf, "embeddings"))


# --- step 8: evaluation --------------------------------------------------------
def scores_df(spark, sf):
    return evaluate.scores_from_tables(table(spark, sf, "labels"), table(spark, sf, "documents"))


def epochs_df(spark, sf):
    return evaluate.epochs_from_events(table(spark, sf, "events"))


def q_auroc(spark, sf):
    """Both labels in one pass."""
    s = scores_df(spark, sf).withColumn("score", evaluate.sigmoid(F.col("score")))
    pairs = F.array(*[F.struct(F.lit(name).alias("label_name"), F.col(c).alias("y")) for name, c in (("toxic", "label"), ("quality", "quality"))])
    return evaluate.auroc_by(s.select("score", F.inline(pairs)), ["label_name"], "score", "y")


#: Size of the registered search: trials and steps of each.
TRIALS, STEPS = 8, 6


def cells_df(spark, sf):
    return search.hashed_cells(split_windows_df(spark, sf))


def configurations(spark):
    """The search space's rows; learning rates are for full gradients of a linear model."""
    rows = evaluate.search_space(spark.range(TRIALS).select(F.col("id").alias("trial"))).orderBy("trial").collect()
    return [{**r.asDict(), "lr": r.lr * 1000} for r in rows]


def q_search_trials(spark, sf):
    return search.search(cells_df(spark, sf), configurations(spark), STEPS)


def q_search_best(spark, sf):
    return search.best_configuration(q_search_trials(spark, sf))


def q_model_evaluation(spark, sf):
    return search.evaluation(search.out_of_fold_scores(cells_df(spark, sf), configurations(spark)[0], STEPS))


def q_model_curve(spark, sf):
    return search.curve(cells_df(spark, sf), configurations(spark)[0], STEPS)


QUERIES: dict[str, Query] = {
    "lines": q_lines,
    "strip_keep_newlines": q_strip_keep_newlines,
    "strip_keep_layout": q_strip_keep_layout,
    "strip_all": q_strip_all,
    "comment_audit": q_comment_audit,
    "testcase_groups": q_testcase_groups,
    "testcase_limit": q_testcase_limit,
    "file_counts": q_file_counts,
    "subfolders": q_subfolders,
    "functions": q_functions,
    "function_names": q_function_names,
    "function_labels": q_function_labels,
    "function_labels_note": q_function_labels_note,
    "line_labels": q_line_labels,
    "testcase_summary": q_testcase_summary,
    "dataset_summary": q_dataset_summary,
    "threshold_retention": q_threshold_retention,
    "size_stats": _fn_stat(stats.size_stats),
    "size_histogram": _fn_stat(stats.size_histogram),
    "size_histogram_by_label": _fn_stat(stats.size_histogram_by_label),
    "size_boxplot": _fn_stat(stats.size_boxplot),
    "size_ecdf": _fn_stat(stats.size_ecdf),
    "size_middle": _fn_stat(stats.size_middle),
    "size_smallest": _fn_stat(stats.size_smallest),
    "size_largest": _fn_stat(stats.size_largest),
    "manifest_flaws": q_manifest_flaws,
    "manifest_nested": q_manifest_nested,
    "manifest_rejects": q_manifest_rejects,
    "manifest_join": q_manifest_join,
    "prefix_split": q_prefix_split,
    "cases": q_cases,
    "case_rejects": q_case_rejects,
    "line_windows_one_based": q_line_windows_one_based,
    "window_rejects": q_window_rejects,
    "pk_violations": q_pk_violations,
    "class_histogram": q_class_histogram,
    "line_windows": q_line_windows,
    "hash_split": q_hash_split,
    "vocab": q_vocab,
    "token_encode": q_token_encode,
    "token_lengths": q_token_lengths,
    "training_rows": q_training_rows,
    "training_rejects": q_training_rejects,
    "window_lines": q_window_lines,
    "shape_audit": q_shape_audit,
    "batches": q_batches,
    "embedding_lookup": q_embedding_lookup,
    "sequence_vectors": q_sequence_vectors,
    "sequence_attention": q_sequence_attention,
    "mean_pool": q_mean_pool,
    "attention_pool": q_attention_pool,
    "auroc": q_auroc,
    "bce_loss": lambda spark, sf: evaluate.bce(scores_df(spark, sf)),
    "weighted_bce": lambda spark, sf: evaluate.weighted_bce(scores_df(spark, sf)),
    "bce_epoch": lambda spark, sf: evaluate.bce_batched(scores_df(spark, sf), P.BATCH_SIZE),
    "early_stopping": lambda spark, sf: evaluate.early_stopping(epochs_df(spark, sf)),
    "best_trial": lambda spark, sf: evaluate.best_trial(epochs_df(spark, sf)),
    "search_trials": q_search_trials,
    "search_best": q_search_best,
    "model_evaluation": q_model_evaluation,
    "model_curve": q_model_curve,
    "learning_curve": lambda spark, sf: evaluate.learning_curve(epochs_df(spark, sf)),
    "testcase_members": q_testcase_members,
    "first_functions": q_first_functions,
    "audit_rejects": q_audit_rejects,
    "exact_split": q_exact_split,
}
