import numpy as np
import pytest
from pyspark.sql import functions as F

from codecorpus.operators import curate, features, windows


def _cases(spark, rows):
    return spark.createDataFrame(rows, "file_id long, model_id int, file_name string, file_content string, "
                                       "cwe string, vulnerability_location string")


def test_windows_invariants(spark):
    text = "\n".join(f"line{i}" for i in range(60))
    rows = [(1, 0, "a.c", text, "CWE-1", "30"), (2, 0, "b.c", text, "CWE-1", "2"), (3, 1, "c.c", text, "CWE-1", "60"),
            (4, 1, "d.c", text, "CWE-1", "3,9"), (5, 2, "e.c", text, "CWE-1", "x"), (6, 2, "f.c", text, "CWE-1", " 59 ")]
    w = {r.file_id: r for r in windows.line_windows(_cases(spark, rows), 40).collect()}
    assert set(w) == {1, 2, 3, 6}                       # multi-location and unparsable rows are not windowed
    assert w[3].vlw_content == "" and w[3].vulnerability_location is None   # past the end (T6)
    for fid, loc in ((1, 30), (2, 2), (6, 59)):
        lines = w[fid].vlw_content.split("\n")
        assert len(lines) <= 40
        assert lines[w[fid].vulnerability_location] == f"line{loc}"   # 0-based location (T5)
    full = w[1].vlw_content.split("\n")
    assert len(full) == 40 or full[0] == "line0" or full[-1] == "line59"  # clipped only at a file edge
    assert windows.window_rejects(_cases(spark, rows)).count() == 1


def test_pad_truncate_and_one_hot(spark):
    df = spark.createDataFrame([(list(range(1, 101)),), ([],), ([5, 6],)], "a array<int>")
    out = [r[0] for r in df.select(features.pad_truncate(F.col("a"), 98)).collect()]
    assert out[0] == list(range(3, 101))               # last 98 kept
    assert out[1] == [0] * 98 and out[2] == [5, 6] + [0] * 96
    oh = [r[0] for r in spark.createDataFrame([(0,), (39,), (40,)], "i int").select(features.one_hot(F.col("i"), 40)).collect()]
    assert oh[0][0] == 1 and sum(oh[0]) == 1 and oh[1][39] == 1 and oh[2] is None


def test_training_rows_shapes(spark):
    text = "\n".join(" ".join(f"w{j}" for j in range(i % 120)) for i in range(100))
    rows = [(i, i % 3, f"f{i}.c", text, "CWE-1", str(20 + i)) for i in range(20)]
    win = windows.hash_split(windows.line_windows(_cases(spark, rows), 40), ["file_id"])
    toks = features.window_tokens(win, 40)
    enc = features.encode(toks, features.vocab(toks))
    tr = features.training_rows(win, enc, 40, 98)
    audit = features.shape_audit(tr, 40, 98).collect()[0]
    assert audit.rows == tr.count() > 0 and audit.bad_seq == 0 and audit.bad_label == 0
    b = features.batches(tr, 4).collect()
    assert all(r.n_rows == 4 for r in b)


def test_prefix_split_counts_and_small_languages(spark):
    rows = [(i, f"CWE1_{i}.c", ".c", f"/r/{i:03d}", f"x{i} // c", "CWE-1", "1") for i in range(25)] + [
        (100, "CWE1_j.java", ".java", "/r/j", "y", "CWE-1", "1")]
    t = spark.createDataFrame(rows, "file_id long, file_name string, file_extension string, path string, content string, "
                                    "cwe string, vulnerability_location string")
    got = {r.file_id: r.model_id for r in curate.prefix_split(t).collect()}
    assert [got[i] for i in range(25)] == [0] * 17 + [1] * 5 + [2] * 3   # trunc(70 %), trunc(20 %), the rest
    assert got[100] == 2                                                  # one file: both counts are 0


def _sequences(spark):
    toks = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 2, "a"), (1, 0, 1, "b"), (1, 3, 0, "c"), (2, 0, 0, "b")],
                                 "file_id long, line_no int, pos int, token string")
    voc = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2000)], "token string, token_id long")
    emb = spark.createDataFrame([(1, [3.0, 6.0, 1.0]), (2000, [300.0, -900.0, 2.0]), (7, [0.0] * 3), (7, [0.0] * 3)], "vec_id long, embedding array<float>")
    return toks, voc, emb


def test_token_vectors_count_unmatched_tokens_as_zero(spark):
    toks, voc, emb = _sequences(spark)
    got = sorted(tuple(r) for r in features.token_vectors(toks, voc, emb).collect())
    assert got == [(1, 0, 4, 3, 76.5), (1, 1, 4, 3, -222.0), (1, 2, 4, 3, 1.0), (2, 0, 1, 0, 0.0), (2, 1, 1, 0, 0.0), (2, 2, 1, 0, 0.0)]


def test_vectors_in_token_order(spark):
    """Frequent and rare tokens alike, whatever the boundary between them."""
    toks, voc, emb = _sequences(spark)
    ids = features.token_ids(toks, voc)
    want = {(1, 0): [[3.0, 6.0, 1.0], [0.0] * 3, [3.0, 6.0, 1.0]], (1, 3): [[300.0, -900.0, 2.0]], (2, 0): [[0.0] * 3]}
    got = {(r.file_id, r.line_no): r.vectors for r in features.sequence_vectors(ids, emb).collect()}
    assert got == want
    for hot in (0, 1, 5000):
        rows = features.with_vectors(ids, emb, hot).collect()
        assert len(rows) == 5 and sorted((r.token_id, r.vec is not None) for r in rows) == [(1, True), (1, True), (2, False), (2, False), (2000, True)]
    with pytest.raises(ValueError):
        features.vector_length(emb.unionByName(spark.createDataFrame([(9, [1.0])], emb.schema)))


@pytest.mark.parametrize("dims,weights", [(3, None), (70, None), (3, [2.0, -30.0, 0.5])])
def test_softmax_pool_equals_numpy(spark, dims, weights):
    """Scores far apart, a hot key, repeated positions, any number of dimensions."""
    r = np.random.default_rng(3)
    rows = [(int(k), (r.normal(size=dims) * r.choice([1, 40, 900])).tolist(), int(r.integers(1, 4))) for k in [0] * 50 + [1, 2, 2]]
    df = spark.createDataFrame(rows, "k long, vec array<double>, n long").repartition(5)
    w = np.array(weights or [((d % 7) - 3) / 10 for d in range(dims)])
    for x in features.softmax_pool(df, "k", weights).collect():
        v = np.array([v for k, v, n in rows if k == x.k for _ in range(n)])
        e = np.exp(v @ w - (v @ w).max())
        assert np.allclose(x.pooled, (e[:, None] * v).sum(0) / e.sum())


def test_longest_line_and_labels(spark):
    text = "\n".join(["a b  c", "", "d"] + ["x"] * 37)
    rows = [(1, 0, "a.c", text, "CWE-12", "3"), (2, 0, "b.c", "\n".join([""] * 50), "CWE-7", "3")]
    win = windows.line_windows(_cases(spark, rows), 40, numeric_class=True, one_based=True).withColumn("split", F.lit("train"))
    assert {r.file_id: r.cwe_int for r in win.collect()} == {1: 12, 2: 7}
    for r in win.collect():  # one-based: line 3 is index 2
        assert r.vlw_content == "" or r.vlw_content.split("\n")[r.vulnerability_location] in ("d", "")
    assert {r.file_id: r.n_tokens for r in features.longest_line(win, 40).collect()}.get(2) is None
    tr = features.training_labels(win, 40).collect()
    assert all(sum(r.label) == 1 for r in tr)


def test_training_rejects(spark):
    full = "\n".join("abcd")
    rows = [(1, full, 0), (2, full, 3), (3, full, 4), (4, full, -1), (5, full, None), (6, "a\nb", 9), (7, "", None), (8, None, 0), (9, full + "\ne", 1)]
    w = spark.createDataFrame([(i, f"f{i}", "test", t, at) for i, t, at in rows],
                              "file_id long, file_name string, split string, vlw_content string, vulnerability_location int")
    got = {r.file_id: (r.n_lines, r.reason) for r in features.training_rejects(w, 4).collect()}
    assert got == {3: (4, "location out of range"), 4: (4, "location out of range"), 5: (4, "no location"),
                   6: (2, "lines"), 7: (1, "lines"), 8: (1, "lines")}
    # a window is a row with a label, or a reject
    labelled = features.training_labels(w, 4).filter("label is not null")
    assert sorted(r.file_id for r in labelled.collect()) == [1, 2, 9]


def test_vectors_of_frequent_tokens_are_not_shuffled(spark):
    """Only ids travel to a file's partition: the vector is met after the last exchange, once a file."""
    toks, voc, emb = _sequences(spark)
    for pooled in (features.token_vectors(toks, voc, emb), features.sequence_attention(toks, voc, emb),
                   features.sequence_vectors(features.token_ids(toks, voc), emb)):
        plan = pooled._jdf.queryExecution().executedPlan().toString()
        last = plan.index("Exchange hashpartitioning(file_id")  # nothing above the join deals rows out again
        assert "Exchange" not in plan[:last].replace("BroadcastExchange", "") and "BroadcastHashJoin" in plan[:last]


def test_score_is_made_once_a_vector(spark):
    """Attention takes the scores that travel with the vectors: as by scoring every row."""
    toks, voc, emb = _sequences(spark)
    for weights in (None, [0.01, -0.02, 0.5]):
        got = {(r.file_id, r.dim): r.value for r in features.sequence_attention(toks, voc, emb, weights).collect()}
        w = np.array(weights or [((d % 7) - 3) / 10 for d in range(3)])
        v = np.array([[3.0, 6.0, 1.0], [3.0, 6.0, 1.0], [0.0] * 3, [300.0, -900.0, 2.0]])
        e = np.exp(v @ w - (v @ w).max())
        assert np.allclose([got[1, d] for d in range(3)], (e[:, None] * v).sum(0) / e.sum(), atol=1e-4)
        assert [got[2, d] for d in range(3)] == [0.0] * 3


def test_form_of_vectors(spark):
    """A form is made once a vector, frequent, rare or missing."""
    toks, voc, emb = _sequences(spark)
    text = lambda v: F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), ",")
    got = {(r.file_id, r.line_no): r.vectors for r in features.sequence_vectors(features.token_ids(toks, voc), emb, text).collect()}
    assert got == {(1, 0): ["3,6,1", "0,0,0", "3,6,1"], (1, 3): ["300,-900,2"], (2, 0): ["0,0,0"]}
    assert features.hot_tokens(64) == 1 << 17 and features.hot_tokens(1024) == 1 << 13  # bounded by numbers, not by the table


def test_manifest_is_made_once(spark, tmp_dir):
    """Every reader of the test cases reads the manifest's rows as written, and no text moves for a small one."""
    flaws = spark.createDataFrame([(0, 0, "a/CWE1.c", "CWE-1", "3"), (1, 0, "CWE1.c", "CWE-2", "4")],
                                  "doc_pos int, file_pos int, file_name string, cwe string, vulnerability_location string")
    calls = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            calls.add(len(f))
            yield f

    seen = flaws.mapInPandas(counted, flaws.schema)
    files = spark.createDataFrame([(1, "/r", "/r/CWE1.c", "CWE1.c", ".c", "x // y\nz"), (2, "/r", "/r/CWE2.c", "CWE2.c", ".c", "x")],
                                  "file_id long, folder string, path string, file_name string, file_extension string, content string")
    table = curate.testcase_table(files, seen)
    good, bad = curate.audited_cases(table)
    assert [(r.file_id, r.cwe, r.vulnerability_location, r.file_content) for r in good.collect()] == [(1, "CWE-2", "4", "x \nz")]
    assert bad.count() == 0 and table.count() == 1
    assert calls.value == 2
    small = spark.read.parquet(_written(files, tmp_dir))
    assert "SortMergeJoin" not in curate.testcase_table(small, flaws)._jdf.queryExecution().sparkPlan().toString()


def _written(rows, folder):
    rows.write.parquet(f"{folder}/files")
    return f"{folder}/files"
