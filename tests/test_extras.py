import pytest
from pyspark.sql import functions as F

from codecorpus.functions.code import cwe_number, split_name
from codecorpus.functions.sql import register_sql_functions
from codecorpus.operators.grouping import first_k
from codecorpus.operators.windows import hash_split
from codecorpus.session import checkpoint_dir


def test_sql_functions(spark):
    register_sql_functions(spark)
    texts = ["a // b\nc /* x\ny */ d //z\n", "p\n// end", "q = 1; /* */"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df.createOrReplaceTempView("texts")
    rows = spark.sql("SELECT strip_keep_newlines(t) AS a, strip_keep_layout(t) AS b, strip_all(t) AS c "
                     "FROM texts ORDER BY i").collect()
    assert [r.a for r in rows] == ["a \nc \n d //z\n", "p\n", "q = 1; "]
    assert [r.b for r in rows] == ["a     \nc     \n     d    \n", "p\n      ", "q = 1;      "]
    assert [r.c for r in rows] == ["a \nc  d //z\n", "p\n", "q = 1; "]
    assert spark.sql("SELECT function_label('helper_badSink', '') AS l").collect()[0].l == "POSITIVE"


def test_sql_table_functions(spark):
    register_sql_functions(spark)
    rows = [(1, "a\nb\n\nd\n", 1), (2, "", 0), (3, None, 0), (4, "x\ny", 7), (5, "x\ny\nz", None)]
    spark.createDataFrame(rows, "id int, t string, at int").createOrReplaceTempView("sources")
    lines = spark.sql("SELECT s.id, l.* FROM sources s, LATERAL source_lines(s.t) l").collect()
    assert sorted(map(tuple, lines)) == sorted((i, k, x) for i, t, _ in rows if t is not None for k, x in enumerate(t.split("\n")))
    found = spark.sql("SELECT s.id, w.* FROM sources s, LATERAL window_lines(s.t, s.at, 2, 1) w").collect()
    want = []
    for i, t, at in rows:
        lines = (t or "").split("\n")
        if t is not None and at is not None and at < len(lines):
            start = max(0, at - 2)
            want += [(i, k, x) for k, x in enumerate(lines[start:at + 2])]
    assert sorted(map(tuple, found)) == sorted(want)
    for call in ("source_lines(s.t)", "window_lines(s.t, s.at, 2, 1)"):  # one narrow step, no join on the text
        plan = spark.sql(f"EXPLAIN SELECT s.id, w.* FROM sources s, LATERAL {call} w").collect()[0][0]
        assert "Generate" in plan and "Exchange" not in plan and "Join" not in plan
    many = spark.sql("SELECT count(*) AS n, count(DISTINCT s.id) AS k FROM range(2000) s, LATERAL source_lines(concat('a', char(10), s.id)) l")
    assert tuple(many.collect()[0]) == (4000, 2000)


def test_first_k_and_names(spark):
    df = spark.range(50).select((F.col("id") % 4).alias("g"), "id")
    top = first_k(df, ["g"], [F.desc("id")], 2).collect()
    assert sorted((r.g, r.id) for r in top) == [(0, 44), (0, 48), (1, 45), (1, 49), (2, 42), (2, 46), (3, 43), (3, 47)]
    names = spark.createDataFrame([(0,), (1,), (2,)], "m int").select(split_name(F.col("m"))).collect()
    assert [r[0] for r in names] == ["training", "testing", "validation"]
    ids = spark.createDataFrame([("CWE-121: Stack",), ("CWE78",), ("none",)], "c string").select(cwe_number(F.col("c"))).collect()
    assert [r[0] for r in ids] == [121, 78, None]


def test_exact_hash_split(spark):
    rows = spark.range(101).withColumnRenamed("id", "file_id")
    out = hash_split(rows, ["file_id"], 20, exact=True)
    assert out.filter("split = 'test'").count() == 21   # ceil(0.2 * 101)
    approx = hash_split(rows, ["file_id"], 20)
    assert approx.count() == 101


def test_a_cluster_needs_a_shared_folder():
    class Context:
        def __init__(self, master, folder=None):
            self.master, self.folder = master, folder

        def getConf(self):
            return {"spark.checkpoint.dir": self.folder} if self.folder else {}

        def getCheckpointDir(self):
            return self.folder

    session = lambda *a: type("S", (), {"sparkContext": Context(*a)})()
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            checkpoint_dir(session(master))
        assert checkpoint_dir(session(master, "hdfs://x/ckpt")) == "hdfs://x/ckpt"
