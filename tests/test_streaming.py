import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from codecorpus.operators import evaluate, grouping, stats
from codecorpus.operators import functions as fx
from codecorpus.sources.files import read_sources
from codecorpus.streaming import summaries
from codecorpus.streaming.early_stop import early_stop_stream
from codecorpus.streaming.ingest import ingest


def test_stream_early_stop_equals_batch(spark, tmp_dir):
    """Reports in any order over several micro-batches, with a restart from the
    checkpoint between them; then every trial idle for long leaves the state."""
    rng = random.Random(11)
    at = lambda seconds: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=seconds)
    rows = [(t, e + (e > 6) * 3, rng.choice([1.0, 2.0, 0.5, 0.25, 3.0, float("nan")]), at(60 * e + t)) for t in range(12) for e in range(rng.randint(1, 15))]
    schema = "trial long, epoch long, valid_loss double, ts timestamp"
    log = spark.createDataFrame(rows, schema)
    src, out = os.path.join(tmp_dir, "reports"), os.path.join(tmp_dir, "stops")

    def run(part, name):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(os.path.join(src, name))
        stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(src)
        q = (early_stop_stream(stream, delay="1 hour", idle_seconds=7200).writeStream.format("parquet").option("path", out).outputMode("append")
             .option("checkpointLocation", os.path.join(tmp_dir, "ckpt")).trigger(availableNow=True).start())
        q.awaitTermination(240)
        return q

    shuffled = rows[:]
    rng.shuffle(shuffled)
    third = len(rows) // 3
    for k, part in enumerate((shuffled[:third], shuffled[third:2 * third], shuffled[2 * third:])):
        run(part, f"p{k}")
    run([(99, 0, 1.0, at(3 * 3600))], "later")  # the watermark passes all reports
    got = sorted((r.trial, r.stop_epoch, r.best_loss) for r in spark.read.parquet(out).collect())
    want = sorted((r.trial, r.stop_epoch) for r in evaluate.early_stopping(log).collect() if r.stop_epoch is not None)
    assert [x[:2] for x in got] == want and len(want) > 3
    low = {t: min(x[2] for x in rows if x[0] == t and x[1] <= e and x[2] == x[2]) for t, e in want}
    assert {t: b for t, _, b in got} == low
    q = run([(99, 1, 1.0, at(30 * 3600))], "much-later")
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert held[-1] == 1  # the last reporter only


def test_incremental_ingest(spark, tmp_dir):
    root = os.path.join(tmp_dir, "src")
    os.makedirs(os.path.join(root, "CWE1"))
    with open(os.path.join(root, "CWE1", "CWE1_A_01_bad.c"), "w") as f:
        f.write("void bad()\n{\n  a = 1; b = 2; c = 3;\n}\n")
    out = os.path.join(tmp_dir, "functions")
    ckpt = os.path.join(tmp_dir, "ingest-ckpt")
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            ingest(spark, root, out)
    ingest(spark, root, out, checkpoint=ckpt).awaitTermination(240)
    assert [r.name for r in spark.read.parquet(out).collect()] == ["bad"]
    with open(os.path.join(root, "CWE1", "CWE1_A_01_good.java"), "w") as f:
        f.write("public void good() {\n  x = 1; y = 2; z = 3;\n}\n")
    ingest(spark, root, out, checkpoint=ckpt).awaitTermination(240)
    names = sorted(r.name for r in spark.read.parquet(out).collect())
    assert names == ["bad", "good"]   # the first file is not processed again


def test_totals_of_several_arrivals_equal_the_batch(spark, tmp_dir):
    root, out, states, ckpt = (os.path.join(tmp_dir, x) for x in ("src", "functions", "states", "ckpt"))
    r = random.Random(2)
    for arrival in range(3):
        for k in range(6):
            ext = r.choice(["c", "java", "cs", "cpp", "txt"])
            path = os.path.join(root, f"d{r.randint(0, 2)}", f"CWE{k}_A_{arrival:02d}_{r.choice(['bad', 'good'])}.{ext}")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w") as f:
                f.write("".join(f"void {r.choice(['bad', 'goodSink', 'x'])}() {{\n" + "  a = 1;\n" * r.randint(3, 9) + "}\n" for _ in range(r.randint(0, 3))))
        ingest(spark, root, out, checkpoint=ckpt, states_path=states).awaitTermination(240)
    files = read_sources(spark, root)
    catalog, functions = fx.catalog(files), fx.functions(fx.source_files(files))

    def equal():
        rows = lambda d: sorted(map(tuple, d.select(sorted(d.columns)).collect()), key=repr)
        assert rows(summaries.testcase_summary(spark, states)) == rows(grouping.testcase_summary(catalog, functions))
        assert rows(summaries.dataset_summary(spark, states)) == rows(grouping.dataset_summary(catalog, functions))
        assert rows(summaries.size_stats(spark, states)) == rows(stats.size_stats(functions))

    equal()
    assert len([x for x in os.listdir(os.path.join(states, "case_states")) if x.startswith("batch_id=")]) == 3
    # a replay of the last batch replaces its rows
    last = spark.read.parquet(out).filter("batch_id = 2").select(functions.columns)
    newest = spark.read.parquet(os.path.join(states, "case_states")).filter("batch_id = 2")
    before = sorted(map(tuple, newest.collect()), key=repr)
    batch = files.filter(F.regexp_extract("path", "_A_02_", 0) != "")
    summaries.write_states(fx.catalog(batch), last, states, 2)
    assert sorted(map(tuple, spark.read.parquet(os.path.join(states, "case_states")).filter("batch_id = 2").collect()), key=repr) == before
    equal()
