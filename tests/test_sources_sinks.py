import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecorpus import schemas, sinks
from codecorpus.operators import curate
from codecorpus.sources import files as src
from codecorpus.sources import manifest as mf


def _tree(root):
    files = {
        "CWE1/CWE1_A_01.c": b"int f()\r\n{\r\n  a(); b(); c();\r\n}\r\n",
        "CWE1/CWE1_A_02.java": b"class X {}\n",
        "CWE1/helper.c": b"void h() {}\n",
        "CWE1/CWE1_A_03.cs": b"void c() {}\n",
        "CWE1/deep/CWE1_A_04.cpp": b"\xff\xfe bad bytes\n",
        "CWE1_Root_05.c": b"root file\n",
    }
    for p, data in files.items():
        full = os.path.join(root, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(data)


def test_analysis_and_ingest_readers(spark, tmp_dir):
    _tree(tmp_dir)
    names = sorted(os.path.basename(r.path) for r in src.read_sources(spark, tmp_dir).collect())
    assert names == ["CWE1_A_01.c", "CWE1_A_02.java", "CWE1_A_03.cs", "CWE1_A_04.cpp", "CWE1_Root_05.c", "helper.c"]
    crlf = [r.content for r in src.read_sources(spark, tmp_dir).collect() if r.path.endswith("01.c")][0]
    assert "\r" not in crlf
    good, bad = src.read_ingest(spark, tmp_dir)
    assert sorted(os.path.basename(r.path) for r in good.collect()) == ["CWE1_A_01.c", "CWE1_A_02.java"]
    assert [os.path.basename(r.path) for r in bad.collect()] == ["CWE1_A_04.cpp"]   # invalid UTF-8 -> rejects
    assert src.read_sources(spark, os.path.join(tmp_dir, "missing")).count() == 0     # SRC-8
    nav = src.with_subfolders(good).collect()
    assert len(nav) == 2 and len({r.subfolder_id for r in nav}) == 1 and nav[0].folder_name.endswith("CWE1")


def test_manifest_file_and_last_wins(spark, tmp_dir):
    xml = ('<container><testcase><file path="a/CWE1_A_01.c"><flaw line="3" name="CWE-1: X"/></file></testcase>'
           '<testcase><file path="b/CWE1_A_01.c"><flaw line="7" name="CWE-1: X"/><flaw line="9" name="CWE-2: Y"/>'
           '<mixed line="1"/></file><file path="c.c"><fix line="2"/></file></testcase></container>')
    p = os.path.join(tmp_dir, "manifest.xml")
    with open(p, "w") as f:
        f.write(xml)
    flaws = mf.manifest_flaws(mf.read_manifest(spark, p))
    rows = sorted((r.file_name, r.cwe, r.vulnerability_location) for r in flaws.collect())
    assert rows == [("a/CWE1_A_01.c", "CWE-1: X", "3"), ("b/CWE1_A_01.c", "CWE-2: Y", "7,9")]
    last = curate.last_wins(flaws).collect()
    assert [(r.file_name, r.cwe, r.vulnerability_location) for r in last] == [("CWE1_A_01.c", "CWE-2: Y", "7,9")]


def test_write_checked_is_all_or_nothing(spark, tmp_dir):
    df = spark.createDataFrame([(0, "a.c"), (0, "a.c"), (1, "a.c")], "model_id int, file_name string")
    out = os.path.join(tmp_dir, "cases")
    with pytest.raises(sinks.KeyViolation):
        sinks.write_checked(df, out, ["model_id", "file_name"], ["model_id"])
    assert not os.path.exists(out)
    sinks.write_checked(df.distinct(), out, ["model_id", "file_name"], ["model_id"])
    assert spark.read.parquet(out).count() == 2
    ep, reports = os.path.join(tmp_dir, "ep"), spark.createDataFrame([(1, 0, 0.5, 0.4, 0.6)], schemas.EPOCHS)
    for load in ("a", "a", "b"):  # a retried load replaces its reports
        sinks.append_epochs(reports, ep, load)
    assert sinks.read_epochs(spark, ep).count() == 2


def test_loads_and_exports(spark, tmp_dir):
    _tree(tmp_dir)
    xml = ('<container><testcase><file path="CWE1_A_01.c"><flaw line="2" name="CWE-1: X"/></file>'
           '<file path="CWE1_A_02.java"><flaw line="0" name="CWE-1: X"/></file></testcase></container>')
    p = os.path.join(tmp_dir, "manifest.xml")
    with open(p, "w") as f:
        f.write(xml)
    good, bad = src.read_ingest(spark, tmp_dir)
    flaws, out = mf.manifest_flaws(mf.read_manifest(spark, p)), os.path.join(tmp_dir, "loads")
    keys = {"Folder": "folder_id long, folder_name string", "SubFolder": "subfolder_id long, folder_name string, folder_id long",
            "TestCaseRejects": "file_id long, path string, reason string"}
    read = lambda n: sinks.published(spark, out, n, T.StructType.fromDDL(keys[n]) if n in keys else T.StructType(
        [*schemas.TESTCASE.fields, T.StructField("subfolder_id", T.LongType())])).collect()
    for _ in range(2):  # a repeated load changes nothing
        sinks.load_testcases(good, bad, flaws, out, "first", "Suite")
        assert sorted(r.file_name for r in read("TestCase")) == ["CWE1_A_01.c", "CWE1_A_02.java"]
    folder, sub, rejects = read("Folder"), read("SubFolder"), read("TestCaseRejects")
    assert [f.folder_name for f in folder] == ["Suite"] and {s.folder_id for s in sub} == {folder[0].folder_id}
    assert {t.subfolder_id for t in read("TestCase")} <= {s.subfolder_id for s in sub} and len(sub) == 2
    assert [os.path.basename(r.path) for r in rejects] == ["CWE1_A_04.cpp"] and {r.load_id for r in rejects} == {"first"}
    # a load without its record is not seen
    good.sparkSession.createDataFrame([], "folder_id long, folder_name string").write.parquet(os.path.join(out, "Folder", "load_id=torn"))
    spark.createDataFrame([(7, "torn")], "folder_id long, folder_name string").write.mode("overwrite").parquet(os.path.join(out, "Folder", "load_id=torn"))
    assert [f.folder_name for f in read("Folder")] == ["Suite"]
    with pytest.raises(ValueError):
        sinks.publish({"Folder": good}, out, "../x")
    sinks.create_table(spark, "cases_t", schemas.CASES, os.path.join(tmp_dir, "cases_t"), ["model_id"])
    assert {c.name for c in spark.table("cases_t").schema} == {f.name for f in schemas.CASES.fields}
    tr = spark.createDataFrame([("train", 1, "a.c", [[1, 2]], [1, 0])], schemas.TRAINING)
    at = os.path.join(tmp_dir, "train")
    for load, name in (("x1", "a.c"), ("x2", "b.c"), ("x2", "c.c")):
        sinks.export_training(tr.withColumn("file_name", F.lit(name)), at, load)
        assert [tuple(r) for r in sinks.read_training(spark, at).collect()] == [("train", 1, name, [[1, 2]], [1, 0])]
    assert sinks.read_training(spark, at, "test").count() == 0


def test_cases_load_with_rejects(spark, tmp_dir):
    text = {1: "int a;\n// gone\nint b;\n", 2: "int a;\n// last line", 3: "/* all */", 4: "x\n"}
    cases = spark.createDataFrame([(k, "/d", f"/d/{k}.c", f"CWE{k}.c", ".c", t, "CWE-1", "0") for k, t in text.items()], schemas.TESTCASE)
    out = os.path.join(tmp_dir, "loads")
    for _ in range(2):
        sinks.load_cases(cases, out, "one")
    good = sinks.published(spark, out, "Cases", schemas.CASES).collect()
    assert {r.file_name: r.file_content for r in good} == {"CWE1.c": "int a;\n\nint b;\n", "CWE4.c": "x\n"}
    bad = sinks.published(spark, out, "CaseRejects", T.StructType.fromDDL("file_id long, lines_before long, lines_after long")).collect()
    assert sorted((r.file_id, r.lines_before, r.lines_after) for r in bad) == [(2, 2, 1), (3, 1, 0)]
    with pytest.raises(sinks.KeyViolation):
        sinks.load_cases(cases.unionByName(cases), out, "two")


def test_manifest_at_any_depth_and_rejects(spark, tmp_dir):
    p = os.path.join(tmp_dir, "manifest.xml")
    with open(p, "w") as f:
        f.write("""<?xml version="1.0"?><container><!-- <testcase/> --><suite>
<testcase id='1'><group><file path="a &amp; b.c"><part><flaw line='3' name="one > two"/></part><!-- <flaw line="9" name="no"/> -->
<file path="inner.c"><flaw line="4" name="x"></flaw></file><flaw name="last"/></file></group></testcase>
<testcase/><testcase><file path="torn.c"><flaw line="1" name="n"/></testcase>
<testcase><file path="empty.c"/><filed path="no.c"><flaw line="1" name="n"/></filed></testcase></suite></container>""")
    records = mf.read_manifest(spark, p)
    rows = sorted((r.file_pos, r.file_name, r.cwe, r.vulnerability_location) for r in mf.manifest_flaws(records).collect())
    assert rows == [(0, "a & b.c", "last", "3,4"), (1, "inner.c", "x", "4")]
    assert [("torn.c" in r.xml) for r in mf.manifest_rejects(records).collect()] == [True]


def test_valid_text_keeps_its_replacement_characters(spark):
    raw = spark.createDataFrame([(1, "a.c", "x � é\r\n".encode()), (2, "b.c", "�".encode() + b"\xff a\xe2\x82b \xc3\xa9"),
                                 (3, "c.c", b""), (4, "d.c", None)], "file_id long, path string, content binary")
    got = {r.file_id: r.content for r in src.decode_lenient(raw).collect()}
    assert got == {1: "x � é\n", 2: "� ab é", 3: "", 4: None}
    for bad in (b"\xc0\xaf", b"\xed\xa0\x80z", b"\xf4\x90\x80\x80", "€𝄞".encode() + b"\xf0\x9d"):
        one = spark.createDataFrame([(1, "a.c", bad)], raw.schema)
        assert src.decode_lenient(one).head().content == bad.decode("utf-8", "ignore")


def test_root_files_stay_out_for_any_spelling_of_the_root(spark, tmp_dir):
    _tree(tmp_dir)
    for root in (tmp_dir, tmp_dir + "/", f"file:{tmp_dir}", f"file://{tmp_dir}"):
        good, _ = src.read_ingest(spark, root)
        assert sorted(os.path.basename(r.path) for r in good.collect()) == ["CWE1_A_01.c", "CWE1_A_02.java"]
