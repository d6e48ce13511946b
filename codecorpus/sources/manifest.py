"""Flaw manifests (SRC-1): XML ``testcase``, below it ``file[@path]``, below that
``flaw[@line,@name]``, at any depth.

A record is one outermost ``testcase`` as text.  ``read_manifest`` cuts manifest files
into records where they are read (a file is split between tasks);
``manifest_from_corpus`` renders one record per corpus file so queries can run the
same parser on derived data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecorpus.functions.arrays import bind, running

FLAW = T.StructType([T.StructField("_line", T.StringType()), T.StructField("_name", T.StringType())])
FILE = T.StructType([T.StructField("_path", T.StringType()), T.StructField("flaw", T.ArrayType(FLAW))])
#: A tag with its attributes; what may look like one but is none.
TAG = r"""<(?:[^<>"']|"[^"]*"|'[^']*')*>"""
NOT_ELEMENTS = r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>"
END = "</testcase>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files -> records ``(doc_pos, xml)``, document order kept as (file
    path, block, place in the block).  A testcase inside another one ends its record
    early, which leaves no well-formed record: both are rejects."""
    raw = spark.read.option("lineSep", END).text(path)
    text = F.regexp_replace("value", r"<testcase\b[^<>]*/>", "")  # empty ones
    at = F.locate("<testcase", text)
    return raw.select(
        F.struct(F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("pos")).alias("doc_pos"),
        F.when(at > 0, F.concat(F.substr(text, at), F.lit(END))).alias("xml"),
    ).filter("xml is not null")


def manifest_from_corpus(corpus: DataFrame) -> DataFrame:
    """One ``<testcase>`` XML string per corpus file (``doc_pos = file_id``):
    one ``flaw`` per location; every 11th file ends with a line-less flaw of
    another class (the last flaw names the class), every 13th carries only a
    ``fix`` element (no flaw lines: dropped by the filter)."""
    k = F.col("file_id")
    flaws = F.array_join(
        F.transform(
            F.split(F.col("vulnerability_location"), ","),
            lambda x: F.concat(F.lit('<flaw line="'), x, F.lit('" name="'), F.col("cwe"), F.lit('"/>')),
        ),
        "",
    )
    extra = F.when(k % 11 == 0, F.lit('<flaw name="CWE-000: Other"/>')).otherwise(F.lit(""))
    body = F.when(k % 13 == 0, F.lit('<fix line="1"/>')).otherwise(F.concat(flaws, F.lit('<mixed line="2"/>'), extra))
    xml = F.concat(F.lit('<testcase><file path="'), F.col("file_name"), F.lit('">'), body, F.lit("</file></testcase>"))
    return corpus.select(k.alias("doc_pos"), xml.alias("xml"))


def nested_manifest(corpus: DataFrame) -> DataFrame:
    """The corpus's manifest with its elements at other depths: by ``file_id`` mod
    4 below a group and inside a part, a file inside a file, after a comment that
    looks like a flaw; every 8th record lacks an end tag."""
    k = F.col("file_id")
    flaw = lambda name: F.array_join(F.transform(F.split(F.col("vulnerability_location"), ","), lambda x: F.concat(
        F.lit('<flaw line="'), x, F.lit('" name="'), name, F.lit('"/>'))), "")
    opened = lambda suffix="": F.concat(F.lit('<file path="'), F.col("file_name"), F.lit(f'{suffix}">'))
    inside = (
        F.when(k % 4 == 0, F.concat(F.lit("<group>"), opened(), F.lit("<part>"), flaw(F.col("cwe")), F.lit("</part></file></group>")))
        .when(k % 4 == 1, F.concat(opened(), opened(".inner"), flaw(F.col("cwe")), F.lit('</file><flaw line="99" name="CWE-9: Last"/></file>')))
        .when(k % 4 == 2, F.concat(F.lit('<!-- <flaw line="5" name="no"/> -->'), opened(), flaw(F.lit("A &amp; B > C")), F.lit("</file>")))
        .when(k % 8 == 3, F.concat(opened(), flaw(F.col("cwe"))))
        .otherwise(F.concat(opened(), flaw(F.col("cwe")), F.lit("</file>"))))
    return corpus.select(k.alias("doc_pos"), F.concat(F.lit("<testcase>"), inside, F.lit("</testcase>")).alias("xml"))


def _well_formed():
    corrupt = F.from_xml("xml", "none string, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})["broken"]
    return F.col("xml").isNotNull() & corrupt.isNull()


def manifest_rejects(records: DataFrame) -> DataFrame:
    """``doc_pos, xml`` of the records that are no well-formed elements."""
    return records.filter(~_well_formed())


def _file_elements(xml: Column) -> Column:
    """Every ``file`` element at any depth, in document order, as an element that
    holds its flaws (of any depth below it) and nothing else."""
    kind = lambda t: (F.when(t.rlike(r"^</file\s*>"), F.lit(-1)).when(t.rlike(r"^<flaw[\s/>]"), F.lit(0))
                      .when(t.rlike(r"^<file[\s>]") & ~t.endswith("/>"), F.lit(1)))
    tags = F.regexp_extract_all(F.regexp_replace(xml, NOT_ELEMENTS, ""), F.lit(TAG), F.lit(0))
    marked = F.filter(F.transform(tags, lambda t, i: F.struct(i.alias("i"), t.alias("tag"), kind(t).alias("kind"))), lambda e: e["kind"].isNotNull())

    def nested(events: Column) -> Column:
        depth = running(F.transform(events, lambda e: e["kind"]), "int", lambda before, x: x + F.coalesce(before, F.lit(0)))
        return bind(F.zip_with(events, depth, lambda e, d: F.struct(e["i"].alias("i"), e["tag"].alias("tag"), e["kind"].alias("kind"), d.alias("depth"))), cut)

    def cut(events: Column) -> Column:
        return F.transform(F.filter(events, lambda e: e["kind"] == 1), lambda f: bind(
            F.get(F.filter(events, lambda e: (e["i"] > f["i"]) & (e["kind"] == -1) & (e["depth"] == f["depth"] - 1)), F.lit(0))["i"],
            lambda end: F.concat(f["tag"], F.array_join(F.transform(
                F.filter(events, lambda e: (e["kind"] == 0) & (e["i"] > f["i"]) & (e["i"] < end)),
                lambda e: F.regexp_replace(e["tag"], "/?>$", "/>")), ""), F.lit("</file>"))))

    return bind(marked, nested)


def manifest_flaws(records: DataFrame) -> DataFrame:
    """SRC-1 + FLT-1 + AGG-18 over records ``doc_pos, xml``: per manifest file:
    class = name of the last flaw, lines = every non-null line in document order;
    kept when both exist.  ``file_pos`` orders files inside a testcase.  Files and
    flaws may stand at any depth below their testcase; the element structure is
    read from the tags in the row, names and values by the XML parser.  Records that
    are not well-formed are in ``manifest_rejects``."""
    files = records.filter(_well_formed()).select("doc_pos", F.posexplode(_file_elements(F.col("xml"))).alias("file_pos", "xml"))
    # the element is parsed once, whatever the optimizer inlines
    files = files.select("doc_pos", "file_pos", F.explode(F.array(F.from_xml("xml", FILE))).alias("f"))
    lines = F.filter(F.transform(F.col("f.flaw"), lambda x: x["_line"]), lambda x: x.isNotNull())
    out = files.select(
        "doc_pos", "file_pos",
        F.col("f._path").alias("file_name"),
        F.try_element_at(F.col("f.flaw"), F.lit(-1))["_name"].alias("cwe"),
        lines.alias("lines"),
    )
    return out.filter(F.col("cwe").isNotNull() & (F.size("lines") > 0)).select(
        "doc_pos", "file_pos", "file_name", "cwe",
        F.array_join("lines", ",").alias("vulnerability_location"),
        F.size("lines").cast("bigint").alias("n_lines"),
    )
