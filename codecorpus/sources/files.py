"""Source trees on any Hadoop file system (SRC-2, SRC-3, SRC-4, SRC-5, SRC-8).

Files are listed and read by the ``binaryFile`` source: one row per file, split
across tasks by the scan; nothing is listed on the driver beyond Spark's own
file index.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from codecorpus import schemas
from codecorpus.functions import patterns as P


def _glob(exts) -> str:
    return "*.{" + ",".join(e.lstrip(".") for e in exts) + "}"


def read_tree(spark: SparkSession, root: str, extensions=P.ANALYSIS_EXTENSIONS) -> DataFrame:
    """SRC-4: every file below ``root`` (recursively, root included) whose
    name ends with one of ``extensions``; raw bytes plus a stable id."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _glob(extensions))
        .load(root)
    )
    return raw.select(F.xxhash64("path").alias("file_id"), "path", "content")


#: One well-formed UTF-8 sequence, over bytes written as the characters U+0000 to U+00FF.
_SEQUENCE = (r"[\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
             r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}")


def drop_undecodable(content: Column) -> Column:
    """Text of UTF-8 bytes without the bytes that belong to no sequence.  Valid
    text stays as it is, a replacement character in it included."""
    text = content.cast("string")
    kept = F.regexp_replace(F.decode(content, "ISO-8859-1"), f"({_SEQUENCE})|[\\x80-\\xFF]", "$1")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.encode(kept, "ISO-8859-1").cast("string"))


def decode_lenient(raw: DataFrame) -> DataFrame:
    """SRC-5 (b): UTF-8 with undecodable bytes dropped, CRLF/CR -> LF
    (the analysis reader)."""
    text = drop_undecodable(F.col("content"))
    return raw.select("file_id", "path", F.regexp_replace(text, r"\r\n?", "\n").alias("content"))


def decode_strict(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-5 (a): files that are not valid UTF-8 go to a rejects table (the
    reference skips them with a message) instead of failing the job."""
    valid = F.try_validate_utf8(F.col("content").cast("string"))
    tagged = raw.select("file_id", "path", valid.alias("text"))
    good = tagged.filter(F.col("text").isNotNull()).select(
        "file_id", "path", F.regexp_replace("text", r"\r\n?", "\n").alias("content"))
    bad = tagged.filter(F.col("text").isNull()).select("file_id", "path")
    return good, bad


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """SRC-4 + SRC-5(b) + SRC-8: the analysis input.  A missing root is
    reported by an empty typed frame, as the reference reports and goes on."""
    try:
        return decode_lenient(read_tree(spark, root))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        logging.getLogger(__name__).warning("no such source folder: %s", root)
        return spark.createDataFrame([], schemas.SOURCE_FILE)


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` with the scheme and authority that its file system reports."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _plain(uri: Column) -> Column:
    """``file:/x``, ``file:///x`` and ``/x/`` as one spelling."""
    return F.regexp_replace(F.regexp_replace(uri, r"^file:/+", "/"), r"/+$", "")


def read_ingest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """SRC-2 + SRC-3 + SRC-5(a): files in sub-folders of ``root`` (never in
    the root itself) named ``CWE*`` with extension ``.java``, ``.c`` or
    ``.cpp``.  Returns (decoded files, rejected files)."""
    raw = read_tree(spark, root, P.INGEST_EXTENSIONS)
    name = F.regexp_extract("path", r"[^/\\]+$", 0)
    parent = F.regexp_extract("path", r"^(.*)[/\\][^/\\]+$", 1)
    under = raw.filter(name.startswith("CWE") & (_plain(parent) != _plain(F.lit(qualified(spark, root)))))
    return decode_strict(under)


def subfolders(files: DataFrame) -> DataFrame:
    """SRC-2 / JN-3: folder rows derived from file paths (only folders that
    hold files matter downstream), with stable ids."""
    parent = F.regexp_extract("path", r"^(.*)[/\\][^/\\]+$", 1)
    return files.select(parent.alias("folder_name")).distinct().select(
        F.xxhash64("folder_name").alias("subfolder_id"), "folder_name")


def with_subfolders(files: DataFrame) -> DataFrame:
    """JN-3: files joined to their sub-folder rows (folder -> sub-folder ->
    file navigation as an equi-join on the folder name)."""
    parent = F.regexp_extract("path", r"^(.*)[/\\][^/\\]+$", 1)
    return files.withColumn("folder_name", parent).join(subfolders(files), "folder_name")
