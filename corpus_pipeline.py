"""The training-data pipeline: quality rules, near duplicates, repeated passages,
mixing, tokens.  Each stage is written as Parquet and read again by the next, so
a stage starts from finished files whatever executors were lost before.  Readers
pack files by length, so the order of mixing is taken from the files' numbers and
the rows' places in them: ``run`` gives it as a column."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm import bpe, mixing, quality_rules, simhash, suffix_array
from codecorpus.llm.common import fresh, text_batches
from codecorpus.llm.queries import tokenizer_path
from codecorpus.session import checkpoint_dir
from codecorpus.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality_rules.keep(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    text_batches(spark)
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document already has."""
    text_batches(spark)
    return suffix_array.cleaned(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of their slots."""
    return mixing.interleave(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hashes of the token ids and of the text decoded from them, and their number
    (the ids themselves: ``run``)."""
    text_batches(spark)
    return bpe.digests(spark, docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]

#: Hashed n-grams, fingerprints and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def positioned(files: DataFrame) -> tuple[DataFrame, str]:
    """A table written in order and read back, with a number that grows in that
    order (not without gaps: number of the part, of its file, of the row), and its name."""
    name = fresh(files, "position")
    number = lambda pattern: F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("bigint")
    at = F.shiftleft(number(r"^part-(\d+)"), 43) + F.shiftleft(number(r"-c(\d+)\."), 32) + F.col("_metadata.row_index")
    return files.select("*", at.alias(name)), name


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``position, doc_id, token_ids, n_tokens, ids_sha256, decoded_sha256``; ``position``
    grows in the order of mixing (the rows themselves are not sorted: sort by it to
    read in that order).  A null text has no tokens, rows repeated with one id and
    fingerprint are one document, null ids are documents of their own, and an empty
    table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    placed, position = positioned(docs)
    out, sequence = bpe.sequences(spark, placed.select("doc_id", "text", F.col(position).alias("position")), tokenizer_path())
    out = out.select("position", "doc_id", f"{sequence}.*")
    out.write.parquet(f"{folder}/{len(STAGES) - 1}")
    return spark.read.schema(out.schema).parquet(f"{folder}/{len(STAGES) - 1}")
