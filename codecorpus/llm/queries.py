"""The queries of this subpackage: production parameters on whole tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm import (
    bpe,
    html_text,
    mixing,
    prefix_trie,
    quality_model,
    quality_rules,
    simhash,
    suffix_array,
    suffix_tree,
    topk,
    toxicity,
    treap,
    winnowing,
)
from codecorpus.sources.tables import table


def tokenizer_path() -> str:
    """The byte-level vocabulary; ``CORPUS_TOKENIZER`` names another file."""
    import public_tokenizers

    return os.environ.get("CORPUS_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(texts(spark, sf), table(spark, sf, "labels"), remainder(5) == 0)


def op2(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_array.digests(texts(spark, sf))


def op3(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_tree.digests(texts(spark, sf))


def op4(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(spark, texts(spark, sf), tokenizer_path())


def op5(spark: SparkSession, sf: str) -> DataFrame:
    return topk.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op6(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(texts(spark, sf))


def op7(spark: SparkSession, sf: str) -> DataFrame:
    judged, name = quality_rules.judge(texts(spark, sf), quality_rules.trusted_ids(table(spark, sf, "labels")))
    return judged.select("doc_id", F.col(f"{name}.*"))


def op8(spark: SparkSession, sf: str) -> DataFrame:
    return quality_model.quality(texts(spark, sf), table(spark, sf, "labels"), remainder(4) == 2)


def op9(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf, "pages"))


def op10(spark: SparkSession, sf: str) -> DataFrame:
    placed, name = mixing.placed(table(spark, sf, "documents").select("doc_id", "source"))
    return placed.select("doc_id", "source", F.col(f"{name}.*"))


def op11(spark: SparkSession, sf: str) -> DataFrame:
    return treap.ranked(texts(spark, sf), table(spark, sf, "benchmark"))


def op12(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf, "conversations")).drop("enter_at", "exit_at")


def op13(spark: SparkSession, sf: str) -> DataFrame:
    return winnowing.digests(texts(spark, sf), table(spark, sf, "benchmark"))


QUERIES = {
    "op1_toxicity": op1,
    "op2_suffix_array_dedup": op2,
    "op3_substring_dedup": op3,
    "op4_bpe": op4,
    "op5_topk": op5,
    "op6_simhash": op6,
    "op7_quality_rules": op7,
    "op8_quality_classifier": op8,
    "op9_html_extraction": op9,
    "op10_mixing": op10,
    "op11_ranked_search": op11,
    "op12_prefix_trie": op12,
    "op13_decontamination": op13,
}
