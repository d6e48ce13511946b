"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.session import checkpoint_dir

#: Words are maximal runs of anything but the six ASCII blanks (space, \t \n \v \f \r).
BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def staged(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet (``options``: the writer's) into the shared checkpoint
    folder and read it back: the lineage ends there, so a lost executor costs no
    recomputation and several readers see one result.  The folder name is unique per call."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Python workers take texts in batches of at most ``rows`` documents; Spark's
    default of 10,000 whole documents is held several times over by the executor and
    its workers.  A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: str | Column) -> Column:
    """Words of a text in order; none for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), WORD_GAP), "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
