"""Results that several steps read, written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from codecorpus.session import checkpoint_dir


def staged(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as Parquet below the checkpoint folder and read back: the
    lineage ends there, every reader sees one result, and its size is known to the
    planner.  The folder's name is new at every call."""
    path = f"{checkpoint_dir(rows.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
