"""STM-2: incremental corpus ingest.

New source files arriving under a folder are read as a stream of
``binaryFile`` rows; every micro-batch goes through the same DataFrame
functions as the batch job (decode -> mine -> label) and becomes its own
partition of the functions table.  All per-file steps are stateless, so a micro-batch is an
ordinary batch plan; the checkpoint lives under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from codecorpus.functions import patterns as P
from codecorpus.operators import functions as fx
from codecorpus.schemas import FUNCTIONS
from codecorpus.sources.files import _glob, decode_lenient
from codecorpus.streaming.summaries import write_states


BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])


def source_stream(spark: SparkSession, root: str, max_files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _glob(P.ANALYSIS_EXTENSIONS))
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(root)
        .select(F.xxhash64("path").alias("file_id"), "path", "content")
    )


def _mine_batch(out_path: str, states_path: str | None):
    def run(batch: DataFrame, batch_id: int) -> None:
        files = decode_lenient(batch)
        at = f"{out_path}/batch_id={batch_id}"  # a batch run again replaces its own rows
        fx.functions(fx.source_files(files)).write.mode("overwrite").parquet(at)
        if states_path:
            write_states(fx.catalog(files.select("path", "file_id")), batch.sparkSession.read.schema(FUNCTIONS).parquet(at), states_path, batch_id)

    return run


def ingest(spark: SparkSession, root: str, out_path: str, name: str = "ingest", checkpoint: str | None = None,
           states_path: str | None = None) -> StreamingQuery:
    """Process every file present now (``availableNow``) and stop; rerunning
    picks up only files that arrived since (tracked by the checkpoint).  The
    checkpoint folder is ``checkpoint``, else below ``spark.checkpoint.dir``;
    without either a restart would read everything again, so that is an error.
    With ``states_path`` each batch also leaves its partial totals there
    (``streaming.summaries``)."""
    ckpt = checkpoint
    if ckpt is None:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not shared:
            raise ValueError("a stream needs spark.checkpoint.dir or a checkpoint folder")
        ckpt = os.path.join(shared, "streams", name)
    return (
        source_stream(spark, root).writeStream.foreachBatch(_mine_batch(out_path, states_path))
        .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    )
