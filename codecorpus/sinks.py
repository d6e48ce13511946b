"""Table sinks (SNK-1..6): key-checked, all-or-nothing Parquet loads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecorpus import schemas
from codecorpus.session import checkpoint_dir


class KeyViolation(ValueError):
    """Raised before anything is written when a declared key repeats."""


def create_table(spark: SparkSession, name: str, schema: T.StructType, location: str,
                 partition_by: list[str] | None = None) -> None:
    """SNK-1: ``CREATE TABLE ... USING parquet`` from a declared schema."""
    part = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schemas.ddl(schema)}) USING parquet{part} LOCATION '{location}'")


def write_checked(df: DataFrame, path: str, key: list[str], partition_by: list[str] | None = None,
                  mode: str = "errorifexists") -> None:
    """SNK-3/SNK-4: compute the rows once into the checkpoint folder, check their
    key there (a grouped count, partial-aggregated;
    only violating keys ever reach the driver, at most a few), then one write
    job.  Parquet commits per job, so a failed write leaves no partial table."""
    spark = df.sparkSession
    stage = f"{checkpoint_dir(spark).rstrip('/')}/load-{uuid.uuid4().hex}"
    df.write.parquet(stage)
    rows = spark.read.schema(df.schema).parquet(stage)
    dup = rows.groupBy(*key).count().filter(F.col("count") > 1).limit(5).collect()
    if dup:
        raise KeyViolation(f"duplicate key {key}: {[tuple(r) for r in dup]}")
    w = rows.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


# --- loads: every row carries its load, a load is visible as a whole -------------

LOADS = "_loads"


def publish(tables: dict[str, DataFrame], path: str, load_id: str) -> None:
    """Write the tables of one load and make them visible in one step.  Each goes into
    a folder of its load; the record of the load is written last, and readers take
    loads with a record only.  The same load again replaces its own rows, so a retry
    after any failure leaves what one run would; earlier loads are never touched."""
    spark = next(iter(tables.values())).sparkSession
    if not load_id or not set(load_id) <= set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-"):
        raise ValueError(f"no name for a load: {load_id!r}")
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/load_id={load_id}")
    record = spark.createDataFrame([(name,) for name in tables], "table_name string").withColumn("published", F.current_timestamp())
    record.coalesce(1).write.mode("overwrite").parquet(f"{path}/{LOADS}/load_id={load_id}")


def published(spark: SparkSession, path: str, name: str, schema: T.StructType, latest: bool = False) -> DataFrame:
    """Rows of a table, with their ``load_id``, of all published loads or the ``latest``."""
    record = T.StructType([T.StructField("table_name", T.StringType()), T.StructField("published", T.TimestampType()), T.StructField("load_id", T.StringType())])
    done = spark.read.schema(record).parquet(f"{path}/{LOADS}").filter(F.col("table_name") == name)
    if latest:
        done = done.orderBy(F.desc("published"), F.desc("load_id")).limit(1)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("load_id", T.StringType())])).parquet(f"{path}/{name}")
    return rows.join(done.select("load_id").distinct(), "load_id", "left_semi").select(*[f.name for f in schema.fields], "load_id")


def load_testcases(good: DataFrame, undecodable: DataFrame, flaws: DataFrame, path: str, load_id: str, folder_name: str) -> None:
    """SNK-2: the rows Folder, SubFolder and TestCase of one source tree with stable
    ids (``xxhash64`` of the names, not counters), and the files that were not read
    as rejects.  ``good`` and ``undecodable`` are what ``read_ingest`` gives."""
    from codecorpus.operators.curate import ingest_files, testcase_table
    from codecorpus.sources.files import subfolders

    spark = good.sparkSession
    folder = spark.createDataFrame([(folder_name,)], "folder_name string").select(F.xxhash64("folder_name").alias("folder_id"), "folder_name")
    every = good.select("path").unionByName(undecodable.select("path"))
    sub = subfolders(every).select("subfolder_id", "folder_name", F.xxhash64(F.lit(folder_name)).alias("folder_id"))
    cases = testcase_table(ingest_files(good), flaws).withColumn("subfolder_id", F.xxhash64("folder"))
    publish({
        "Folder": folder,
        "SubFolder": sub,
        "TestCase": cases.select(*schemas.TESTCASE.fieldNames(), "subfolder_id"),
        "TestCaseRejects": undecodable.select("file_id", "path", F.lit("undecodable").alias("reason")),
    }, path, load_id)


def load_cases(testcases: DataFrame, path: str, load_id: str) -> None:
    """SNK-3 + STR-4: the Cases of the files whose line count the cleaning keeps; the
    others, which abort the reference's load, are rejects."""
    from codecorpus.operators.curate import audited_cases
    from codecorpus.operators.staging import staged

    good, bad = audited_cases(testcases)
    good = staged(good, "cases")  # the key check and the load read one result
    dup = good.groupBy(*schemas.CASES_KEY).count().filter("count > 1").limit(5).collect()
    if dup:
        raise KeyViolation(f"duplicate key {schemas.CASES_KEY}: {[tuple(r) for r in dup]}")
    publish({"Cases": good, "CaseRejects": bad}, path, load_id)


def export_training(rows: DataFrame, path: str, load_id: str) -> None:
    """SNK-5: training rows as one load; the export before it stays readable until
    the new one is whole."""
    publish({"training": rows.select(schemas.TRAINING.fieldNames())}, path, load_id)


def read_training(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """SRC-7: the rows of the latest export."""
    rows = published(spark, path, "training", schemas.TRAINING, latest=True).drop("load_id")
    return rows if split is None else rows.filter(F.col("split") == split)


def append_epochs(epochs: DataFrame, path: str, load_id: str) -> None:
    """SNK-6: add reports to the epoch log (trial, epoch, losses, AUROC); the
    same ``load_id`` again replaces its reports."""
    publish({"epochs": epochs.select([F.col(f.name).cast(f.dataType) for f in schemas.EPOCHS.fields])}, path, load_id)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return published(spark, path, "epochs", schemas.EPOCHS).drop("load_id")
