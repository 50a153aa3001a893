"""Session defaults and the shared folder that durable intermediate tables live in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str | int = "*", memory: str = "8g", **extra: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("hostelry")
    options = {
        **SESSION_DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": memory,
        **extra,
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder. A cluster without it is an error:
    a machine-local folder there would lose the table with the machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="hostelry-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the rows to a table in the shared folder and reads it back.

    A lost executor then costs a re-read and not a replay of every earlier round, and the reader
    knows the true size. A plan that loops must not use ``checkpoint()`` here: it hands the inferred
    constraints of every round on to the next, and planning grows without end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "durable")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that ``durable`` wrote and that nothing will read again."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path is not None:
            jvm = table.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
