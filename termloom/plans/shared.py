"""Materialisation in the folder that all executors share.

Long lineages and iterative operators cut their lineage by writing a table below the folder named by
``spark.checkpoint.dir``; a lost executor then costs only the tasks that it ran.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; only where the session names none (tests, one machine) a folder of our own."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} has to name a folder that all executors share")
    if own is None:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="termloom-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a :func:`materialize` result that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)
