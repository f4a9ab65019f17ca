"""Tables written on the way, which cut lineage: a lost executor costs its running tasks only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only for a local session that sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_folder(spark)}/written-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the application's folder and return the written table."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(table: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    own = folder(table.sparkSession)
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if own.split(":", 1)[-1].strip("/") in path:
            delete(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application wrote on the way, once its results are stored."""
    delete(spark, folder(spark))
