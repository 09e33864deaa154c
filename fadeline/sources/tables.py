"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one on a single machine that names none.

    A cluster without one raises: its executors wouldn't see a folder of the driver's own.
    """
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="fadeline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: later uses, and lost executors, cost a read and no computation."""
    at = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop(*written_tables: DataFrame) -> None:
    """Delete tables that ``written`` made."""
    for df in written_tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/tables/" in f}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
