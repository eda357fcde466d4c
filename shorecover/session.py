"""Settings that jobs read from the session, and their written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only in local mode (tests) a temporary folder takes the place of a missing setting; executors
    of a cluster would not see it.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(path)
    return path


def temporary(spark: SparkSession, prefix: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: computed once, lineage cut."""
    path = temporary(df.sparkSession, "shorecover")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
