"""Cutting the lineage of iterative work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one of our own in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="citywright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/citywright/{uuid.uuid4().hex}-{name}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lost executors cost no more than the tasks they ran. Each row is computed once."""
    spark = df.sparkSession
    path = shared_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed_with_any(df: DataFrame, condition: Column) -> tuple[DataFrame, bool]:
    """``checkpointed``, and whether ``condition`` holds for any row, which is counted while rows are written."""
    seen = Observation()
    out = checkpointed(df.observe(seen, F.count(F.when(condition, 1)).alias("n")))
    return out, seen.get["n"] > 0
