"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may do without the setting."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not found and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in that folder, without the estimates of its plan: a checkpoint keeps them, and in a loop of joins their digits double each round until the driver is full."""
    spark = df.sparkSession
    _folder(spark)
    done = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(done.toJavaRDD(), done.schema()), spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in that folder that nothing else uses; what is there goes when the driver ends."""
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
