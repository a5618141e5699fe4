"""Where a job may write what driver and executors both read."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; only where that isn't set and all tasks run on this machine (tests), under a temporary one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{set_dir or tempfile.mkdtemp(prefix='corvine-')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a Parquet table in a new shared folder: what comes later neither recomputes them nor depends on the executors that made them."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
