"""Tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder`; the path may lie in any store that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows of fewer files than there are cores (and of so little data that they make no more partitions than that) dealt over
    all cores: a file of one row group is read by one task, however small its splits are. Other frames stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # partitions first: only of a small table the files are listed
    few = rows.rdd.getNumPartitions() <= cores and 0 < len(rows.inputFiles()) < cores
    return rows.repartition(cores) if few else rows
