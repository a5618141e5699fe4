"""What several operators of this subpackage share: cutting lineage and connected components."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder. The cluster's spark.checkpoint.dir is used as it is; only where none is
    set and all tasks run on this machine (tests) a temporary folder takes its place. Checkpoints that nothing
    refers to any more are removed where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corvine-"))
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder, so that later steps neither recompute them nor
    depend on the executors that made them."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: like `cut`, where later steps read some columns only."""
    path = f"{shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def compact(frame: DataFrame, rows: int, share: int = 200_000, least: int = 8) -> DataFrame:
    """A frame of about so many rows in no more partitions than they need: each task behind a shuffle writes files of its own, however few rows it has, and what
    iterates on few rows would fill a disk with them. Large frames keep their partitions."""
    return frame.coalesce(max(least, -(-rows // share)))


def merging(frame: DataFrame, rows: int, most: int = 1_600_000) -> DataFrame:
    """A side of a join of about so many rows that is to be merged, not broadcast, where they are few: what iterates on few rows would else go through the driver
    at each join, by one more stage with a task for each partition of the shuffle. Joins of many rows are left to the optimizer."""
    return frame.hint("merge") if rows <= most else frame


def fresh(frame: DataFrame, name: str) -> str:
    """The name, or one made of it, that no column of the frame has in any case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps
    (Kiveris et al. 2014), which need O(log² n) rounds and no group in one place: each step is an
    aggregated minimum and a join.

    links: columns a, b (same orderable type, no nulls; repeated rows and self links are harmless).
    Returns node, component for every node that has a link; component is the smallest node reachable.
    Empty links give an empty result.
    """
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    rows, before = edges.count(), None
    edges = compact(edges, rows)  # steps never add edges
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = compact(both.join(merging(lowest, rows), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), rows)
        down = compact(large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = compact(down.join(merging(lowest, rows), "a"), rows).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(compact(small.select("e.*").where("a <> b").distinct(), rows))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
