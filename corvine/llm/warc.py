"""WARC archives and their Merkle fixity audit.

Records of an archive are hashed; the hashes of the records in an offset range make the hash of the
range, those of 16 neighbouring ranges the hash of the next larger one, up to the archive, and those of
16 neighbouring archives go on up to one root. Two replicas with equal roots are equal. Otherwise only
the branches that differ are descended, level by level, down to the records of differing ranges: a join on the
children of differing nodes, never a comparison of all records. There records of equal digest and length
are matched first, wherever they lie in their archive, as a lost or longer record moves all behind it; what is left
between the same matched neighbours is named changed, missing or extra.
"""

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.llm.common import cut

#: Bytes of the smallest range, children of a node, and levels of ranges (the largest has 4 GiB).
RANGE, FANOUT, LEVELS = 1 << 16, 16, 5
#: Archives for records without a page_id.
ANONYMOUS = 1024


def record(url: Column, body: Column, kind: str = "resource") -> Column:
    """A WARC record as text (UTF-8 when it is written)."""
    text = F.coalesce(body, F.lit(""))
    return F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(text), F.lit("\r\n\r\n"), text, F.lit("\r\n\r\n"))


def _records(pages: DataFrame, per_archive: int) -> DataFrame:
    archive = F.coalesce(F.floor(F.col("page_id") / per_archive), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(ANONYMOUS)))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", archive.alias("archive"), record(F.col("url"), F.col("html")).alias("record"))
    return rows.withColumns({"length": F.octet_length("record").cast("long"), "digest": F.sha2("record", 256)})


def _offset() -> Column:
    before = Window.partitionBy("archive").orderBy("page_id", "url", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")


def archived(pages: DataFrame, per_archive: int = 1000) -> DataFrame:
    """page_id, archive, offset, length, record: pages as records of archives of per_archive page_ids each, in the
    order of page_id, url and digest. Rows with a null page_id are dealt over the archives -1024 to -1 by a hash."""
    return _records(pages, per_archive).select("page_id", "archive", _offset(), "length", "record")


def catalogued(pages: DataFrame, per_archive: int = 1000) -> DataFrame:
    """page_id, archive, offset, length, digest of the records that archived() makes. Records are hashed where they are
    read: only these few columns are shuffled to number them."""
    rows = _records(pages, per_archive).select("page_id", "url", "archive", "length", "digest")
    return rows.select("page_id", "archive", _offset(), "length", "digest")


def write_warc(records: DataFrame, path: str) -> None:
    """Writes archive, offset, record as WARC files, a folder archive=... for each archive, its records in order."""
    bare = records.select("archive", "offset", F.expr("left(record, length(record) - 4)").alias("value"))
    dealt = bare.repartition("archive").sortWithinPartitions("archive", "offset")
    dealt.select("archive", "value").write.partitionBy("archive").option("lineSep", "\r\n\r\n").text(path)


def hashed(records: DataFrame) -> DataFrame:
    """archive, offset, length, digest of each record."""
    return records.select("archive", "offset", "length", F.sha2("record", 256).alias("digest"))


def _tree(records: DataFrame, archives: int) -> list[DataFrame]:
    """Levels of a replica's tree from the smallest ranges to the root: archive, node, parent, digest each. Above the
    ranges a node stands for neighbouring archives; nodes are numbered within `archive`, -2 there."""
    joined = lambda key, *columns: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, *columns))), lambda x: F.concat_ws(":", *[x[c].cast("string") for c in [key, *columns]])), "\n"), 256)
    levels = [cut(records.groupBy("archive", F.floor(F.col("offset") / RANGE).alias("node")).agg(joined("offset", "length", "digest").alias("digest")))]
    for _ in range(LEVELS - 1):
        levels.append(cut(levels[-1].groupBy("archive", F.floor(F.col("node") / FANOUT).alias("up")).agg(joined("node", "digest").alias("digest")).withColumnRenamed("up", "node")))
    whole = levels[-1].groupBy("archive").agg(joined("node", "digest").alias("digest"))
    levels.append(cut(whole.select(F.lit(-2).cast("long").alias("archive"), F.col("archive").alias("node"), "digest")))
    while archives > 1:
        archives = -(-archives // FANOUT)
        levels.append(cut(levels[-1].groupBy("archive", F.floor(F.col("node") / FANOUT).alias("up")).agg(joined("node", "digest").alias("digest")).withColumnRenamed("up", "node")))
    return levels


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """archive, offset_left, offset_right, length_left, length_right, digest_left, digest_right, status (changed, missing: only left
    has it, or extra: only right has it) of the records by which two replicas (archive, offset, length, digest) differ.
    A record that only lies at another offset of its archive is no difference.

    Records with a null archive are one more archive; null offsets come first. Records that share archive and offset are
    compared in the order of length and digest. Equal or empty replicas give an empty result. An archive's differing records are put in
    order in one task: an archive is a file of bounded size.
    """
    low = left.select("archive").union(right.select("archive")).agg(F.coalesce(F.min("archive"), F.lit(0)).cast("long"), F.coalesce(F.max("archive"), F.lit(0)).cast("long")).first()
    number = F.coalesce(F.col("archive").cast("long") - low[0] + 1, F.lit(0).cast("long"))  # 0: no archive
    left, right = (cut(r.select(number.alias("archive"), F.coalesce(F.col("offset").cast("long"), F.lit(-1).cast("long")).alias("offset"), "length", "digest")) for r in (left, right))
    a, b = _tree(left, low[1] - low[0] + 2), _tree(right, low[1] - low[0] + 2)
    differing = None
    for k in range(len(a) - 1, -1, -1):
        x, y = a[k], b[k]
        if differing is not None:
            # Children of a differing node; of a differing archive, its largest ranges.
            if k == LEVELS - 1:
                parents = differing.select(F.col("node").alias("archive"))
                x, y = x.join(parents, "archive", "left_semi"), y.join(parents, "archive", "left_semi")
            else:
                parents = differing.select(F.col("archive").alias("pa"), F.col("node").alias("pn"))
                under = (F.col("archive") == F.col("pa")) & (F.floor(F.col("node") / FANOUT) == F.col("pn"))
                x, y = x.join(parents, under, "left_semi"), y.join(parents, under, "left_semi")
        met = x.withColumnRenamed("digest", "dx").join(y.withColumnRenamed("digest", "dy"), ["archive", "node"], "full")
        differing = cut(met.where(~F.col("dx").eqNullSafe(F.col("dy"))).select("archive", "node"))
    alike = Window.partitionBy("archive", "digest", "length").orderBy("offset")
    inside = lambda r: cut(r.withColumn("node", F.floor(F.col("offset") / RANGE)).join(differing, ["archive", "node"], "left_semi").withColumn("copy", F.row_number().over(alike)).select("archive", "offset", "length", "digest", "copy"))
    x, y = inside(left), inside(right)
    before = Window.partitionBy("archive").orderBy("offset", "length", "digest", "copy").rowsBetween(Window.unboundedPreceding, -1)
    in_gap = Window.partitionBy("archive", "gap").orderBy("offset", "length", "digest", "copy")

    def alone(own: DataFrame, other: DataFrame) -> DataFrame:
        """Records without a match, by the number of matched ones before them (the gap) and their place in it."""
        there = other.select("archive", F.col("digest").alias("d"), F.col("length").alias("l"), F.col("copy").alias("c"), F.lit(True).alias("met")).withColumnRenamed("archive", "ar")
        same = (F.col("archive") == F.col("ar")) & F.col("digest").eqNullSafe(F.col("d")) & F.col("length").eqNullSafe(F.col("l")) & (F.col("copy") == F.col("c"))
        marked = own.join(there, same, "left").withColumn("gap", F.coalesce(F.sum(F.when(F.col("met"), 1).otherwise(0)).over(before), F.lit(0)))
        return marked.where("met IS NULL").withColumn("n", F.row_number().over(in_gap)).select("archive", "gap", "n", F.when(F.col("offset") >= 0, F.col("offset")).alias("offset"), "length", "digest", F.lit(True).alias("here"))

    lone = lambda frame, side: frame.toDF("archive", "gap", "n", *[f"{c}_{side}" for c in ("offset", "length", "digest", "here")])
    met = lone(alone(x, y), "left").join(lone(alone(y, x), "right"), ["archive", "gap", "n"], "full")
    status = F.when(F.col("here_right").isNull(), "missing").when(F.col("here_left").isNull(), "extra").otherwise("changed")
    archive = F.when(F.col("archive") > 0, F.col("archive") + low[0] - 1)
    return met.select(archive.alias("archive"), "offset_left", "offset_right", "length_left", "length_right", "digest_left", "digest_right", status.alias("status"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, length, headers (map; names in lower case), body (binary) of the records of WARC files (also gzip: then
    offset and length are those of the decompressed stream). What is no record ends a file with an error."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                stream = io.BytesIO(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)
                while True:
                    offset, line = stream.tell(), stream.readline()
                    if not line:
                        break
                    if not line.startswith(b"WARC/"):
                        raise ValueError(f"no WARC record at {offset} of {name}")
                    headers = {}
                    while (line := stream.readline().strip()):
                        key, _, value = line.decode("utf-8", "replace").partition(":")
                        headers[key.strip().lower()] = value.strip()
                    body = stream.read(int(headers.get("content-length", 0)))
                    stream.read(4)
                    yield pd.DataFrame({"path": [name], "offset": [offset], "length": [stream.tell() - offset], "headers": [headers], "body": [body]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, offset long, length long, headers map<string,string>, body binary")
