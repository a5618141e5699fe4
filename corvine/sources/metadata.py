"""Metadata of documents: lookup tables from a JSON mapping, and the cascade by which a document gets its own."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import text as f

MAPPING = "file_metadata map<string,struct<filename: string, department: string, category: string>>, url_metadata map<string,struct<department_from_url: string, publish_date: string>>"


def mapping(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The two tables of mapping files (one JSON document each): key, filename, department, category of files, and url, department, publish_date of
    pages. A file that can't be read has no rows."""
    rows = spark.read.schema(MAPPING).option("mode", "DROPMALFORMED").json(path, multiLine=True)
    by_file = rows.select(F.explode("file_metadata").alias("key", "m")).select("key", "m.filename", "m.department", "m.category")
    by_page = rows.select(F.explode("url_metadata").alias("url", "m")).select("url", F.col("m.department_from_url").alias("department"), "m.publish_date")
    return by_file, by_page


def described(docs: DataFrame, by_file: DataFrame, by_page: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """docs with department, category, publish_year and publish_date. Department and category: of the entry with the file's name (of several the first
    by key), else from the folders of the path. Date: the department's first page (by url) with a date, else the first date or year
    in the text. The tables are dimensions: left joins that the optimizer broadcasts if they are small."""
    name = F.substring_index(F.col(path), "/", -1)
    files = by_file.where("filename IS NOT NULL").groupBy(F.col("filename").alias("__f")).agg(F.min(F.struct("key", "department", "category")).alias("__m"))
    pages = by_page.where("coalesce(department, '') <> '' AND coalesce(publish_date, '') <> ''").groupBy(F.col("department").alias("__d")).agg(F.min(F.struct("url", "publish_date")).alias("__p"))
    given, folder = F.nullif(F.col("__m.department"), F.lit("")), f.path_labels(F.col(path))
    met = docs.join(files, name == F.col("__f"), "left").withColumn("department", F.coalesce(given, folder["department"])).withColumn("category", F.when(given.isNotNull(), F.col("__m.category")).otherwise(folder["category"]))
    met = met.join(pages, F.col("department") == F.col("__d"), "left")
    date = F.coalesce(F.col("__p.publish_date"), f.publish_date(F.col(text)))
    year = F.coalesce(F.substring(F.col("__p.publish_date"), 1, 4), f.publish_year(F.col(text)))
    return met.withColumn("publish_year", year).withColumn("publish_date", date).drop("__f", "__m", "__d", "__p")
