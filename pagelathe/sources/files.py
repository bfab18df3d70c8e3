"""Sources and sinks besides tables: JSON documents, file trees, event frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON documents of a folder, newest first, without their data; unreadable ones are skipped."""
    schema = "id string, source_url string, page_title string, created_at string, updated_at string, data string, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{folder}/*.json")
    return rows.where("_corrupt IS NULL AND id IS NOT NULL").withColumn("json_size", F.octet_length("data")).drop("data", "_corrupt").orderBy(F.desc("created_at"), "id")


def file_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all files below a folder."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def exported(files: DataFrame) -> DataFrame:
    """Files for an archive: none below /public/images/, no binary marks, no leading slash."""
    ok = ~F.col("path").contains("public/images/") & ~F.col("content").startswith("[Binary")
    return files.where(ok).withColumn("path", F.regexp_replace("path", "^/+", ""))


def snapshot(files: DataFrame) -> DataFrame:
    """Files worth a checkpoint: not hidden, not of node_modules, not empty, under 100,000 characters."""
    n = F.char_length("content")
    return files.where(~F.col("path").rlike(r"(^|/)\.") & ~F.col("path").contains("node_modules") & (n > 0) & (n < 100_000))


def ndjson(rows: DataFrame) -> DataFrame:
    """Rows as lines of JSON."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
