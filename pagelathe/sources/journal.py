"""A log of checkpoints: rows appended to a table in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append(folder: str, rows: DataFrame) -> None:
    """Rows added to the log."""
    rows.write.mode("append").parquet(folder)


def entries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The log's rows; none where nothing was appended yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)


def clear(spark: SparkSession, folder: str, schema: str) -> None:
    """The log without rows."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder)
