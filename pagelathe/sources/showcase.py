"""Showcases: recorded events, files and what describes them, as folders of JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

PARTS = ("meta", "replay", "files")


def write(folder: str, meta: DataFrame, replay: DataFrame, files: DataFrame) -> None:
    """The three parts of a showcase as lines of JSON below a folder, replacing what is there."""
    for name, rows in zip(PARTS, (meta, replay, files), strict=True):
        rows.write.mode("overwrite").json(f"{folder}/{name}.json")


def read(spark: SparkSession, folder: str, part: str, schema: str) -> DataFrame | None:
    """A part of a showcase; None where it is missing."""
    if part not in PARTS:
        raise ValueError(f"no part of a showcase: {part}")
    try:
        return spark.read.schema(schema).json(f"{folder}/{part}.json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def index(spark: SparkSession, root: str) -> DataFrame:
    """What describes each showcase below a root, with its folder."""
    return spark.read.json(f"{root}/*/meta.json").selectExpr("regexp_extract(_metadata.file_path, '([^/]+)/meta.json', 1) AS showcase", "*")
