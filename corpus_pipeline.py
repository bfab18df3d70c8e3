"""A corpus pipeline: toxic documents and repeated lines go, one of each group of near copies stays, sources are mixed to weights, texts become piece identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm import lines, mixing, pieces, simhash, toxicity
from pagelathe.llm.common import cut, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return toxicity.score(rows, model).where("score < 0.7").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that equal, or nearly equal, one that comes before; those of which nothing is left go."""
    return lines.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 0.8 similar or more."""
    return simhash.keep_first(docs, words=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources to target weights, a row for each pass over a document."""
    return mixing.Mix(docs).documents()


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of each text, and the text that they decode to."""
    return pieces.encode(docs).drop("text")


STAGES = [("toxicity", toxic), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix), ("pieces", encode)]
#: SQL expresses neither the classifier nor the bit-sliced groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
