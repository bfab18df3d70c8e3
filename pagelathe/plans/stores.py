"""Queries over events and orders, as entries of stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelathe.operators import stores as S
from pagelathe.plans.catalog import register
from pagelathe.sources.tables import table

SIZE = "CAST(100 + event_id * 7919 % 5000 AS BIGINT)"
NOW = "TIMESTAMP '2024-01-30 00:00:00'"


def entries(spark, d):
    """Events as entries of a cache."""
    return table(spark, d, "events").selectExpr("event_id AS id", "user_id", "ts", "ts AS last_accessed", "CAST(100 + event_id * 7919 % 5000 AS LONG) AS size", "event_type", "props")


@register("store_live", f"SELECT event_id AS id FROM events WHERE epoch_us({NOW}) - epoch_us(ts) < 7 * 86400 * 1000000::BIGINT")
def store_live(spark, d):
    """Entries younger than a week."""
    return S.live(entries(spark, d), F.expr(NOW), 7 * 86400).select("id")


@register("store_capacity", "SELECT event_id AS id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50")
def store_capacity(spark, d):
    """R2/O2: the 50 newest entries."""
    return S.capacity(entries(spark, d), 50, "id").select("id", "ts")


@register("store_byte_budget", f"SELECT id, size FROM (SELECT event_id AS id, {SIZE} AS size, sum({SIZE}) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s <= 500000")
def store_byte_budget(spark, d):
    """Entries used last that fit 500 kB."""
    return S.byte_budget(entries(spark, d), 500_000).select("id", "size")


@register("store_stats", f"SELECT user_id, count(*) AS n, sum({SIZE}) AS bytes, round(sum({SIZE}) / 1048576.0, 2) AS mb FROM events GROUP BY user_id")
def store_stats(spark, d):
    """Entries and bytes."""
    return entries(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.round(F.sum("size") / 1048576.0, 2).alias("mb"))


@register("store_versions", "SELECT user_id, max(v) AS version, arg_max(event_type, (v, event_id)) AS state FROM (SELECT *, event_id * 31 % 97 AS v FROM events) GROUP BY user_id")
def store_versions(spark, d):
    """States by version, older ones ignored."""
    e = entries(spark, d).select("user_id", "id", (F.col("id") * 31 % 97).alias("version"), F.col("event_type").alias("state"))
    return S.latest_version(e, "user_id", "version", "id", "state")


@register("store_merge", "SELECT 'f' || event_id % 50 AS path, arg_max(event_type, event_id) AS content, count(*) AS writes FROM events GROUP BY 1")
def store_merge(spark, d):
    """Files of many writers, the last write of each."""
    return S.merge_maps(entries(spark, d).select(F.concat(F.lit("f"), (F.col("id") % 50).cast("string")).alias("path"), "id", F.col("event_type").alias("content")), "path", "id", "content")


@register("store_checkpoints", "SELECT o_custkey, o_orderkey, printf('cp_%03d', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS checkpoint_id FROM orders")
def store_checkpoints(spark, d):
    """Checkpoint ids."""
    return S.checkpoint_ids(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@register("store_newest_project", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def store_newest_project(spark, d):
    """The newest project of each source."""
    return S.newest_by_source(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderdate", "o_orderkey")


@register("store_sources", "SELECT event_id AS id, octet_length(encode(props)) AS json_size, array_to_string(json_keys(props)[1:10], ',') AS top_keys FROM events")
def store_sources(spark, d):
    """Sizes and keys of stored JSON."""
    return S.describe(entries(spark, d).select("id", "props"), "props").withColumn("top_keys", F.array_join("top_keys", ","))


@register("store_fallback", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey % 2 = 0) a FULL JOIN (SELECT s_suppkey AS k, 'file' AS v FROM supplier WHERE s_suppkey % 3 = 0) b ON a.k = b.k")
def store_fallback(spark, d):
    """Memory first, else the file."""
    s = table(spark, d, "supplier")
    return S.coalesced(s.where("s_suppkey % 2 = 0").selectExpr("s_suppkey AS k", "s_name AS v"), s.where("s_suppkey % 3 = 0").selectExpr("s_suppkey AS k", "'file' AS v"), "k", "v")
