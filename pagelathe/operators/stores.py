"""Stores with times to live, capacities, byte budgets and versions, as queries over their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.operators.logs import micros


def live(entries: DataFrame, now: Column, ttl_s: int, strict: bool = False) -> DataFrame:
    """Entries whose age is below their time to live; `strict` keeps those that reach it exactly."""
    age = micros(now) - micros("ts")
    return entries.where(age <= ttl_s * 1_000_000 if strict else age < ttl_s * 1_000_000)


def capacity(entries: DataFrame, most: int, *order: str) -> DataFrame:
    """R2: the `most` newest entries; the oldest created go first."""
    return entries.orderBy(F.desc("ts"), *order).limit(most)


def byte_budget(entries: DataFrame, budget: int, group: str | None = None) -> DataFrame:
    """The entries used last whose sizes, from the latest back, fit the budget. Totals by minute come first, so that only the minute in which the budget ends is walked row by row."""
    keys = [group] if group else []
    minute = F.date_trunc("minute", "last_accessed")
    by = entries.groupBy(*keys, minute.alias("m")).agg(F.sum("size").alias("bytes"))
    w = Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.desc("m"))
    by = by.withColumn("before", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0)))
    near = entries.withColumn("m", minute).join(by.where(F.col("before") < budget), [*keys, "m"])
    inner = Window.partitionBy(*keys, "m").orderBy(F.desc("last_accessed"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("_sum", F.sum("size").over(inner) + F.col("before")).where(F.col("_sum") <= budget).drop("m", "bytes", "before", "_sum")


def latest_version(updates: DataFrame, key: str, version: str, seq: str, state: str) -> DataFrame:
    """Each key's state of the highest version; the later of equal versions counts."""
    return updates.groupBy(key).agg(F.max(version).alias(version), F.max_by(state, F.struct(version, seq)).alias(state))


def merge_maps(results: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Files of several results; the later one of a path counts."""
    return results.groupBy(key).agg(F.max_by(value, order).alias(value), F.count("*").alias("writes"))


def checkpoint_ids(rows: DataFrame, project: str, order: str) -> DataFrame:
    """Rows numbered within their project, as cp_001 and on."""
    return rows.withColumn("checkpoint_id", F.format_string("cp_%03d", F.row_number().over(Window.partitionBy(project).orderBy(order))))


def newest_by_source(projects: DataFrame, source: str, *order: str) -> DataFrame:
    """The newest project of each source."""
    first = projects.columns
    return projects.groupBy(source).agg(F.max_by(F.struct(*[c for c in first if c != source]), F.struct(*order)).alias("p")).select(source, "p.*")


def describe(sources: DataFrame, data: str) -> DataFrame:
    """Sources with the UTF-8 size of their JSON and its first ten keys."""
    return sources.withColumn("json_size", F.octet_length(data)).withColumn("top_keys", F.slice(F.json_object_keys(data), 1, 10)).drop(data)


def coalesced(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """The first store's value, else the second's."""
    return first.select(key, F.col(value).alias("_a")).join(second.select(key, F.col(value).alias("_b")), key, "full").select(key, F.coalesce("_a", "_b").alias(value))


def created(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Sources with new ones put in; a new one replaces the one of its id."""
    return sources.join(new.select("id"), "id", "left_anti").unionByName(new)


def deleted(sources: DataFrame, ids: DataFrame, force: bool = True) -> DataFrame:
    """Sources without some ids; unless `force`, rows with is_showcase stay."""
    if force:
        return sources.join(ids.select("id"), "id", "left_anti")
    gone = sources.join(ids.select("id").distinct(), "id", "left_semi").where("NOT coalesce(is_showcase, false)").select("id")
    return sources.join(gone, "id", "left_anti")


def projects(rows: DataFrame, include_temp: bool = True) -> DataFrame:
    """Projects, the last updated first; without temporary ones if so asked."""
    return (rows if include_temp else rows.where("is_showcase")).orderBy(F.desc("updated_at"), "id")


def updated(rows: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Projects with the values of `changes` (id and some of their columns), nulls aside; those changed are updated now."""
    named = [c for c in changes.columns if c != "id"]
    side = changes.select("id", *(F.col(c).alias(f"_{c}") for c in named), F.lit(True).alias("_changed"))
    out = rows.join(side, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in named})
    return out.withColumn("updated_at", F.when(F.col("_changed"), now).otherwise(F.col("updated_at"))).select(*rows.columns)


def checkpoint_summaries(checkpoints: DataFrame, project: str) -> DataFrame:
    """Of each project its number of checkpoints, the current one (the last saved) and when it was saved."""
    last = F.struct("ts", "checkpoint_id")
    return checkpoints.groupBy(project).agg(F.count("*").alias("checkpoints"), F.max_by("checkpoint_id", last).alias("current"), F.max("ts").alias("saved"))
