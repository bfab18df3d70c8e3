"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """R15 as an extension in event time: sessions of a user's events."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return e.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("first_ts"), "n")


def first_seen(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def versions(updates: DataFrame) -> DataFrame:
    """(key, version, state) after each batch, for keys that it changed: a lower version than the one held is ignored, of equal ones the later by seq counts, in whatever order rows come."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        best = before = held.get if held.exists else (-(2**62), -(2**62), None)
        for x in batches:
            best = max(best, *x[["version", "seq", "state"]].itertuples(index=False, name=None), key=lambda r: r[:2])
        if best != before:
            held.update(best)
            yield pd.DataFrame({"key": [key[0]], "version": [best[0]], "state": [best[2]]})

    return updates.groupBy("key").applyInPandasWithState(run, "key long, version long, state string", "version long, seq long, state string", "update", GroupStateTimeout.NoTimeout)


def phases(events: DataFrame, ttl_ms: int = 600_000) -> DataFrame:
    """(user_id, progress, expired): progress only rises; a request without news for the time to live is given up."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            (progress,) = held.get
            held.remove()
            yield pd.DataFrame({"user_id": [key[0]], "progress": [progress], "expired": [True]})
            return
        (progress,) = held.get if held.exists else (0,)
        for x in batches:
            progress = max(progress, int(x["progress"].max()))
        held.update((progress,))
        held.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"user_id": [key[0]], "progress": [progress], "expired": [False]})

    p = F.when(F.col("event_type") == "view", 25).when(F.col("event_type") == "click", 50).when(F.col("event_type") == "signup", 75).when(F.col("event_type") == "purchase", 100).otherwise(0)
    return events.select("user_id", p.cast("long").alias("progress")).groupBy("user_id").applyInPandasWithState(run, "user_id long, progress long, expired boolean", "progress long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def tapped(requests: DataFrame, responses: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requests (url, method, resource_type, ts) with the status and milliseconds of a response (url, status, body, ts) to the same address within `delay`; unanswered ones come without, once the watermark passes, and each further response gives a further row (J1 keeps the first). Bodies of xhr and fetch under 1 MB are kept."""
    a = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).alias("a")
    b = responses.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).alias("b")
    joined = a.join(b, F.expr(f"a.url = b.url AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {delay}"), "left")
    keep = F.col("a.resource_type").isin("xhr", "fetch") & (F.char_length("b.body") < 1024 * 1024)
    millis = (F.unix_micros("b.ts") - F.unix_micros("a.ts")) / 1000.0
    return joined.select("a.url", "a.method", "a.resource_type", "a.ts", "b.status", millis.alias("millis"), F.when(keep, F.col("b.body")).alias("body"))


def handled(stream: DataFrame, column: str, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str) -> StreamingQuery:
    """Each micro-batch's messages of a kind go to the handler of that kind, kind after kind; others are left alone."""

    def run(batch: DataFrame, _: int) -> None:
        batch.persist()  # else each handler would compute it again
        try:
            for kind, handler in handlers.items():
                handler(batch.where(F.col(column) == kind))
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()
