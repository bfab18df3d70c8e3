"""Streams that keep state of their own: groups of errors, compactions of conversations, stores whose entries expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pagelathe.functions.text import string_hash
from pagelathe.operators import memory

#: The state store that processors with state of several kinds need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUPS = "source string, id string, message string, occurrences long, first_ts timestamp, last_ts timestamp, gone boolean"
CLOSED = "conv_id long, compaction long, turn long, role string, text string, tokens long"
ANSWERS = "store string, op string, id string, url string, data string, found boolean, at_ms long"


def prepare(spark: SparkSession) -> None:
    """Choose the state store for this session's streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """All of a key's rows of a micro-batch in one order, however many Arrow batches they came in."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable")


class ErrorGroups(StatefulProcessor):
    """Of each source the `most` groups of equal messages that came last, with their numbers and times; a group without news for the time to live is forgotten."""

    def __init__(self, most: int, ttl_ms: int | None) -> None:
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.groups = handle.getMapState("groups", "id string", "message string, occurrences long, first_us long, last_us long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        changed = {}
        for x in rows:
            us = x["ts"].astype("datetime64[us]").astype("int64")
            for id_, g in x.assign(us=us).groupby("id", sort=False):
                message, n, first, last = changed.get(id_) or (self.groups.getValue((id_,)) if self.groups.containsKey((id_,)) else (g["message"].iloc[0], 0, 2**62, -(2**62)))
                changed[id_] = (message, n + len(g), min(first, int(g["us"].min())), max(last, int(g["us"].max())))
        held = {k[0]: v for k, v in self.groups.iterator()} | changed
        gone = sorted(held, key=lambda i: (-held[i][3], i))[self.most :]
        for id_ in gone:
            if self.groups.containsKey((id_,)):
                self.groups.removeKey((id_,))
        for id_ in changed.keys() - set(gone):
            self.groups.updateValue((id_,), changed[id_])
        told = [(key[0], i, *held[i], i in gone) for i in sorted(changed.keys() | set(gone))]
        out = pd.DataFrame(told, columns=["source", "id", "message", "occurrences", "first_ts", "last_ts", "gone"])
        yield out.assign(first_ts=pd.to_datetime(out["first_ts"], unit="us"), last_ts=pd.to_datetime(out["last_ts"], unit="us"))

    def close(self) -> None:
        pass


def error_groups(messages: DataFrame, most: int = 50, ttl_ms: int | None = None) -> DataFrame:
    """Groups of messages (source, message, ts) after each micro-batch that changed them, `gone` for those that others have pushed out.

    A group is told by the source and its message's hash. Numbers and times don't depend on the order in which rows
    come; which groups are pushed out does, as one that is gone begins anew. Null messages count as empty, null sources
    as one source; messages of any length are held as they are. Empty batches give nothing. With a time to live
    micro-batches keep coming so that state can expire: such a stream runs until it is stopped.
    """
    said = F.coalesce("message", F.lit(""))
    rows = messages.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), said.alias("message"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    rows = rows.withColumn("id", F.concat("source", F.lit("-"), string_hash(F.col("message"))))
    return rows.groupBy("source").transformWithStateInPandas(ErrorGroups(most, ttl_ms), GROUPS, "update", "ProcessingTime" if ttl_ms else "none")


class Compactions(StatefulProcessor):
    """A conversation's messages in the order of their turns; what the context loses at each compaction comes out."""

    def __init__(self, most: int, keep: int, first: int) -> None:
        self.most, self.keep, self.first = most, keep, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, total long, compactions long")
        self.waiting = handle.getMapState("waiting", "turn long", "role string, text string, tokens long")
        self.held = handle.getListState("held", "turn long, role string, text string, tokens long")

    def handleInputRows(self, key, rows, timerValues):
        turn, total, n = self.at.get() if self.at.exists() else (self.first, 0, 0)
        new = {int(t): (r, x, int(k)) for t, r, x, k in _sorted(rows, "turn")[["turn", "role", "text", "tokens"]].itertuples(index=False)}
        held, out, start = list(self.held.get()), [], turn
        while True:  # messages whose earlier ones are all here; others wait
            if turn in new:
                message = new[turn]
            elif self.waiting.containsKey((turn,)):
                message = self.waiting.getValue((turn,))
                self.waiting.removeKey((turn,))
            else:
                break
            held.append((turn, *message))
            total += message[2]
            turn += 1
            if total >= self.most:
                others = [m for m in held if m[1] != "system"]
                old = others[: len(others) - self.keep] if self.keep else others
                if old:
                    n += 1
                    systems = [m for m in held if m[1] == "system"]
                    out += [(key[0], n, *m) for m in sorted(systems + old)]
                    held = sorted(systems + others[len(old) :])
                    total = sum(m[3] for m in held)
        for t, message in new.items():
            if t >= turn and not self.waiting.containsKey((t,)):
                self.waiting.updateValue((t,), message)
        if turn > start:
            self.at.update((turn, total, n))
            self.held.clear()
            if held:
                self.held.put(held)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CLOSED.split(", ")])

    def close(self) -> None:
        pass


def closed(messages: DataFrame, most: int, keep: int = 10, first: int = 0) -> DataFrame:
    """The messages (conv_id, turn, role, text) that each compaction takes out of its conversation's context, with the system's, which stay.

    Tokens are counted in the order of turns, which run without gaps from `first`; messages that come early wait in the
    state, and ones that come twice count once. As soon as a context has `most` tokens, all but the last `keep` of its
    messages and the system's go, if there are such; counting goes on with what is left. So the result is the same
    however rows are spread over micro-batches. Null texts are empty.
    """
    text = F.coalesce("text", F.lit(""))
    rows = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), memory.tokens(text).alias("tokens"))
    return rows.groupBy("conv_id").transformWithStateInPandas(Compactions(most, keep, first), CLOSED, "append", "none")


def summaries(taken: DataFrame, **options) -> DataFrame:
    """C10/C11 of closed()'s rows, in each micro-batch (foreachBatch) or as a table: (conv_id, compaction, compacted, summary)."""
    one = taken.withColumn("conv_id", F.concat_ws(":", "conv_id", "compaction"))
    out = memory.compact(one.select("conv_id", "turn", "role", "text"), 0, **options)
    part = F.split("conv_id", ":")
    return out.select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("compaction"), "compacted", "summary")


class Store(StatefulProcessor):
    """Entries by id that expire, asked and changed by commands."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "id string", "url string, data string, size long, at_ms long")

    def _alive(self, at: int) -> dict:
        return {k[0]: v for k, v in self.entries.iterator() if at - v[3] < self.ttl_ms}

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for op, id_, url, data, size, at in _sorted(rows, "at_ms", "seq")[["op", "id", "url", "data", "size", "at_ms"]].itertuples(index=False):
            at = int(at)
            if op == "put":
                self.entries.updateValue((id_,), (url, data, int(size), at))
                self.handle.registerTimer(at + self.ttl_ms)
            elif op == "delete":
                there = self.entries.containsKey((id_,))
                if there:
                    self.entries.removeKey((id_,))
                out.append((key[0], op, id_, None, None, there, at))
            elif op == "clear":
                out.append((key[0], op, None, None, str(len(self._alive(at))), True, at))
                self.entries.clear()
            elif op in ("get", "get_by_url"):
                alive = self._alive(at)
                if op == "get":
                    hit = id_ if id_ in alive else None
                else:  # the newest entry of the address, then the first by id
                    hit = min((k for k, v in alive.items() if v[0] == url), key=lambda k: (-alive[k][3], k), default=None)
                found = alive.get(hit)
                out.append((key[0], op, hit or id_, found[0] if found else url, found[1] if found else None, found is not None, at))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in ANSWERS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = sorted((k[0], v) for k, v in self.entries.iterator() if now - v[3] >= self.ttl_ms)
        for id_, _ in gone:
            self.entries.removeKey((id_,))
        yield pd.DataFrame([(key[0], "expired", id_, v[0], None, True, v[3] + self.ttl_ms) for id_, v in gone], columns=[c.split(" ")[0] for c in ANSWERS.split(", ")])

    def close(self) -> None:
        pass


def store(commands: DataFrame, ttl_s: int = 86_400, delay: str = "0 seconds") -> DataFrame:
    """Stores as a stream of commands (store, op, id, url, data, size, ts, seq): put, get, get_by_url, delete and clear; answers come out, and entries as they expire.

    An entry expires when its age reaches the time to live: a get at that time misses it, and it leaves the state once
    the watermark, `delay` behind the newest command, has passed. Commands of a micro-batch are taken in the order of
    ts, then seq. get_by_url finds the newest entry of an address. Unknown ops are left alone. read_store() shows what
    is held.
    """
    rows = commands.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = rows.select(F.coalesce(F.col("store").cast("string"), F.lit("")).alias("store"), "op", F.col("id").cast("string").alias("id"), "url", "data", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), F.col("seq").cast("long").alias("seq"), F.unix_millis("ts").alias("at_ms"), "ts")
    return rows.groupBy("store").transformWithStateInPandas(Store(ttl_s * 1000), ANSWERS, "append", "EventTime")


def read_store(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a store's stream holds, from its checkpoint: (store, id, url, data, size, at_ms)."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "entries").load()
    return held.select(F.col("key.store").alias("store"), F.col("user_map_key.id").alias("id"), "user_map_value.*")
