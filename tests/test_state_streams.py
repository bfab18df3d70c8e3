"""Streams with state against batches and plain Python: shuffled micro-batches, many rows a key, restarts, expiry."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from pagelathe.operators import logs, memory
from pagelathe.streaming import queries, state


@pytest.fixture(scope="module", autouse=True)
def provider(spark):
    state.prepare(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream(spark, df, path, files=1):
    """A stream over the rows of df, a file at a time."""
    df.coalesce(1).write.mode("append").option("maxRecordsPerFile", 10**9).parquet(path) if files == 1 else df.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, mode, sink, checkpoint):
    """All that is there now, each micro-batch's rows appended to a table."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = q.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(sink)).start()
    q.awaitTermination(300)
    return df.sparkSession.read.parquet(sink)


def last(rows):
    """Each group as it was told last."""
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r.batch):
        out[r.source, r.message] = None if r.gone else (r.occurrences, r.first_ts, r.last_ts)
    return {k: v for k, v in out.items() if v}


def test_error_groups(spark, sf, tmp_path):
    at = lambda x: str(tmp_path / x)
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'error'")
    m = e.select((F.col("user_id") % 3).cast("string").alias("source"), F.concat(F.lit("failed "), (F.col("event_id") % 20).cast("string")).alias("message"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    m = m.union(m.limit(2).selectExpr("source", "CAST(NULL AS STRING)", "ts")).cache()
    a, b = m.randomSplit([0.5, 0.5], 3)
    for mode, part in (("first", a), ("again", b)):  # the second run starts from the checkpoint
        got = last(run(state.error_groups(stream(spark, part.orderBy(F.rand(5)), at("in"), 3)), "update", at("out"), at("c")))
    want = logs.grouped_errors(m.withColumn("message", F.coalesce("message", F.lit(""))), ["source", "message"], "ts", 10_000).collect()
    assert got == {(r.source, r.message): (r.occurrences, r.first_ts, r.last_ts) for r in want}


def test_error_groups_are_capped(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    rows = spark.range(300).select(F.lit("s").alias("source"), F.concat(F.lit("m"), (F.col("id") % 150).cast("string")).alias("message"), (F.timestamp_seconds(F.col("id"))).cast("timestamp_ntz").alias("ts")).cache()
    for low, high in ((0, 100), (100, 200), (200, 300)):
        out = run(state.error_groups(stream(spark, rows.where((F.unix_seconds(F.col("ts").cast("timestamp")) >= low) & (F.unix_seconds(F.col("ts").cast("timestamp")) < high)), at("in")), 50), "update", at("out"), at("c"))
    assert sorted(k[1] for k in last(out)) == sorted(f"m{i % 150}" for i in range(250, 300))
    assert out.where("gone").count() > 0 and out.groupBy("batch").agg(F.count_if(~F.col("gone")).alias("n")).where("n > 50").count() == 0


def plain_compactions(messages, most, keep):
    held, total, n, out = [], 0, 0, []
    for turn, role, text in messages:
        held.append((turn, role, text, len(text) // 4))
        total += len(text) // 4
        if total >= most:
            others = [m for m in held if m[1] != "system"]
            old = others[: len(others) - keep]
            if old:
                n += 1
                out += [(n, *m) for m in sorted([m for m in held if m[1] == "system"] + old)]
                held = [m for m in held if m[1] == "system" or m not in old]
                total = sum(m[3] for m in held)
    return out


def conversations(seed, sizes):
    rng = random.Random(seed)
    return {c: [(t, "system" if t == 0 else rng.choice(["user", "assistant", "tool"]), f"{t} " + "we decided to go " * rng.randint(0, 6)) for t in range(n)] for c, n in sizes.items()}


def told(rows):
    got = collections.defaultdict(list)
    for r in rows.collect():
        got[r.conv_id].append((r.compaction, r.turn, r.role, r.text, r.tokens))
    return {k: sorted(v) for k, v in got.items()}


def test_compactions_in_any_order(spark, tmp_path):
    """More rows of a key than an Arrow batch holds, newest first, shuffled over micro-batches and a restart, some twice."""
    at = lambda x: str(tmp_path / x)
    talks = conversations(1, {1: 21_000, 2: 40, 3: 1, 4: 333})
    rows = [(c, t, r, x) for c, v in talks.items() for t, r, x in v]
    want = {c: w for c, v in talks.items() if (w := plain_compactions(v, 400, 5))}
    schema = "conv_id long, turn long, role string, text string"
    random.Random(2).shuffle(rows)
    for part in (rows[:9000] + rows[:100], rows[9000:]):
        df = spark.createDataFrame(part, schema).repartition(2).sortWithinPartitions(F.desc("turn"))
        got = run(state.closed(stream(spark, df, at("in"), 2), 400, 5), "append", at("out"), at("c"))
    assert told(got) == {c: sorted(w) for c, w in want.items()} and len(want[1]) > 15_000


def test_compaction_summaries(spark, tmp_path):
    """The segments of each compaction are those that the batch operator gives for its messages."""
    at = lambda x: str(tmp_path / x)
    talks = conversations(7, {5: 60, 6: 61})
    df = spark.createDataFrame([(c, t, r, x) for c, v in talks.items() for t, r, x in v], "conv_id long, turn long, role string, text string")
    taken = run(state.closed(stream(spark, df, at("in"), 3), 200, 4), "append", at("out"), at("c"))
    got = {(r.conv_id, r.compaction): (r.compacted, r.summary) for r in state.summaries(taken).collect()}
    assert len(got) > 4 and {k[0] for k in got} == {5, 6}
    for (c, n), found in got.items():
        mine = [(c, t, r, x) for k, t, r, x, _ in plain_compactions(talks[c], 200, 4) if k == n]
        one = memory.compact(spark.createDataFrame(mine, df.schema), 0).first()
        assert found == (one.compacted, one.summary)


def test_store(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    schema = "store string, op string, id string, url string, data string, size long, ts timestamp, seq long"
    when = lambda s: f"2024-01-01 00:{s // 60:02}:{s % 60:02}"

    def feed(*rows):
        df = spark.createDataFrame([(*r[:6], when(r[6]), i) for i, r in enumerate(rows)], schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
        out = run(state.store(stream(spark, df.orderBy(F.desc("seq")), at("in")), 100), "append", at("out"), at("c"))
        return sorted(((r.store, r.op, r.id, r.url, r.data, r.found) for r in out.where(f"batch >= {feed.seen}").collect()), key=str), out.agg(F.max("batch")).first()[0]

    feed.seen = 0
    got, n = feed(("a", "put", "1", "u", "old", 5, 0), ("a", "put", "2", "u", "new", 7, 10), ("b", "put", "1", "v", "x", 1, 0), ("a", "get", "1", None, None, 0, 99), ("a", "get_by_url", None, "u", None, 0, 20), ("a", "get_by_url", None, "w", None, 0, 21), ("a", "get", "1", None, None, 0, 50), ("b", "what", None, None, None, 0, 1))
    assert got == [("a", "get", "1", "u", "old", True), ("a", "get", "1", "u", "old", True), ("a", "get_by_url", "2", "u", "new", True), ("a", "get_by_url", None, "w", None, False)]
    held = {(r.store, r.id): (r.url, r.data, r.size) for r in state.read_store(spark, at("c")).collect()}
    assert held == {("a", "1"): ("u", "old", 5), ("a", "2"): ("u", "new", 7), ("b", "1"): ("v", "x", 1)}
    feed.seen = n + 1
    got, n = feed(("a", "get", "1", None, None, 0, 100), ("a", "get", "2", None, None, 0, 109), ("b", "put", "9", "v", "y", 3, 105), ("b", "clear", None, None, None, 0, 104), ("c", "put", "3", "z", "z", 1, 150), ("c", "delete", "3", None, None, 0, 151), ("c", "delete", "4", None, None, 0, 152))
    answers = [x for x in got if x[1] != "expired"]
    assert answers == [("a", "get", "1", None, None, False), ("a", "get", "2", "u", "new", True), ("b", "clear", None, None, "0", True), ("c", "delete", "3", None, None, True), ("c", "delete", "4", None, None, False)]
    feed.seen = n + 1
    got, n = feed(("d", "put", "0", "q", "q", 1, 400))
    everything = spark.read.parquet(at("out")).where("op = 'expired'").collect()
    assert {(r.store, r.id) for r in everything} >= {("a", "1"), ("a", "2")} and ("c", "3") not in {(r.store, r.id) for r in everything}
    assert {(r.store, r.id) for r in state.read_store(spark, at("c")).collect()} <= {("d", "0"), ("b", "9")}


def test_store_counts(spark, sf, tmp_path):
    """What the state holds after a stream of puts is what the batch counts."""
    at = lambda x: str(tmp_path / x)
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 7).cast("string").alias("store"), F.lit("put").alias("op"), F.col("event_id").cast("string").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("props").alias("data"), F.octet_length("props").cast("long").alias("size"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    run(state.store(stream(spark, e, at("in"), 3), 10**8, "60 days"), "append", at("out"), at("c"))
    got = state.read_store(spark, at("c")).groupBy("store").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    want = e.groupBy("store").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_versions_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 40), i, f"s{i}") for i, k in enumerate([1] * 12_000 + [2] * 5)]
    want = {k: max((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])) for k in (1, 2)}
    df = spark.createDataFrame(rows, "key long, version long, seq long, state string").orderBy(F.rand(1))
    out = run(queries.versions(stream(spark, df, str(tmp_path / "in"), 2)), "update", str(tmp_path / "out"), str(tmp_path / "c"))
    got = {r.key: (r.version, r.state) for r in sorted(out.collect(), key=lambda r: r.batch)}
    assert got == {k: (r[1], r[3]) for k, r in want.items()}
