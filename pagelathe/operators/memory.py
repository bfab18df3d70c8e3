"""Conversation memory: recent windows, token totals, extractive compaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Cue words of the segments that go by words; callers give others for other languages.
CUES = {
    "decisions": ("decided", "choose", "selected", "approach", "strategy", "plan", "will implement", "going to", "decided to"),
    "results": ("completed", "finished", "success", "created", "updated", "done"),
    "errors": ("error", "failed", "exception", "issue"),
    "open": ("todo", "pending", "need to", "should", "remaining"),
    "plans": ("next", "will", "plan to", "then"),
}


def tokens(c: Column) -> Column:
    """Estimated tokens of a message."""
    return F.floor(F.char_length(c) / 4).cast("long")


def recent(messages: DataFrame, n: int) -> DataFrame:
    """System messages and the last n others; `kept` tells which of all messages stay."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    other = F.col("role") != "system"
    rank = F.sum(other.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("kept", ~other | (rank <= n))


def running(messages: DataFrame, context: int, trigger: float = 0.92) -> DataFrame:
    """Tokens so far, their share of the context, and its state."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(tokens(F.col("text"))).over(w)
    share = total / context
    return messages.select("conv_id", "turn", total.alias("total"), F.when(share >= trigger, "compact").when(share >= 0.8, "error").when(share >= 0.6, "warn").otherwise("ok").alias("state"))


def stats(messages: DataFrame) -> DataFrame:
    """Messages, tokens, roles, and the mean length of each conversation."""
    t = tokens(F.col("text"))
    role = lambda r: F.count_if(F.col("role") == r)
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(t).alias("tokens"), role("user").alias("users"), role("assistant").alias("assistants"), role("system").alias("systems"), (F.sum(t) / F.count("*")).alias("mean_tokens"))


def cued(words: tuple[str, ...], text: str = "text") -> Column:
    """Whether a text has one of the words, in either case."""
    out = F.lit(False)
    for w in words:
        out = out | F.lower(text).contains(w)
    return out


def segment(messages: DataFrame, when: Column, n: int, chars: int, last: bool = False) -> Column:
    """The first or last n texts for which `when` holds, cut, one a line; an aggregate over a conversation."""
    at = F.when(when, F.struct("turn", F.left("text", F.lit(chars)).alias("t")))
    all_ = F.sort_array(F.collect_list(at))
    part = F.slice(all_, F.greatest(F.size(all_) - n + 1, F.lit(1)), F.lit(n)) if last else F.slice(all_, 1, n)
    return F.array_join(F.transform(part, lambda x: x["t"]), "\n- ")


def _intent(chars: int = 150) -> Column:
    """The user's only text, or the first and the latest one with the number of texts; an aggregate over a conversation."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    cut = F.left("text", F.lit(chars))
    n, first, latest = F.count(user), F.min_by(cut, user), F.max_by(cut, user)
    return F.when(n > 1, F.concat(F.lit("Initial: "), first, F.lit("\n- Latest of "), n.cast("string"), F.lit(": "), latest)).otherwise(F.coalesce(first, F.lit("")))


def compact(messages: DataFrame, keep: int = 10, cues: dict[str, tuple[str, ...]] = CUES, segments: tuple[str, ...] | None = None, extractors: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """`extractors` (aggregates over a conversation's old messages, by segment) add to these segments or replace them, `segments` names those wanted, in order; one without extractor stays empty. One summary of all but the kept messages of each conversation: background, decisions, tools used and how often, the first and the latest wish of the user, results, errors, open issues and plans, by roles and cue words."""
    old = recent(messages, keep).where("NOT kept OR role = 'system'")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    old = old.withColumn("n", rank)
    said = F.col("role") == "assistant"
    parts = {
        "Background": segment(old, (F.col("n") <= 5) & F.col("role").isin("system", "user"), 2, 200),
        "Key decisions": segment(old, said & cued(cues["decisions"]), 5, 150),
        "Tools used": segment(old, (F.col("role") == "tool") & (F.col("text") != ""), 10, 100, True),
        "User intent": _intent(),
        "Results": segment(old, said & cued(cues["results"]), 5, 150, True),
        "Errors": segment(old, cued(cues["errors"]), 3, 150, True),
        "Open issues": segment(old, cued(cues["open"]), 5, 150),
        "Plans": segment(old, said & cued(cues["plans"]), 3, 150, True),
    }
    parts |= {k: make() for k, make in (extractors or {}).items()}
    parts = {k: parts.get(k, F.first(F.lit(""))) for k in segments or parts}
    g = old.groupBy("conv_id").agg(F.count_if(F.col("role") != "system").alias("compacted"), *(c.alias(k) for k, c in parts.items()))
    lines = [F.when(F.col(f"`{k}`") != "", F.concat(F.lit(f"## {k}\n- "), F.col(f"`{k}`"))) for k in parts]
    return g.where("compacted > 0").select("conv_id", "compacted", F.concat_ws("\n", *lines).alias("summary"))
