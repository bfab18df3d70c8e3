"""Queries over the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.operators import memory as M
from pagelathe.plans.catalog import register
from pagelathe.sources.tables import table


def messages(spark, d):
    return table(spark, d, "conversations")


#: Cue words that the synthetic texts hold, in the place of English ones.
CUES = {"decisions": ("the", "des"), "results": ("and", "que"), "errors": ("erer", "ment"), "open": ("thth", "ung"), "plans": ("tion", "sch")}


@register("conv_stats", "SELECT conv_id, count(*) AS messages, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, count(*) FILTER (role = 'system') AS systems, sum(length(text) // 4) / count(*) AS mean_tokens FROM conversations GROUP BY conv_id")
def conv_stats(spark, d):
    """A13/X19."""
    return M.stats(messages(spark, d))


@register("conv_keep_recent", "SELECT conv_id, turn, role = 'system' OR rank <= 3 AS kept FROM (SELECT *, sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations)")
def conv_keep_recent(spark, d):
    """What stays of each conversation."""
    return M.recent(messages(spark, d), 3).select("conv_id", "turn", "kept")


@register("conv_running_tokens", "SELECT conv_id, turn, CAST(total AS BIGINT) AS total, CASE WHEN total / 400.0 >= 0.92 THEN 'compact' WHEN total / 400.0 >= 0.8 THEN 'error' WHEN total / 400.0 >= 0.6 THEN 'warn' ELSE 'ok' END AS state FROM (SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations)")
def conv_running_tokens(spark, d):
    """Running tokens against a context of 400."""
    return M.running(messages(spark, d), 400)


SQL_OLD = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT *, role = 'system' OR sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 AS kept FROM conversations) WHERE NOT kept OR role = 'system')"


# every other answer stands for what a tool returned, as the table has no such role
SQL_OLD_TOOLS = SQL_OLD.replace("FROM conversations", "FROM (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'tool' ELSE role END AS role FROM conversations)")


def sql_cue(words):
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


def sql_segment(when, n, chars, last=False):
    rows = f"list(left(text, {chars}) ORDER BY turn) FILTER ({when})"
    return f"coalesce(array_to_string({rows}[{f'-{n}:' if last else f'1:{n}'}], chr(10) || '- '), '')"


SQL_PARTS = {
    "Background": sql_segment("n <= 5 AND role IN ('system', 'user')", 2, 200),
    "Key decisions": sql_segment(f"role = 'assistant' AND {sql_cue(CUES['decisions'])}", 5, 150),
    "Tools used": sql_segment("role = 'tool' AND text <> ''", 10, 100, True),
    "User intent": "CASE WHEN count(*) FILTER (role = 'user') > 1 THEN 'Initial: ' || left(arg_min(text, turn) FILTER (role = 'user'), 150) || chr(10) || '- Latest of ' || count(*) FILTER (role = 'user') || ': ' || left(arg_max(text, turn) FILTER (role = 'user'), 150) ELSE coalesce(left(arg_min(text, turn) FILTER (role = 'user'), 150), '') END",
    "Results": sql_segment(f"role = 'assistant' AND {sql_cue(CUES['results'])}", 5, 150, True),
    "Errors": sql_segment(sql_cue(CUES["errors"]), 3, 150, True),
    "Open issues": sql_segment(sql_cue(CUES["open"]), 5, 150),
    "Plans": sql_segment(f"role = 'assistant' AND {sql_cue(CUES['plans'])}", 3, 150, True),
}
SQL_SUMMARY = ", ".join(f"""CASE WHEN "{k}" <> '' THEN '## {k}' || chr(10) || '- ' || "{k}" END""" for k in SQL_PARTS)
_COLUMNS = ", ".join(f'{v} AS "{k}"' for k, v in SQL_PARTS.items())


@register("conv_compaction", f"SELECT conv_id, compacted, concat_ws(chr(10), {SQL_SUMMARY}) AS summary FROM (SELECT conv_id, count(*) FILTER (role <> 'system') AS compacted, {_COLUMNS} FROM {SQL_OLD_TOOLS} GROUP BY conv_id) WHERE compacted > 0")
def conv_compaction(spark, d):
    """Summaries of what doesn't stay."""
    role = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), "tool").otherwise(F.col("role"))
    return M.compact(messages(spark, d).withColumn("role", role), 2, CUES)


@register("conv_compression_ratio", "SELECT conv_id, sum(length(text)) AS before, sum(least(length(text), 100)) AS after, round(sum(least(length(text), 100)) / sum(length(text)), 6) AS ratio, sum(length(text) - least(length(text), 100)) // 4 AS tokens_saved FROM conversations GROUP BY conv_id")
def conv_compression_ratio(spark, d):
    """What cutting messages at 100 characters saves."""
    n = F.char_length("text")
    cut = F.least(n, F.lit(100))
    return messages(spark, d).groupBy("conv_id").agg(F.sum(n).alias("before"), F.sum(cut).alias("after"), F.round(F.sum(cut) / F.sum(n), 6).alias("ratio"), F.floor(F.sum(n - cut) / 4).alias("tokens_saved"))


@register("conv_render", "SELECT conv_id, turn, '[' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(turn * 61), '%H:%M:%S') || '] ' || upper(role) || ': ' || left(text, 200) AS line FROM conversations")
def conv_render(spark, d):
    """Messages as lines, a made-up time each."""
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 61)
    return messages(spark, d).select("conv_id", "turn", F.format_string("[%s] %s: %s", F.date_format(ts, "HH:mm:ss"), F.upper("role"), F.left("text", F.lit(200))).alias("line"))


@register("conv_once", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n = 1")
def conv_once(spark, d):
    """The first message of each role, as a guard lets one pass."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return messages(spark, d).select("conv_id", "turn", "role", F.row_number().over(w).alias("n")).where("n = 1").drop("n")


@register("conv_titles", r"SELECT conv_id, left(trim(regexp_replace(arg_min(text, turn), '\s*[|–—-][^\n]*$', ''), ' '), 50) AS title, printf('%04d', conv_id) AS label FROM conversations GROUP BY conv_id")
def conv_titles(spark, d):
    """Titles and numbered labels."""
    g = messages(spark, d).groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    title = F.left(F.trim(F.regexp_replace("t", r"\s*[|–—-][^\n]*$", "")), F.lit(50))
    return g.select("conv_id", title.alias("title"), F.format_string("%04d", "conv_id").alias("label"))
