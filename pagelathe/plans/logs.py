"""Queries over the events table, as a log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.functions import text as X
from pagelathe.operators import jsonq, logs
from pagelathe.plans.catalog import register
from pagelathe.sources.tables import table


def events(spark, d):
    return table(spark, d, "events")


# Messages that stand for errors of the log, by event number.
MESSAGES = ("Cannot find module './a'", "SyntaxError: Unexpected token /src/App.jsx:12:5", "foo is not defined", "React is not defined at src/main.tsx:7", "all is well", "Failed to resolve import \"x.css\"", "Error on Line 9, column: 4", "Module not found: Error: Can't resolve 'q/r'", "TypeError: x is null", "Failed to compile", "npm ERR! code E404", "Process exited with code 3", "open /a: ENOENT", "WHITE_SCREEN at /", "[plugin:vite:css] bad", "Unexpected token <", "Invalid hook call", "cannot load './m.css': Failed to resolve import './m.css'")
MESSAGE = f"CASE event_id % {len(MESSAGES)} " + " ".join(f"WHEN {i} THEN '{m.replace(chr(39), chr(39) * 2)}'" for i, m in enumerate(MESSAGES)) + " END"
SQL_LOG = f"(SELECT *, {MESSAGE} AS message FROM events)"


def log(spark, d):
    """Events with a message each."""
    m = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % len(MESSAGES)).cast("int") + 1)
    return events(spark, d).withColumn("message", m)


# Written out, not taken from the library: what each of MESSAGES is and is about.
KNOWN = (("MISSING_IMPORT", "./a"), ("SYNTAX_ERROR", "Unexpected token /src/App.jsx:12:5"), ("UNDEFINED_VARIABLE", "foo"), ("MISSING_REACT_IMPORT", None), (None, None), ("MISSING_CSS", "x.css"), (None, None), ("MISSING_IMPORT", "q/r"), ("TYPE_ERROR", "x is null"), ("BUILD_FAILED", None), ("NPM_ERROR", None), ("PROCESS_EXIT", None), ("FILESYSTEM_ERROR", None), ("WHITE_SCREEN", None), ("VITE_PLUGIN_ERROR", "css"), ("SYNTAX_ERROR", None), ("REACT_HOOK_ERROR", None), ("MISSING_CSS", "./m.css"))


def sql_known(k: int) -> str:
    return f"CASE event_id % {len(MESSAGES)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if row[k] is None else f"'{row[k]}'") for i, row in enumerate(KNOWN)) + " END"


@register("error_subjects", f"SELECT event_id, {sql_known(0)} AS category, {sql_known(1)} AS subject FROM events")
def error_subjects(spark, d):
    """What errors are about."""
    m = F.col("message")
    return log(spark, d).select("event_id", logs.first_match(m, logs.CATALOGUE, 1).alias("category"), logs.subject(m).alias("subject"))


SQL_SOURCES = "SELECT CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS turn, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '/f' || (event_id % 40) END AS file, CAST(event_id % 9 AS INT) AS line, 'm' || (event_id % 3) || ' ' || repeat('x', 60) || event_id AS message FROM events WHERE event_type IN ('error', 'click', 'view')"


@register("error_merge", f"SELECT seq, file, line, message, ['terminal', 'browser', 'static'][turn + 1] AS source, [1, 0, 2][turn + 1] AS rank FROM ({SQL_SOURCES} QUALIFY row_number() OVER (PARTITION BY file, line, left(message, 50) ORDER BY turn, seq) = 1)")
def error_merge(spark, d):
    """Errors of terminal, browser and code as one ordered list."""
    e = spark.sql(SQL_SOURCES.replace("FROM events", "FROM {e}"), e=events(spark, d))
    return logs.merge_errors({name: e.where(F.col("turn") == k) for k, name in enumerate(("terminal", "browser", "static"))})


@register("severity_order", "SELECT severity, list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], severity) - 1 AS rank, n FROM (SELECT ['LOW', 'HIGH', 'CRITICAL', 'MEDIUM'][event_id % 4 + 1] AS severity, count(*) AS n FROM events GROUP BY ALL)")
def severity_order(spark, d):
    """Issues by severity."""
    s = F.element_at(F.array(*map(F.lit, ("LOW", "HIGH", "CRITICAL", "MEDIUM"))), (F.col("event_id") % 4 + 1).cast("int"))
    return events(spark, d).groupBy(s.alias("severity")).agg(F.count("*").alias("n")).select("severity", logs.severity_rank(F.col("severity")).cast("long").alias("rank"), "n")


def sql_first(column: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(message, '(?i){p.replace(chr(92) + chr(34), chr(34)).replace(chr(39), chr(39) * 2)}') THEN '{row[column - 1]}'" for p, *row in logs.CATALOGUE if row) + " END"


SQL_FIX = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in logs.FIX_ORDER.items()) + " ELSE 99 END"


@register("error_categories", f"SELECT event_id, category, severity, {SQL_FIX} AS priority FROM (SELECT event_id, {sql_first(1)} AS category, {sql_first(2)} AS severity FROM {SQL_LOG}) WHERE category IS NOT NULL")
def error_categories(spark, d):
    """Errors by the first pattern that fits, with the order of fixing."""
    m = F.col("message")
    out = log(spark, d).select("event_id", logs.first_match(m, logs.CATALOGUE, 1).alias("category"), logs.first_match(m, logs.CATALOGUE, 2).alias("severity")).where("category IS NOT NULL")
    return out.withColumn("priority", logs.lookup(F.col("category"), logs.FIX_ORDER, 99))


AT = r"([^\s:]+\.(?:jsx?|tsx?|vue|svelte|css|scss)):(\d+)(?::(\d+))?"
BARE = r"(/[^\s:]+\.(?:jsx?|tsx?|vue|svelte|css|scss))"


@register("error_locations", rf"SELECT event_id, CASE WHEN has THEN nullif(regexp_extract(message, '{AT}', 1), '') ELSE nullif(regexp_extract(message, '{BARE}', 1), '') END AS file, CAST(CASE WHEN has THEN nullif(regexp_extract(message, '{AT}', 2), '') ELSE nullif(regexp_extract(message, '[Ll]ine[:\s]+(\d+)', 1), '') END AS BIGINT) AS line, CAST(CASE WHEN has THEN nullif(regexp_extract(message, '{AT}', 3), '') ELSE nullif(regexp_extract(message, '[Cc]ol(?:umn)?[:\s]+(\d+)', 1), '') END AS BIGINT) AS col FROM (SELECT *, regexp_matches(message, '{AT}') AS has FROM {SQL_LOG})")
def error_locations(spark, d):
    """Files, lines and columns of messages."""
    return log(spark, d).select("event_id", X.location(F.col("message")).alias("at")).select("event_id", "at.file", "at.line", F.col("at.column").alias("col"))


@register("error_groups", f"SELECT user_id, message, count(*) AS occurrences, min(ts) AS first_ts, max(ts) AS last_ts FROM {SQL_LOG} WHERE event_type = 'error' GROUP BY user_id, message ORDER BY last_ts DESC, user_id, message LIMIT 50")
def error_groups(spark, d):
    """The 50 groups of errors that came last."""
    return logs.grouped_errors(log(spark, d).where("event_type = 'error'"), ["user_id", "message"], "ts")


@register("error_first_seen", f"SELECT event_id, user_id, left(md5(event_type || ':' || left(message, 100)), 12) AS key FROM (SELECT *, row_number() OVER (PARTITION BY user_id, md5(event_type || ':' || left(message, 100)) ORDER BY ts, event_id) AS n FROM {SQL_LOG}) WHERE n = 1")
def error_first_seen(spark, d):
    """The first of each user's errors with one key."""
    key = F.md5(F.concat_ws(":", "event_type", F.left("message", F.lit(100))).cast("binary"))
    return logs.keep_first(log(spark, d).withColumn("key", key), ["user_id", "key"], ["ts", "event_id"]).select("event_id", "user_id", F.left("key", F.lit(12)).alias("key"))


@register("severity_rollup", f"SELECT user_id, CASE WHEN h > 2 THEN 'CRITICAL' WHEN h > 0 THEN 'HIGH' WHEN m > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM (SELECT user_id, count(*) FILTER (s = 'HIGH') AS h, count(*) FILTER (s = 'MEDIUM') AS m FROM (SELECT user_id, {sql_first(2)} AS s FROM {SQL_LOG}) GROUP BY user_id)")
def severity_rollup(spark, d):
    """Overall severity of each user."""
    return logs.overall_severity(log(spark, d).withColumn("severity", logs.first_match(F.col("message"), logs.CATALOGUE, 2)), ["user_id"])


@register("event_type_counts", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type IN ('click', 'view')) AS reads, sum(value) AS total FROM events GROUP BY user_id")
def event_type_counts(spark, d):
    """Counters."""
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type").isin("click", "view")).alias("reads"), F.sum("value").alias("total"))


@register("event_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def event_latest(spark, d):
    """Each user's latest event."""
    return events(spark, d).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@register("event_asof_click", "SELECT e.event_id, (SELECT max(c.event_id) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts <= e.ts) AS asof_click FROM events e WHERE event_type = 'purchase'")
def event_asof_click(spark, d):
    """The click that each purchase follows."""
    e = events(spark, d)
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return logs.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "click").select("event_id", "asof_click")


@register("event_delays", "SELECT event_id, greatest(least((us_next - us) / 1000.0 / 2, 5000.0 / 2), 50) AS delay_ms FROM (SELECT event_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS us_next FROM events) WHERE us_next IS NOT NULL")
def event_delays(spark, d):
    """Delays to the next event at double speed."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, d).select("event_id", logs.micros("ts").alias("us"), F.lead(logs.micros("ts")).over(w).alias("next")).where("next IS NOT NULL")
    return e.select("event_id", F.greatest(F.least((F.col("next") - F.col("us")) / 1000 / 2, F.lit(2500.0)), F.lit(50.0)).alias("delay_ms"))


@register("event_sessions", "SELECT user_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, session")
def event_sessions(spark, d):
    """Sessions with gaps of an hour."""
    return logs.sessions(events(spark, d), "user_id", "ts", 3600)


@register("event_phases", "SELECT user_id, max(p) AS progress, arg_max(phase, p) AS phase FROM (SELECT user_id, CASE event_type WHEN 'view' THEN 25 WHEN 'click' THEN 50 WHEN 'signup' THEN 75 WHEN 'purchase' THEN 100 ELSE 0 END AS p, CASE event_type WHEN 'view' THEN 'quick' WHEN 'click' THEN 'dom' WHEN 'signup' THEN 'advanced' WHEN 'purchase' THEN 'complete' ELSE 'pending' END AS phase FROM events) GROUP BY user_id")
def event_phases(spark, d):
    """How far each request came."""
    e = events(spark, d)
    p = logs.lookup(F.col("event_type"), {"view": 25, "click": 50, "signup": 75, "purchase": 100}, 0)
    name = logs.lookup(F.col("event_type"), {"view": "quick", "click": "dom", "signup": "advanced", "purchase": "complete"}, "pending")
    return e.groupBy("user_id").agg(F.max(p).alias("progress"), F.max_by(name, p).alias("phase"))


@register("event_health", "SELECT e.event_id, count(*) AS errors FROM events e JOIN events f ON f.user_id = e.user_id AND f.event_type = 'error' AND epoch_us(f.ts) BETWEEN epoch_us(e.ts) - 7200000000 AND epoch_us(e.ts) WHERE e.event_type = 'error' GROUP BY e.event_id")
def event_health(spark, d):
    """Errors in the time just before, by a trailing range."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-7_200_000_000, 0)
    return events(spark, d).where("event_type = 'error'").withColumn("us", logs.micros("ts")).select("event_id", F.count("*").over(w).alias("errors"))


@register("event_healing", "SELECT user_id, count(*) AS attempts, count(*) FILTER (same) AS same_errors, least(count(*), 5) AS counted FROM (SELECT user_id, event_type, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS same FROM events) GROUP BY user_id")
def event_healing(spark, d):
    """Attempts, and those whose error is the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, d).select("user_id", F.coalesce(F.col("event_type") == F.lag("event_type").over(w), F.lit(False)).alias("same"))
    return e.groupBy("user_id").agg(F.count("*").alias("attempts"), F.count_if("same").alias("same_errors"), F.least(F.count("*"), F.lit(5)).alias("counted"))


@register("event_tail", "SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('error', 'view')) WHERE n <= 20")
def event_tail(spark, d):
    """The last 20 of each user's lines, filtered first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, d).where(F.col("event_type").isin("error", "view")).select("user_id", "event_id", F.row_number().over(w).alias("n")).where("n <= 20")


@register("priority_queue", "SELECT o_orderkey, p, row_number() OVER (ORDER BY p DESC, o_orderkey) AS place FROM (SELECT o_orderkey, 6 - CAST(left(o_orderpriority, 1) AS INT) AS p FROM orders WHERE o_orderstatus = 'O') ORDER BY p DESC, o_orderkey LIMIT 1000")
def priority_queue(spark, d):
    """What a queue of 1000 gives out, by priority, then first come."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", (6 - F.left("o_orderpriority", F.lit(1)).cast("int")).alias("p"))
    top = o.orderBy(F.desc("p"), "o_orderkey").limit(1000)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("p"), "o_orderkey")))


@register("response_first_match", "SELECT r.event_id, s.event_id AS response_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click') r LEFT JOIN (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id) s ON r.user_id = s.user_id AND r.n = 1")
def response_first_match(spark, d):
    """A response fills the first request of its key; later ones stay empty."""
    e = events(spark, d)
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    asked = e.where("event_type = 'click'").select("event_id", "user_id", first.alias("n"))
    got = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("event_id").alias("response_id"))
    return asked.join(got, (asked.user_id == got.user_id) & (asked.n == 1), "left").select("event_id", "response_id")


@register("props_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def props_path(spark, d):
    """Paths into JSON."""
    return events(spark, d).select("event_id", jsonq.path("props", "$.k").cast("long").alias("k"), jsonq.path("props", "missing").alias("missing"))


@register("props_keys", "SELECT key, type, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT' ELSE json_type(props, '$.k') END AS type FROM events) GROUP BY key, type")
def props_keys(spark, d):
    """Keys of JSON objects and their types."""
    return jsonq.key_types(events(spark, d), "props").groupBy("key", "type").agg(F.count("*").alias("n"))


@register("string_hashes", "SELECT event_id, left(md5(event_type || event_id), 8) AS md5_8, left(sha256(event_type || event_id), 16) AS sha_16 FROM events")
def string_hashes(spark, d):
    """Short hashes."""
    s = F.concat("event_type", F.col("event_id").cast("string"))
    return events(spark, d).select("event_id", F.left(F.md5(s.cast("binary")), F.lit(8)).alias("md5_8"), X.short_hash(s).alias("sha_16"))


@register("js_hashes", "WITH RECURSIVE h(event_type, i, v) AS (SELECT DISTINCT event_type, 0, CAST(0 AS BIGINT) FROM events UNION ALL SELECT event_type, i + 1, (v * 31 + ascii(substr(event_type, i + 1, 1))) % 4294967296 FROM h WHERE i < length(event_type)) SELECT event_type, lower(printf('%X', abs(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END))) AS hash FROM h WHERE i = length(event_type)")
def js_hashes(spark, d):
    """The 32-bit string hash."""
    return events(spark, d).select("event_type").distinct().select("event_type", X.string_hash(F.col("event_type")).alias("hash"))


@register("iso_dates", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y-%m-%d') AS day, ts + INTERVAL 1 DAY AS expires FROM events")
def iso_dates(spark, d):
    """Dates as text, and when an entry ends."""
    return events(spark, d).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires"))


@register("event_frames", "SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events")
def event_frames(spark, d):
    """Events framed for a stream of server events."""
    return events(spark, d).select("event_id", F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\nevent: "), "event_type", F.lit("\ndata: "), "props", F.lit("\n\n")).alias("frame"))
