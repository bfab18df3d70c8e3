"""Errors and event logs: classification, grouping, priorities, as-of joins, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns of errors in order, with category and severity, and whether their group is what the error is about.
CATALOGUE = (
    (r"Cannot find module ['\"]([^'\"]+)['\"]", "MISSING_IMPORT", "HIGH", True),
    (r"Module not found: Error: Can't resolve ['\"]([^'\"]+)['\"]", "MISSING_IMPORT", "HIGH", True),
    (r"Failed to resolve import ['\"]([^'\"]+\.css)['\"]", "MISSING_CSS", "MEDIUM", True),
    (r"SyntaxError: (.+)", "SYNTAX_ERROR", "HIGH", True),
    (r"React is not defined", "MISSING_REACT_IMPORT", "MEDIUM", False),
    (r"(.+) is not defined", "UNDEFINED_VARIABLE", "MEDIUM", True),
    (r"TypeError: (.+)", "TYPE_ERROR", "MEDIUM", True),
    (r"Failed to compile", "BUILD_FAILED", "HIGH", False),
    (r"npm ERR!", "NPM_ERROR", "HIGH", False),
    (r"Process exited with code (\d+)", "PROCESS_EXIT", "HIGH", False),
    (r"npm ERR! code E(\d+)", "NPM_ERROR", "HIGH", False),
    (r"ENOENT|EACCES|EPERM", "FILESYSTEM_ERROR", "HIGH", False),
    (r"WHITE_SCREEN", "WHITE_SCREEN", "CRITICAL", False),
    (r"\[plugin:vite:([^\]]+)\]", "VITE_PLUGIN_ERROR", "HIGH", True),
    (r"Unexpected token", "SYNTAX_ERROR", "HIGH", False),
    (r"Invalid hook call", "REACT_HOOK_ERROR", "HIGH", False),
)
# Order of fixing by category; others come last, at 99.
FIX_ORDER = {"BUILD_FAILED": 1, "VITE_PLUGIN_ERROR": 2, "MISSING_IMPORT": 3, "MISSING_CSS": 4, "SYNTAX_ERROR": 5, "REACT_HOOK_ERROR": 6, "TYPE_ERROR": 7, "UNDEFINED_VARIABLE": 8, "NPM_ERROR": 9, "PROCESS_EXIT": 10, "WHITE_SCREEN": 11, "FILESYSTEM_ERROR": 12, "MISSING_REACT_IMPORT": 13}
# Order of the sources of errors, and of their severities.
SOURCE_ORDER = {"browser": 0, "terminal": 1, "static": 2}
SEVERITY_ORDER = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def first_match(text: Column, catalogue: tuple, column: int) -> Column:
    """The catalogue's value for the first of its patterns that a text has, else null."""
    out = F.when(text.rlike(f"(?i){catalogue[0][0]}"), catalogue[0][column])
    for row in catalogue[1:]:
        out = out.when(text.rlike(f"(?i){row[0]}"), row[column])
    return out


def lookup(c: Column, values: dict, default: object) -> Column:
    """A CASE over a short fixed mapping."""
    out = F.when(F.lit(False), F.lit(default))
    for k, v in values.items():
        out = out.when(c == k, v)
    return out.otherwise(default)


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key, by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overall_severity(severities: DataFrame, keys: list) -> DataFrame:
    """CRITICAL with any critical or over two high ones, else the highest there is, LOW without any."""
    g = severities.groupBy(*keys).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("CRITICAL", "HIGH", "MEDIUM")))
    return g.select(*keys, F.when((F.col("CRITICAL") > 0) | (F.col("HIGH") > 2), "CRITICAL").when(F.col("HIGH") > 0, "HIGH").when(F.col("MEDIUM") > 0, "MEDIUM").otherwise("LOW").alias("severity"))


def grouped_errors(events: DataFrame, keys: list, ts: str, most: int = 50) -> DataFrame:
    """Occurrences, first and last time of each key, the `most` that came last."""
    g = events.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return g.orderBy(F.desc("last_ts"), *keys).limit(most)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """For each left row the value of the latest right row of its keys that isn't later. One sort of both sides together; no pairs are made."""
    both = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None)).unionByName(right.select(*keys, ts, F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"asof_{value}", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def micros(c: str | Column) -> Column:
    """Microseconds of a time with or without zone, read in the session's zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def sessions(events: DataFrame, key: str, ts: str, gap_s: int) -> DataFrame:
    """Runs of a key's events without a gap over `gap_s` seconds."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    new = F.when(F.lag(ts).over(w).isNull() | ((micros(ts) - micros(F.lag(ts).over(w))) > gap_s * 1_000_000), 1).otherwise(0)
    rows = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def subject(text: Column, catalogue: tuple = CATALOGUE) -> Column:
    """What an error is about: the group of the catalogue's first pattern that its text has, null where that has none."""
    out = F.when(F.lit(False), F.lit(""))
    for pattern, _, _, named in catalogue:
        out = out.when(text.rlike(f"(?i){pattern}"), F.regexp_extract(text, f"(?i){pattern}", 1) if named else F.lit(None).cast("string"))
    return out


def merge_errors(sources: dict[str, DataFrame]) -> DataFrame:
    """Errors (seq, file, line, message) of several sources as one table: of those with equal file, line and first 50 characters the first stays, by the order of `sources` and seq; ordered by source (rank), file and line."""
    parts = [df.select(F.lit(k).alias("turn"), F.lit(name).alias("source"), "seq", "file", "line", "message") for k, (name, df) in enumerate(sources.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = keep_first(every, ["file", "line", F.left(F.coalesce("message", F.lit("")), F.lit(50))], ["turn", "seq"])
    return one.withColumn("rank", lookup(F.col("source"), SOURCE_ORDER, 99)).orderBy("rank", F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), "turn", "seq").drop("turn")


def severity_rank(severity: Column) -> Column:
    """A severity's place, unknown ones last."""
    return lookup(severity, SEVERITY_ORDER, 99)


# Commands that mend an error, by category; {module} is the quoted name in the message, {file} the file at fault, {path} the one to be made.
FIXES = {
    "local": '# Option 1: Create the missing file\nwrite_file(path="{path}", content="""\nexport default function Component() {\n  return <div>Component</div>;\n}\n""")\n\n# Option 2: Remove the import (if not needed)\n# edit_file(path="{file}", old_text="import ... from \'{module}\';", new_text="")',
    "package": '# Install the missing package\ninstall_dependencies(packages=["{module}"])',
    "MISSING_CSS": '# Create the missing CSS file\nwrite_file(path="{file}", content="""\n/* Auto-generated CSS file */\n""")',
    "SYNTAX_ERROR": '# First, read the file to see the error\nread_file(path="{file}")\n\n# Then fix with edit_file()\n# edit_file(path="{file}", old_text="problematic code", new_text="fixed code")',
    "WHITE_SCREEN": '# Diagnose white screen\n1. take_screenshot()  # See what\'s actually rendered\n2. read_file(path="src/main.jsx")  # Check entry point\n3. read_file(path="src/App.jsx")  # Check main component\n4. get_console_messages()  # Check for silent errors',
    "NPM_ERROR": '# Fix NPM errors\nshell("rm -rf node_modules")\ninstall_dependencies()',
    "BUILD_FAILED": '# Get more details about the build error\nget_all_terminals_output()\ndiagnose_preview_state()\n\n# Then fix the specific file mentioned in the error\n# read_file(path="{file}")\n# edit_file(path="{file}", old_text="...", new_text="...")',
}
DEFAULT_FILE = "src/App.jsx"


def fix_command(category: Column, file: Column, message: Column) -> Column:
    """The command that mends an error of a category, in a file that may be null; null where there is none."""
    module = F.nullif(F.regexp_extract(message, "['\"]([^'\"]+)['\"]", 1), F.lit(""))
    bare = F.regexp_replace(module, "^[./]+", "")
    beside = F.concat(F.regexp_extract(file, "^(.*)/[^/]*$", 1), F.lit("/"), bare)
    path = F.when(file.isNull(), F.concat(F.lit("src/"), bare, F.lit(".jsx"))).when(beside.rlike(r"\.(jsx|tsx|js|ts)$"), beside).otherwise(F.concat(beside, F.lit(".jsx")))

    def filled(name: str) -> Column:
        out = F.lit(FIXES[name])
        for k, v in (("{path}", path), ("{module}", module), ("{file}", F.coalesce(file, F.lit(DEFAULT_FILE)))):
            if k in FIXES[name]:
                out = F.replace(out, F.lit(k), v)
        return out

    out = F.when((category == "MISSING_IMPORT") & module.rlike("^[./]"), filled("local")).when((category == "MISSING_IMPORT") & module.isNotNull(), filled("package"))
    out = out.when(category.isin("MISSING_CSS") & file.isNotNull(), filled("MISSING_CSS")).when((category == "SYNTAX_ERROR") & file.isNotNull(), filled("SYNTAX_ERROR"))
    return out.when(category == "WHITE_SCREEN", filled("WHITE_SCREEN")).when(category == "NPM_ERROR", filled("NPM_ERROR")).when(category.isin("BUILD_FAILED", "VITE_PLUGIN_ERROR"), filled("BUILD_FAILED"))


def answered(requests: DataFrame, responses: DataFrame, keys: list[str], ts: str, value: str, timeout_s: int) -> DataFrame:
    """Each request with the value of the first response of its keys that isn't earlier, status resolved; without one within `timeout_s` seconds it is timed out. One sort of both sides together, from the last row back; no pairs are made."""
    both = requests.withColumn("_side", F.lit(0)).withColumn("_r", F.lit(None)).unionByName(responses.select(*keys, ts, F.lit(1).alias("_side"), F.struct(F.col(ts).alias("at"), F.col(value).alias("v")).alias("_r")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_next", F.last("_r", ignorenulls=True).over(w)).where("_side = 0")
    ok = F.coalesce(micros(F.col("_next.at")) - micros(ts) <= timeout_s * 1_000_000, F.lit(False))
    return rows.withColumn("status", F.when(ok, "resolved").otherwise("timeout")).withColumn("response", F.when(ok, F.col("_next.v"))).drop("_side", "_r", "_next")


def concurrency(runs: DataFrame, keys: list[str], start: str, end: str, most: int = 10) -> DataFrame:
    """Of each key the runs (start, end), the most at any one time, an end before a start at the same time, and whether that keeps to `most`. Starts and ends are sorted together; no pairs are made."""
    edges = runs.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))).alias("e")).select(*keys, "e.*")
    w = Window.partitionBy(*keys).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    g = edges.withColumn("now", F.sum("step").over(w)).groupBy(*keys).agg(F.count_if(F.col("step") == 1).alias("runs"), F.max("now").alias("peak"))
    return g.withColumn("within", F.col("peak") <= most)
