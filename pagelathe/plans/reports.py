"""Queries over contracts, reports and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelathe.operators import planning as P
from pagelathe.operators import reports as R
from pagelathe.plans.catalog import register
from pagelathe.plans.files import SQL_FILES, files
from pagelathe.plans.logs import SQL_LOG, log
from pagelathe.sources import files as S
from pagelathe.sources.tables import table

KINDS = ("header", "footer", "hero", "odd", "features")
SECTION = "p_partkey % 300 AS page_id, p_partkey AS section_id, p_brand || ' box-' || p_size AS name, CASE p_size % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END AS type, p_size AS n_images, NULL::INT AS n_links"
SQL_ORDER = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.TYPE_ORDER.items()) + f" ELSE {P.OTHER} END"
SQL_CONTRACTS = f"(SELECT page_id, section_id, lower(regexp_replace(trim(name), '[\\s-]+', '_', 'g')) AS namespace, CASE WHEN type = 'odd' THEN 'generic' ELSE type END AS type, coalesce(n_images, 0) AS min_images, coalesce(n_links, 0) AS min_links FROM (SELECT {SECTION} FROM part))"


def sections(spark, d):
    """Parts as sections of pages."""
    return table(spark, d, "part").selectExpr(*[x.replace("NULL::INT", "CAST(NULL AS INT)") for x in SECTION.split(", ")])


@register("section_contracts", f"SELECT * FROM {SQL_CONTRACTS}")
def section_contracts(spark, d):
    """Contracts of sections."""
    return P.contracts(sections(spark, d)).drop("component")


@register("integration_plan", f"SELECT page_id, section_id, row_number() OVER w AS place, CASE WHEN lag(namespace) OVER w IS NULL THEN 'start' ELSE 'after:' || lag(namespace) OVER w END AS position FROM {SQL_CONTRACTS} WINDOW w AS (PARTITION BY page_id ORDER BY {SQL_ORDER}, section_id)")
def integration_plan(spark, d):
    """Sections in order, each after the one before."""
    return P.integration_plan(P.contracts(sections(spark, d))).drop("component")


SQL_LEVEL = f"CASE WHEN regexp_matches(lower(message), '{R.ERROR_WORDS}') THEN 'error' WHEN regexp_matches(lower(message), '{R.WARNING_WORDS}') THEN 'warning' ELSE 'info' END"


@register("terminal_diagnosis", f"SELECT user_id, errors, warnings, coalesce(array_to_string(l[1:3], chr(10)), '') || CASE WHEN errors > 3 THEN chr(10) || '+' || (errors - 3) || ' more' ELSE '' END AS report FROM (SELECT user_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings, list(left(message, 200) ORDER BY event_id) FILTER (level = 'error') AS l FROM (SELECT *, {SQL_LEVEL} AS level FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM {SQL_LOG}) WHERE n <= 50) GROUP BY user_id)")
def terminal_diagnosis(spark, d):
    """What the last 50 lines of each terminal say."""
    return R.diagnosis(log(spark, d), "user_id", "event_id", "message")


SQL_SUGGEST = "CASE " + " ".join(f"WHEN contains(lower(message), '{w}') THEN '{s}'" for w, s in R.SUGGESTIONS) + " END"


@register("error_suggestions", f"SELECT event_id, {SQL_SUGGEST} AS suggestion FROM {SQL_LOG}")
def error_suggestions(spark, d):
    """Suggestions for errors."""
    return log(spark, d).select("event_id", R.suggestion(F.col("message")).alias("suggestion"))


@register("error_related_files", "SELECT event_id AS error_id, '/' || source || '/' || doc_id || '.txt' AS path FROM events JOIN documents ON doc_id = event_id WHERE event_type = 'error'")
def error_related_files(spark, d):
    """The files that errors name."""
    e = log(spark, d).where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.concat(F.lit("failed in "), F.col("event_id").cast("string"), F.lit(".txt now")).alias("message"))
    return R.related(e, files(spark, d))


@register("build_errors", f"SELECT event_id, 'vite:' || event_type AS plugin, '/src/App.jsx' AS file, CAST(event_id % 90 AS INT) AS line, 7 AS col, 2 AS frames, 1 AS stack FROM events")
def build_errors(spark, d):
    """Plugin, place, code frame and stack of build errors."""
    text = F.concat(F.lit("[plugin:vite:"), "event_type", F.lit("] /src/App.jsx:"), (F.col("event_id") % 90).cast("string"), F.lit(":7 bad\n 12 | let a\n    | ^\n   at run (x)"))
    return table(spark, d, "events").select("event_id", R.build_error(text).alias("e")).select("event_id", "e.plugin", "e.file", "e.line", F.col("e.column").alias("col"), F.size("e.frame").alias("frames"), F.size("e.stack").alias("stack"))


@register("image_url_totals", "SELECT count(DISTINCT path) AS files, count(*) AS urls, count(DISTINCT url) AS distinct_urls, count(*) FILTER (n = 1) AS fresh FROM (SELECT path, url, row_number() OVER (PARTITION BY url ORDER BY path) AS n FROM (SELECT DISTINCT '/p/' || page_id AS path, 'http://img.x/' || page_id % 40 || '.png' AS url FROM pages))")
def image_url_totals(spark, d):
    """Image addresses in code."""
    f = table(spark, d, "pages").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("path"), F.concat(F.lit('<img src="http://img.x/'), (F.col("page_id") % 40).cast("string"), F.lit('.png">')).alias("content"))
    return R.image_urls(f).agg(F.countDistinct("path").alias("files"), F.count("*").alias("urls"), F.countDistinct("url").alias("distinct_urls"), F.count_if("is_new").alias("fresh"))


#: Code that names an image in one of ten ways, or an address that is none; n tells pages apart.
NAMED = """CASE page_id % 13 WHEN 0 THEN concat('<img alt="a" src="https://a.b/', n, '.JPG">') WHEN 1 THEN concat('p{background:url(https://a.b/', n, '.webp) }') WHEN 2 THEN concat('<I src={`https://a.b/', n, '.tif`}/>')
 WHEN 3 THEN concat('<img src="https://picsum.photos/', n, '">') WHEN 4 THEN concat('<i data-src="https://a.b/', n, ',x.avif">') WHEN 5 THEN concat('<video poster="https://a.b/(', n, ').png">') WHEN 6 THEN concat('{logo: "https://a.b/', n, '),.svg"}')
 WHEN 7 THEN concat('["https://a.b/(', n, '.bmp" ]') WHEN 8 THEN concat('fetch("https://static.a.io/', n, '")') WHEN 9 THEN concat('srcSet={`https://a.b/', n, '.png 2x`}') WHEN 10 THEN concat('https://placehold.co/', n, ' 1.5x')
 WHEN 11 THEN concat('<a href="https://a.b/', n, '.png">') ELSE concat('<img src="https://a.b/', n, '.txt">') END"""


@register(
    "image_url_forms",
    "SELECT '/p/' || page_id AS path, CASE page_id % 13 WHEN 3 THEN 'https://picsum.photos/' || n WHEN 8 THEN 'https://static.a.io/' || n WHEN 10 THEN 'https://placehold.co/' || n ELSE 'https://a.b/' || ['', '', '', '', '', '(', '', '(', '', ''][page_id % 13 + 1] || n || ['.JPG', '.webp', '.tif', '', ',x.avif', ').png', '),.svg', '.bmp', '', '.png'][page_id % 13 + 1] END AS url FROM (SELECT page_id, page_id % 40 AS n FROM pages) WHERE page_id % 13 < 11",
)
def image_url_forms(spark, d):
    """Addresses in all the forms in which code names images."""
    f = table(spark, d, "pages").withColumn("n", (F.col("page_id") % 40).cast("string")).select(F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("path"), F.expr(NAMED).alias("content"))
    return R.image_urls(f).select("path", "url")


@register("export_files", f"SELECT ltrim(path, '/') AS path FROM {SQL_FILES} WHERE NOT contains(path, 'public/images/') AND NOT starts_with(content, '[Binary')")
def export_files(spark, d):
    """Files of an archive."""
    return S.exported(files(spark, d)).select("path")


@register("snapshot_files", f"SELECT count(*) AS files, sum(octet_length(encode(content))) AS bytes FROM {SQL_FILES} WHERE length(content) > 0 AND length(content) < 100000")
def snapshot_files(spark, d):
    """Files of a checkpoint."""
    return S.snapshot(files(spark, d)).agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))


@register("url_restore", "SELECT event_id, 'a http://b/long x http://b/s' AS text FROM events")
def url_restore(spark, d):
    """Local paths back to addresses, the longest first."""
    return table(spark, d, "events").select("event_id", R.restored(F.lit("a /i/ab.png x /i/a"), {"/i/a": "http://b/s", "/i/ab.png": "http://b/long"}).alias("text"))


@register("section_match", "SELECT n_nationkey, n_name AS name, n_nationkey * 10.0 AS y FROM nation")
def section_match(spark, d):
    """Sections found by name, lower case, or with underscores."""
    n = table(spark, d, "nation")
    layout = n.select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.lower("n_name")).otherwise(F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))).alias("name"), (F.col("n_nationkey") * 10.0).alias("y")).dropDuplicates(["name"])
    return P.matched(n.select("n_nationkey", F.col("n_name").alias("name"), F.lit(None).cast("double").alias("y")), layout)


@register("import_lines", "SELECT 's' || s_suppkey % 50 AS namespace, 'A' || s_suppkey || 'Section' AS component, 'import A' || s_suppkey || 'Section from ''./sections/s' || s_suppkey % 50 || '/A' || s_suppkey || 'Section.jsx'';' AS line FROM supplier")
def import_lines(spark, d):
    """Imports of section components."""
    p = F.concat(F.lit("/src/sections/s"), (F.col("s_suppkey") % 50).cast("string"), F.lit("/A"), F.col("s_suppkey").cast("string"), F.lit("Section.jsx"))
    return P.imports(table(spark, d, "supplier").select(p.alias("path"), F.lit("x").alias("content")))
