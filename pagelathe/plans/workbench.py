"""Queries of component types, media, text location, fixes, JSON search and stores; their SQL names no constant of the library."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.functions import html as H
from pagelathe.operators import files as O
from pagelathe.operators import jsonpath, jsonq, logs
from pagelathe.operators import stores as S
from pagelathe.operators import tree as T
from pagelathe.plans.catalog import register
from pagelathe.plans.columns import made
from pagelathe.plans.files import SQL_FILES, SQL_LINES, files
from pagelathe.plans.logs import SQL_LOG, log
from pagelathe.sources.tables import table

TAG = "CASE p_size % 7 WHEN 0 THEN 'NAV' WHEN 1 THEN 'h2' WHEN 2 THEN 'a' ELSE 'div' END"
CLASSES = "CASE p_partkey % 6 WHEN 0 THEN 'x Hero' WHEN 1 THEN 'p-4 sub-menu' WHEN 2 THEN 'myCard' WHEN 3 THEN 'flex btn' ELSE 'w-1' END"
ID = "CASE p_partkey % 5 WHEN 0 THEN 'mainHeader' WHEN 1 THEN 'app-nav_1' ELSE '' END"
DISPLAY = "CASE p_size % 3 WHEN 0 THEN 'grid' WHEN 1 THEN 'inline-flex' ELSE 'block' END"


@register(
    "component_types",
    f"SELECT p_partkey, CASE WHEN tag = 'NAV' THEN 'navigation' WHEN tag = 'h2' THEN 'text' WHEN tag = 'a' AND d = 'inline-flex' THEN 'button' WHEN c = 'x Hero' THEN 'hero' WHEN c = 'p-4 sub-menu' THEN 'navigation' WHEN c = 'myCard' THEN 'card' WHEN c = 'flex btn' THEN 'button' "
    "WHEN i = 'mainHeader' THEN 'header' WHEN i = 'app-nav_1' THEN 'navigation' WHEN d = 'grid' THEN 'grid' WHEN d = 'inline-flex' THEN 'flex' WHEN tag = 'div' AND p_size % 2 > 0 THEN 'container' ELSE 'other' END AS type, "
    "CASE c WHEN 'flex btn' THEN 'button' WHEN 'myCard' THEN 'card' WHEN 'p-4 sub-menu' THEN 'dropdown' ELSE CASE tag WHEN 'a' THEN 'link' ELSE 'container' END END AS chunk, "
    "CASE i WHEN 'mainHeader' THEN 'Main Header' WHEN 'app-nav_1' THEN 'App Nav 1' ELSE CASE c WHEN 'x Hero' THEN 'X' WHEN 'p-4 sub-menu' THEN 'Sub Menu' WHEN 'myCard' THEN 'My Card' WHEN 'flex btn' THEN 'Btn' ELSE 'none' END END AS name "
    f"FROM (SELECT p_partkey, p_size, {TAG} AS tag, {CLASSES} AS c, {ID} AS i, {DISPLAY} AS d FROM part)",
)
def component_types(spark, d):
    """Types and names of components."""
    p = made(spark, d, "part", tag=TAG, c=CLASSES, i=ID, shown=DISPLAY)
    words = F.split("c", " ")
    return p.select("p_partkey", H.component_type(F.col("tag"), F.col("i"), words, F.col("shown"), F.col("p_size") % 2).alias("type"), H.chunk_type(F.col("tag"), words).alias("chunk"), H.component_name(F.col("i"), words, F.lit("none")).alias("name"))


@register(
    "layout_boxes",
    "SELECT p_partkey, '+' || repeat('-', 60) || '+' || chr(10) || '|' || repeat(' ', 20) || 'PAGE LAYOUT' || repeat(' ', 29) || '|' || chr(10) || '+' || repeat('-', 60) || '+' || "
    "array_to_string(list_transform(range(least(p_size, 10)), lambda i: chr(10) || '|' || repeat(' ', CAST((58 - length('section_' || (i + p_partkey))) // 2 AS BIGINT)) || rpad('SECTION_' || (i + p_partkey), CAST(58 - (58 - length('section_' || (i + p_partkey))) // 2 AS INT), ' ') || '|' || chr(10) || '+' || repeat('-', 60) || '+'), '') AS box FROM part",
)
def layout_boxes(spark, d):
    """Rows of a page as boxes."""
    types = F.transform(F.sequence(F.lit(1), F.col("p_size").cast("int")), lambda i: F.concat(F.lit("section_"), (i - 1 + F.col("p_partkey")).cast("string")))
    return table(spark, d, "part").select("p_partkey", H.layout_box(types).alias("box"))


MEDIA = (
    "concat(CASE WHEN n_nationkey % 4 < 3 THEN '<div class=\"m\">' ELSE '' END, CASE WHEN n_nationkey % 3 = 1 THEN '<VIDEO poster=\"/a.png\"></VIDEO><video src=1 poster=\"/b.png\">' WHEN n_nationkey % 3 = 2 THEN '<iframe src=\"https://youtube.com/embed/Ab_9-z\">' ELSE '<p>' END, "
    "'<script a=1>x</script>', repeat('0123456789', CAST(CASE WHEN n_nationkey % 5 = 0 THEN 10 ELSE 5000 END AS INT)))"
)


def sql_stand_in(comment: str, kind: str, src: str, alt: str) -> str:
    return (
        f"'\n  <!-- {comment} -->\n  <div class=\"{kind}-placeholder\" style=\"position:relative;width:100%;max-width:640px;aspect-ratio:16/9;background:#000;\">\n    <img src=\"{src}\" alt=\"{alt}\" style=\"width:100%;height:100%;object-fit:cover;\" />\n"
        "    <div style=\"position:absolute;top:50%;left:50%;transform:translate(-50%,-50%);font-size:48px;color:#fff;\">▶</div>\n  </div>'"
    )


SQL_VIDEOS = f"{sql_stand_in('Video placeholder 1', 'video', '/a.png', 'Video poster')} || chr(10) || {sql_stand_in('Video placeholder 2', 'video', '/b.png', 'Video poster')}"
SQL_TUBE = sql_stand_in("YouTube video placeholder", "youtube", "https://img.youtube.com/vi/Ab_9-z/maxresdefault.jpg", "YouTube video thumbnail")


@register(
    "media_clean",
    f"SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN h WHEN n_nationkey % 3 = 0 THEN replace(h, '<script a=1>x</script>', '') ELSE CASE WHEN n_nationkey % 4 < 3 THEN '<div class=\"m\">' || chr(10) ELSE '' END || CASE n_nationkey % 3 WHEN 1 THEN {SQL_VIDEOS} ELSE {SQL_TUBE} END || CASE WHEN n_nationkey % 4 < 3 THEN chr(10) || '</div>' ELSE '' END END AS html FROM (SELECT n_nationkey, {MEDIA} AS h FROM nation)",
)
def media_clean(spark, d):
    """Long pages with players."""
    return made(spark, d, "nation", h=MEDIA).select("n_nationkey", H.clean_media(F.col("h")).alias("html"))


SIMILAR = "Their license, the data AND there"


def sql_similar(words: list[str]) -> str:
    hits = " + ".join(f"CAST(contains(lower(line), '{w}') AS INT)" for w in words)
    return f"(SELECT path, line_no, line, ({hits}) / {len(words)}.0 AS score, row_number() OVER (PARTITION BY path ORDER BY ({hits}) DESC, line_no) AS place FROM {SQL_LINES} WHERE ({hits}) > 0 QUALIFY place <= 10)"


@register("similar_lines", f"SELECT path, line_no, CAST(score AS DOUBLE) AS score, place FROM {sql_similar(['their', 'license', 'data', 'there'])}")
def similar_lines(spark, d):
    """The lines of each file that are most like a text."""
    return O.similar_lines(files(spark, d), SIMILAR).select("path", "line_no", "score", "place")


MADE_TEXT = "concat(CASE p_partkey % 4 WHEN 0 THEN 'a\nlet x = 1;\nb' WHEN 1 THEN 'q\n\tlet  x  =\t1; \nz' WHEN 2 THEN concat('nothing\nhas value', p_size, ' here\nvalue') ELSE 'none' END)"


@register(
    "located_text",
    f"SELECT path, tier, line_no, score FROM (SELECT 'p' || p_partkey AS path, CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'spacing' END AS tier, 2 AS line_no, 1.0::DOUBLE AS score FROM part WHERE p_partkey % 4 < 2)",
)
def located_text(spark, d):
    """Where a text stands: exactly, or blanks aside."""
    rows = made(spark, d, "part", content=MADE_TEXT).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), "content")
    return O.located(rows, "let x = 1;")


@register(
    "located_similar",
    "SELECT 'p' || p_partkey AS path, 'similar' AS tier, unnest([2, 3]) AS line_no, unnest([1.0, 0.5])::DOUBLE AS score FROM part WHERE p_partkey % 4 = 2",
)
def located_similar(spark, d):
    """The similar lines where a text stands nowhere."""
    rows = made(spark, d, "part", content=MADE_TEXT).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), "content")
    return O.located(rows, "here is the value")


@register(
    "line_edits",
    f"SELECT path, array_to_string(list_concat(list_concat(l[1:1], ['new', 'lines']), l[4:]), chr(10)) AS content FROM (SELECT path, string_split(content, chr(10)) AS l FROM {SQL_FILES})",
)
def line_edits(spark, d):
    """Lines 2 to 3 of each file replaced."""
    return files(spark, d).select("path", O.replaced_lines(F.col("content"), 2, 3, "new\nlines").alias("content"))


FAULT = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('/src/m', event_id % 5, '/App.jsx') END"
WRONG = "CASE event_id % 4 WHEN 0 THEN 'Cannot find module \"./Box\"' WHEN 1 THEN 'Cannot find module \"axios\"' WHEN 2 THEN 'Cannot find module' ELSE 'x' END"
KIND = "CASE event_id % 7 WHEN 0 THEN 'MISSING_CSS' WHEN 1 THEN 'SYNTAX_ERROR' WHEN 2 THEN 'NPM_ERROR' WHEN 3 THEN 'VITE_PLUGIN_ERROR' WHEN 4 THEN 'TYPE_ERROR' ELSE 'MISSING_IMPORT' END"


@register(
    "fix_commands",
    "SELECT event_id, CASE k WHEN 'MISSING_CSS' THEN '# Create the missing CSS file\nwrite_file(path=\"' || f || '\", content=\"\"\"\n/* Auto-generated CSS file */\n\"\"\")' "
    "WHEN 'SYNTAX_ERROR' THEN '# First, read the file to see the error\nread_file(path=\"' || f || '\")\n\n# Then fix with edit_file()\n# edit_file(path=\"' || f || '\", old_text=\"problematic code\", new_text=\"fixed code\")' "
    "WHEN 'NPM_ERROR' THEN '# Fix NPM errors\nshell(\"rm -rf node_modules\")\ninstall_dependencies()' "
    "WHEN 'VITE_PLUGIN_ERROR' THEN '# Get more details about the build error\nget_all_terminals_output()\ndiagnose_preview_state()\n\n# Then fix the specific file mentioned in the error\n# read_file(path=\"' || g || '\")\n# edit_file(path=\"' || g || '\", old_text=\"...\", new_text=\"...\")' "
    "WHEN 'MISSING_IMPORT' THEN CASE event_id % 4 WHEN 1 THEN '# Install the missing package\ninstall_dependencies(packages=[\"axios\"])' WHEN 0 THEN '# Option 1: Create the missing file\nwrite_file(path=\"' || coalesce(replace(f, 'App.jsx', 'Box.jsx'), 'src/Box.jsx') || '\", content=\"\"\"\nexport default function Component() {\n  return <div>Component</div>;\n}\n\"\"\")\n\n# Option 2: Remove the import (if not needed)\n# edit_file(path=\"' || g || '\", old_text=\"import ... from ''./Box'';\", new_text=\"\")' END END AS fix "
    f"FROM (SELECT event_id, {KIND} AS k, {FAULT} AS f, coalesce({FAULT}, 'src/App.jsx') AS g FROM events)",
)
def fix_commands(spark, d):
    """Commands that mend errors."""
    e = made(spark, d, "events", k=KIND, f=FAULT, m=WRONG)
    return e.select("event_id", logs.fix_command(F.col("k"), F.col("f"), F.col("m")).alias("fix"))


NESTED = "concat('{\"a\": {\"Kind\": ', props, '}, \"b\": [\"', event_type, '\", ', props, '], \"kind\": \"', event_type, '\"}')"


@register(
    "json_found",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, unnest([1, 2]) AS place, unnest(['$.a.Kind', '$.kind']) AS path, unnest([CAST(json(props) AS VARCHAR), event_type]) AS value, 2 AS n_matches FROM events",
)
def json_found(spark, d):
    """P5: keys and texts that hold a word."""
    return jsonpath.found(made(spark, d, "events", doc=NESTED), "event_id", "doc", "KIND")


@register("json_dispatch", "SELECT CAST(event_id AS VARCHAR) AS event_id, 1 AS place, '$.b[0]' AS path, event_type AS value, 1 AS n_matches FROM events")
def json_dispatch(spark, d):
    """A query that is a path."""
    return jsonq.dispatch(made(spark, d, "events", doc=NESTED), "event_id", "doc", "$.b[0]")


#: A document with lists of objects, other items among them, built from an event.
SHELF = (
    "concat('{\"items\": [{\"n\": ', event_id % 7, ', \"tag\": \"', event_type, '\", \"deep\": {\"n\": ', user_id % 5, '}}, ', event_id % 3, ', {\"n\": \"', event_id % 4, '\"}, {\"n\": ', user_id % 9, '.5, \"tag\": \"view\"}, null], \"n\": true, \"list\": [', event_id % 10, ', [', user_id % 10, ', {\"n\": null}], \"x\"]}')"
)
SQL_SHELF = f"(SELECT CAST(event_id AS VARCHAR) AS event_id, CAST({SHELF} AS JSON) AS doc FROM events)"
#: Nodes of the documents with their parents' kinds, in document order (id), by DuckDB's own walk.
SQL_TREE = f"(SELECT s.event_id, t.* FROM {SQL_SHELF} s, json_tree(s.doc) t)"


def sql_ranked(rows: str) -> str:
    """Matches (event_id, ord, path, value) with places and numbers."""
    return f"SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY ord) AS place, path, value, count(*) OVER (PARTITION BY event_id) AS n_matches FROM ({rows})"


def shelf(spark, d):
    return made(spark, d, "events", doc=SHELF)


@register("json_deep", sql_ranked(f"SELECT event_id, lpad(CAST(len(string_split(replace(fullkey, '[', '.['), '.')) AS VARCHAR), 3, '0') || fullkey AS ord, fullkey AS path, CASE WHEN type = 'VARCHAR' THEN atom->>'$' ELSE CAST(value AS VARCHAR) END AS value FROM {SQL_TREE} WHERE key = 'n'"))
def json_deep(spark, d):
    """Recursive descent, all matches of a name. Names sort before lists here, so the oracle's order is by depth, then path."""
    out = jsonpath.select(shelf(spark, d), "event_id", "doc", "$..n")
    depth = F.size(F.split(F.replace("path", F.lit("["), F.lit(".[")), r"\."))
    w = Window.partitionBy("event_id").orderBy(depth, "path")
    return out.withColumn("place", F.row_number().over(w))


@register("json_filtered", sql_ranked(f"SELECT event_id, i AS ord, '$.items[' || i || '].n' AS path, CAST(x->'$.n' AS VARCHAR) AS value FROM (SELECT event_id, unnest(range(5)) AS i, unnest(json_extract(doc, '$.items[*]')) AS x FROM {SQL_SHELF}) WHERE json_type(x->'$.n') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(x->'$.n' AS DOUBLE) > 2 AND (x->>'$.tag' = 'view' OR json_type(x->'$.deep') IS NOT NULL)"))
def json_filtered(spark, d):
    """A filter with numbers, texts and existence; "3" as a text isn't a number."""
    return jsonpath.select(shelf(spark, d), "event_id", "doc", "$.items[?(@.n > 2 && (@.tag == 'view' || @.deep))].n")


@register("json_sliced", sql_ranked(f"SELECT event_id, o AS ord, CASE o WHEN 0 THEN '$.list[2]' WHEN 1 THEN '$.list[0]' ELSE '$.list[1]' END AS path, CASE o WHEN 0 THEN doc->>'$.list[2]' WHEN 1 THEN CAST(doc->'$.list[0]' AS VARCHAR) ELSE CAST(doc->'$.list[1]' AS VARCHAR) END AS value FROM (SELECT event_id, doc, unnest([0, 1, 2]) AS o FROM {SQL_SHELF})"))
def json_sliced(spark, d):
    """A negative index and a slice in one union, in its order."""
    return jsonpath.select(shelf(spark, d), "event_id", "doc", "$.list[-1, 0:2]")


@register("json_united", sql_ranked(f"SELECT event_id, o AS ord, CASE o WHEN 0 THEN '$.n' WHEN 1 THEN '$.items[3].n' ELSE '$.items[0].n' END AS path, CASE o WHEN 0 THEN 'true' WHEN 1 THEN CAST(doc->'$.items[3].n' AS VARCHAR) ELSE CAST(doc->'$.items[0].n' AS VARCHAR) END AS value FROM (SELECT event_id, doc, unnest([0, 1, 2]) AS o FROM {SQL_SHELF})"))
def json_united(spark, d):
    """A union of names, and a slice that goes back, each a path of its own."""
    one = jsonpath.select(shelf(spark, d), "event_id", "doc", "$['missing', 'n']")
    two = jsonpath.select(shelf(spark, d), "event_id", "doc", "$.items[-2::-3]['n']")
    return one.select("event_id", "place", "path", "value").unionByName(two.select("event_id", (F.col("place") + 1).alias("place"), "path", "value")).withColumn("n_matches", F.lit(3).cast("long"))


@register("json_described", "SELECT CAST(event_id AS VARCHAR) AS event_id, '- **a**: dict[1 keys]' || chr(10) || '- **b**: list[2 items]' || chr(10) || '- **kind**: \"' || event_type || '\"' AS lines FROM events")
def json_described(spark, d):
    """The keys of sources, for an agent."""
    return jsonq.described(made(spark, d, "events", doc=NESTED), "event_id", "doc")


@register("error_fixes", f"SELECT event_id, CASE WHEN message LIKE '%npm ERR!%' THEN 'npm' ELSE 'other' END AS kind FROM {SQL_LOG} WHERE message LIKE '%npm ERR!%'")
def error_fixes(spark, d):
    """Of all errors, those that a new installation mends."""
    m = F.col("message")
    fix = logs.fix_command(logs.first_match(m, logs.CATALOGUE, 1), F.lit(None).cast("string"), m)
    return log(spark, d).where(fix.contains("rm -rf node_modules")).select("event_id", F.lit("npm").alias("kind"))


SHOWCASE = "o_orderstatus = 'F'"


def projects(spark, d):
    """Orders as projects."""
    return table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS name", f"{SHOWCASE} AS is_showcase", "o_orderdate AS updated_at")


@register("store_projects", f"SELECT o_orderkey AS id, o_orderdate AS updated_at FROM orders WHERE {SHOWCASE}")
def store_projects(spark, d):
    """Projects that aren't temporary."""
    return S.projects(projects(spark, d), include_temp=False).select("id", "updated_at")


@register("store_deleted", f"SELECT o_orderkey AS id FROM orders WHERE {SHOWCASE} OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) IS NOT TRUE")
def store_deleted(spark, d):
    """Projects of some customers deleted, showcases aside."""
    gone = table(spark, d, "orders").join(table(spark, d, "customer").where("c_nationkey < 5"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("id"))
    return S.deleted(projects(spark, d), gone, force=False).select("id")


@register("store_created", f"SELECT o_orderkey AS id, CASE WHEN {SHOWCASE} THEN 'new' ELSE 'old' END AS v FROM orders UNION ALL SELECT -1 - s_suppkey, 'new' FROM supplier")
def store_created(spark, d):
    """Sources created, or put in the place of those of their id."""
    p = projects(spark, d)
    new = p.where("is_showcase").select("id").unionByName(table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("id"))).withColumn("v", F.lit("new"))
    return S.created(p.select("id", F.lit("old").alias("v")), new)


@register("store_updated", f"SELECT o_orderkey AS id, CASE WHEN {SHOWCASE} THEN 'renamed' ELSE 'kept' END AS name, CASE WHEN {SHOWCASE} THEN DATE '2030-01-01' ELSE CAST(o_orderdate AS DATE) END AS updated_at FROM orders")
def store_updated(spark, d):
    """Showcases renamed."""
    p = projects(spark, d).select("id", F.lit("kept").alias("name"), F.col("updated_at").cast("date").alias("updated_at"))
    changes = projects(spark, d).where("is_showcase").select("id", F.lit("renamed").alias("name"))
    return S.updated(p, changes, F.expr("DATE '2030-01-01'"))


@register("store_checkpoint_summaries", "SELECT o_custkey, count(*) AS checkpoints, max_by('cp_' || o_orderkey, (o_orderdate, 'cp_' || o_orderkey)) AS current, max(o_orderdate) AS saved FROM orders GROUP BY o_custkey")
def store_checkpoint_summaries(spark, d):
    """Checkpoints of each project, and the current one."""
    c = table(spark, d, "orders").select("o_custkey", F.concat(F.lit("cp_"), F.col("o_orderkey").cast("string")).alias("checkpoint_id"), F.col("o_orderdate").alias("ts"))
    return S.checkpoint_summaries(c, "o_custkey")


#: A root, the second line, which holds the third and fourth, and the others below the root.
SQL_TREE = (
    "SELECT page_id, k AS node_id, CASE WHEN k > 1 THEN CASE WHEN k IN (3, 4) THEN 2 ELSE 1 END END AS parent_id, CASE k WHEN 1 THEN top WHEN 2 THEN greatest(2, least(top, 4)) ELSE k END AS subtree_end, CASE WHEN k > 1 AND q > 45 THEN 'BR' ELSE 'div' END AS tag, CASE WHEN k = 1 THEN 99 ELSE q END AS width, 10 AS height "
    "FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line) AS k, count(*) OVER (PARTITION BY page_id) AS top FROM (SELECT l_orderkey AS page_id, l_linenumber AS line, min(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber))"
)


@register(
    "component_tree",
    "WITH t AS (SELECT * FROM (" + SQL_TREE + ")), ok AS (SELECT * FROM t WHERE tag = 'div' AND width >= 10), kept AS (SELECT ok.* FROM ok LEFT JOIN ok p ON ok.page_id = p.page_id AND ok.parent_id = p.node_id WHERE ok.parent_id IS NULL OR p.node_id IS NOT NULL), "
    "one AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY node_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY CASE node_id WHEN 1 THEN 100 WHEN 2 THEN 4.5 ELSE node_id END) AS emitted FROM kept) "
    "SELECT a.page_id, a.node_id, printf('comp_%04d', a.n) AS id, CASE WHEN p.n IS NOT NULL THEN printf('comp_%04d', p.n) END AS parent_id, a.emitted, (SELECT count(*) FROM one c WHERE c.page_id = a.page_id AND c.parent_id = a.node_id) AS n_children, a.tag FROM one a LEFT JOIN one p ON a.page_id = p.page_id AND a.parent_id = p.node_id",
)
def component_tree(spark, d):
    """Lines of orders as trees of components."""
    w = Window.partitionBy("page_id")
    one = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), "l_linenumber").agg(F.min("l_quantity").alias("q"))
    k = F.col("k")
    t = one.withColumns({"k": F.row_number().over(w.orderBy("l_linenumber")), "top": F.count("*").over(w)}).select(
        "page_id",
        k.alias("node_id"),
        F.when(k.isin(3, 4), 2).when(k > 1, 1).alias("parent_id"),
        F.when(k == 1, F.col("top")).when(k == 2, F.greatest(F.lit(2), F.least("top", F.lit(4)))).otherwise(k).alias("subtree_end"),
        F.when((k > 1) & (F.col("q") > 45), "BR").otherwise("div").alias("tag"),
        F.when(k == 1, 99).otherwise(F.col("q")).alias("width"),
        F.lit(10).alias("height"),
    )
    return T.component_tree(t)


@register("file_recommendations", f"SELECT hint, path, place FROM (SELECT *, row_number() OVER (PARTITION BY hint ORDER BY path) AS place FROM (SELECT 'License' AS hint, path FROM {SQL_FILES} WHERE contains(lower(content), 'license') UNION ALL SELECT 'the', path FROM {SQL_FILES} WHERE contains(lower(content), 'the'))) WHERE place <= 5")
def file_recommendations(spark, d):
    """C14: files that hold a hint, the first five of each."""
    return O.recommended(files(spark, d), ["License", "the"])


@register(
    "event_answers",
    "SELECT event_id, CASE WHEN told - ts <= INTERVAL 1 HOUR THEN 'resolved' ELSE 'timeout' END AS status, CASE WHEN told - ts <= INTERVAL 1 HOUR THEN response END AS response FROM (SELECT a.event_id, a.ts, b.ts AS told, b.response FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS response FROM events WHERE event_type = 'view' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts <= b.ts)",
)
def event_answers(spark, d):
    """Clicks and the first view that follows within an hour."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("response_id"))
    return logs.answered(e.where("event_type = 'click'"), views, ["user_id"], "ts", "response_id", 3600).select("event_id", "status", "response")


@register(
    "event_concurrency",
    "SELECT user_id, count(*) FILTER (step = 1) AS runs, max(n) AS peak, max(n) <= 2 AS within FROM (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY at_us, step ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT user_id, epoch_us(ts) AS at_us, 1 AS step FROM events UNION ALL SELECT user_id, epoch_us(ts) + event_id % 5 * 86400000000 + 1, -1 FROM events)) GROUP BY user_id",
)
def event_concurrency(spark, d):
    """Events as runs of up to four days, and how many of a user's run at once."""
    at = logs.micros("ts")
    e = table(spark, d, "events").select("user_id", at.alias("a"), (at + F.col("event_id") % 5 * 86_400_000_000 + 1).alias("b"))
    return logs.concurrency(e, ["user_id"], "a", "b", 2)
