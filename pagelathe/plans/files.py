"""Queries over the documents table, as files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.functions import html as H
from pagelathe.functions import text as X
from pagelathe.operators import files as O
from pagelathe.plans.catalog import register
from pagelathe.sources.tables import table

SQL_FILES = "(SELECT doc_id, '/' || source || '/' || doc_id || '.txt' AS path, text AS content FROM documents)"
SQL_LINES = f"(SELECT path, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT path, string_split(content, chr(10)) AS l FROM {SQL_FILES}))"


def files(spark, d):
    """Documents as files /source/doc_id.txt."""
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))


@register("doc_grep", f"SELECT path, line_no, left(line, 200) AS line, n_matches FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS k, count(*) OVER (PARTITION BY path) AS n_matches FROM {SQL_LINES} WHERE regexp_matches(line, '(?i)licen[sc]e|the th') AND path IN (SELECT path FROM {SQL_FILES} WHERE length(content) <= 500000)) WHERE k <= 5")
def doc_grep(spark, d):
    """Search in files."""
    return O.grep(files(spark, d), "licen[sc]e|the th")


@register("doc_grep_context", f"SELECT path, line_no, hit = 1 AS hit, sum(fresh) OVER (PARTITION BY path ORDER BY line_no) AS block FROM (SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY path ORDER BY line_no) = 1 THEN 0 ELSE 1 END AS fresh FROM (SELECT *, max(hit) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM (SELECT *, CASE WHEN regexp_matches(line, '(?i)licen[sc]e') THEN 1 ELSE 0 END AS hit FROM {SQL_LINES})) WHERE near = 1)")
def doc_grep_context(spark, d):
    """Matches with the lines around them."""
    return O.context(files(spark, d), "licen[sc]e")


@register("doc_line_stats", "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, length(text) // 4 AS est_tokens, CASE WHEN length(text) // 4 >= 1000 THEN '~' || CAST(round(length(text) // 4 / 1000) AS BIGINT) || 'K' ELSE '~' || length(text) // 4 END AS label FROM documents")
def doc_line_stats(spark, d):
    """Lines and tokens."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", (F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"), H.est_tokens(t).alias("est_tokens"), X.token_label(H.est_tokens(t)).alias("label"))


@register("doc_char_line", "SELECT doc_id, doc_id % 500 AS pos, CASE WHEN doc_id % 500 <= 0 THEN 0 ELSE length(left(text, doc_id % 500)) - length(replace(left(text, doc_id % 500), chr(10), '')) + 1 END AS line_no FROM documents")
def doc_char_line(spark, d):
    """The line of a character offset."""
    pos = (F.col("doc_id") % 500).cast("int")
    return table(spark, d, "documents").select("doc_id", pos.cast("long").alias("pos"), H.line_of(F.col("text"), pos).alias("line_no"))


@register("doc_dupes", "SELECT doc_id, min(doc_id) OVER (PARTITION BY left(text, 500)) AS first_id, count(*) OVER (PARTITION BY left(text, 500)) AS copies FROM documents")
def doc_dupes(spark, d):
    """Documents whose first 500 characters are the same."""
    t = table(spark, d, "documents").select("doc_id", F.left("text", F.lit(500)).alias("head"))
    return t.join(t.groupBy("head").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "head").select("doc_id", "first_id", "copies")


@register("file_tree", f"SELECT node, depth, bool_or(depth = n) AS is_file, count(*) AS files, regexp_extract(node, '^(.*)/[^/]*$', 1) AS parent FROM (SELECT unnest(['' || p[1], p[1] || '/' || p[2]]) AS node, unnest([1, 2]) AS depth, len(p) AS n FROM (SELECT string_split(ltrim(path, '/'), '/') AS p FROM {SQL_FILES})) GROUP BY node, depth")
def file_tree(spark, d):
    """Folders and files."""
    return O.tree(files(spark, d))


@register("file_filters", f"SELECT path, regexp_matches(path, '^/src1.*7\\.txt$') AS globbed, starts_with(path, '/src') AND NOT ends_with(path, '3.txt') AND NOT regexp_matches(lower(path), '\\.env|secret|password') AS ok FROM {SQL_FILES}")
def file_filters(spark, d):
    """Globs and allowed paths."""
    p = F.col("path")
    return files(spark, d).select("path", p.rlike(X.glob_regex("/src1*7.txt")).alias("globbed"), O.allowed(p, "/src", (".txt",), ("3.txt",)).alias("ok"))


@register("file_lines", f"SELECT path, array_to_string(l[2:4], chr(10)) AS part, left(array_to_string(list_transform(l, lambda x, i: printf('%4d %s', i, x)), chr(10)), 300) AS numbered FROM (SELECT path, string_split(content, chr(10)) AS l FROM {SQL_FILES})")
def file_lines(spark, d):
    """Parts of files, with numbers."""
    c = F.col("content")
    return files(spark, d).select("path", O.read_lines(c, 2, 4).alias("part"), F.left(O.numbered(c), F.lit(300)).alias("numbered"))


@register("file_edits", f"SELECT path, CASE WHEN n = 1 THEN md5(replace(content, 'the th', 'THE TH')) END AS once, CASE WHEN n > 0 THEN md5(replace(content, 'the th', 'THE TH')) END AS every FROM (SELECT *, len(string_split(content, 'the th')) - 1 AS n FROM {SQL_FILES})")
def file_edits(spark, d):
    """Edits that must be unique, or not."""
    c = F.col("content")
    md5 = lambda x: F.md5(x.cast("binary"))
    return files(spark, d).select("path", md5(O.replaced(c, "the th", "THE TH")).alias("once"), md5(O.replaced(c, "the th", "THE TH", True)).alias("every"))


@register("file_budget", f"SELECT g AS \"group\", path, priority, tokens, n FROM (SELECT *, sum(tokens) OVER w AS s, row_number() OVER w AS n FROM (SELECT doc_id % 9 AS g, path, doc_id % 17 AS priority, CASE WHEN length(content) // 4 > 8192 THEN length(content) // 8 ELSE length(content) // 4 END AS tokens FROM {SQL_FILES}) WINDOW w AS (PARTITION BY g ORDER BY priority DESC, path ROWS UNBOUNDED PRECEDING)) WHERE s <= 32768 AND n <= 20")
def file_budget(spark, d):
    """Files that fit a budget."""
    f = files(spark, d).select((F.col("doc_id") % 9).alias("group"), "path", (F.col("doc_id") % 17).alias("priority"), H.est_tokens(F.col("content")).alias("tokens"))
    return O.pack(f)


@register("file_sizes", f"SELECT path, octet_length(encode(content)) AS bytes, regexp_extract(path, '([^/]*)$', 1) AS name, CAST(coalesce(nullif(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(\\d+)', 1), ''), '0') AS BIGINT) AS natural_key FROM {SQL_FILES}")
def file_sizes(spark, d):
    """Bytes, names, and natural order."""
    name = X.file_name(F.col("path"))
    return files(spark, d).select("path", F.octet_length("content").alias("bytes"), name.alias("name"), F.coalesce(F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")), F.lit("0")).cast("long").alias("natural_key"))


@register("file_hints", f"SELECT path, contains(lower(content), 'license') AS hinted, regexp_replace(trim(regexp_replace(left(content, 200), '\\s+', ' ', 'g'), ' '), '^ | $', '', 'g') AS head FROM {SQL_FILES}")
def file_hints(spark, d):
    """Files that hold a hint, and their head with blanks squeezed."""
    return files(spark, d).select("path", F.lower("content").contains("license").alias("hinted"), X.squeeze(F.left("content", F.lit(200))).alias("head"))


@register("source_bytes", "SELECT source, lang, sum(n_chars) AS chars, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def source_bytes(spark, d):
    """Totals by kind, and of all."""
    return table(spark, d, "documents").rollup("source", "lang").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n"))


@register("file_diffs")
def file_diffs(spark, d):
    """Line diffs of files that share a head."""
    f = files(spark, d).withColumn("head", F.left("content", F.lit(40)))
    w = Window.partitionBy("head").orderBy("doc_id")
    pairs = f.withColumns({"old": F.lag("content").over(w), "new": F.col("content")}).where("old IS NOT NULL AND old <> new")
    return O.diffs(pairs)


@register("file_diff_stats")
def file_diff_stats(spark, d):
    """What changed."""
    return O.diff_stats(file_diffs(spark, d))


NAMES = "(SELECT n_nationkey, lower(replace(n_name, ' ', '-')) || '_Box' AS s FROM nation)"


@register("name_formats", f"SELECT n_nationkey, lower(replace(regexp_replace(s, '([a-z])([A-Z])', '\\1-\\2', 'g'), '-', '_')) AS snake, left(regexp_replace(regexp_replace(regexp_replace(s, '[<>:\"/\\\\|?*\\s]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 30) AS slug FROM {NAMES}")
def name_formats(spark, d):
    """Names as snake case and file names."""
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit("_Box")).alias("s"))
    return n.select("n_nationkey", H.snake(F.col("s")).alias("snake"), X.slug(F.col("s")).alias("slug"))


@register("color_hex", "SELECT p_partkey, '#' || upper(printf('%02x%02x%02x', p_partkey % 256, p_size, CAST(floor(p_retailprice) AS BIGINT) % 256)) AS color FROM part")
def color_hex(spark, d):
    """Colours as hex."""
    c = F.format_string("rgba(%d, %d, %d, 0.5)", F.col("p_partkey") % 256, F.col("p_size"), F.floor("p_retailprice").cast("long") % 256)
    return table(spark, d, "part").select("p_partkey", H.color_hex(c).alias("color"))


@register("byte_labels", "SELECT o_orderkey, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN regexp_replace(printf('%.1f', round(b / 1024.0, 1)), '\\.0$', '') || ' KB' ELSE regexp_replace(printf('%.1f', round(b / 1048576.0, 1)), '\\.0$', '') || ' MB' END AS label FROM (SELECT o_orderkey, o_orderkey * 37 AS b FROM orders)")
def byte_labels(spark, d):
    """Sizes with units."""
    return table(spark, d, "orders").select("o_orderkey", X.byte_label(F.col("o_orderkey") * 37).alias("label"))


@register("css_maps", "SELECT p_partkey, p_type AS color, CAST(p_size AS VARCHAR) || 'px' AS width FROM part")
def css_maps(spark, d):
    """Style attributes as maps."""
    css = F.concat(F.lit("color: "), "p_type", F.lit("; nothing;width :"), F.col("p_size").cast("string"), F.lit("px;"))
    m = H.declarations(css)
    return table(spark, d, "part").select("p_partkey", m["color"].alias("color"), m["width"].alias("width"))


@register("var_full_outer_diff", "SELECT count(*) FILTER (a IS DISTINCT FROM b) AS changed, count(*) AS total FROM (SELECT s_suppkey AS k, s_nationkey AS a FROM supplier WHERE s_suppkey % 3 <> 0) x FULL JOIN (SELECT s_suppkey AS k, s_nationkey + s_suppkey % 2 AS b FROM supplier WHERE s_suppkey % 5 <> 0) y USING (k)")
def var_full_outer_diff(spark, d):
    """Variables of two themes whose values differ; a missing one differs."""
    s = table(spark, d, "supplier")
    x = s.where("s_suppkey % 3 <> 0").selectExpr("s_suppkey AS k", "s_nationkey AS a")
    y = s.where("s_suppkey % 5 <> 0").selectExpr("s_suppkey AS k", "s_nationkey + s_suppkey % 2 AS b")
    return x.join(y, "k", "full").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.count("*").alias("total"))


@register("key_element_diff", "SELECT sum(CASE WHEN a <> b THEN 1 ELSE 0 END + CASE WHEN c <> e THEN 1 ELSE 0 END) AS diffs FROM (SELECT p_partkey AS k, p_brand AS a, p_size AS c FROM part) JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE p_brand END AS b, p_size + p_partkey % 2 AS e FROM part) USING (k)")
def key_element_diff(spark, d):
    """Elements of two themes that differ."""
    p = table(spark, d, "part")
    x = p.selectExpr("p_partkey AS k", "p_brand AS a", "p_size AS c")
    y = p.selectExpr("p_partkey AS k", "CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE p_brand END AS b", "p_size + p_partkey % 2 AS e")
    return x.join(y, "k").agg(F.sum((F.col("a") != F.col("b")).cast("long") + (F.col("c") != F.col("e")).cast("long")).alias("diffs"))


@register("design_tokens", "SELECT property, value, n, rank, CASE rank WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'accent' END AS token FROM (SELECT *, row_number() OVER (PARTITION BY property ORDER BY n DESC, first) AS rank FROM (SELECT property, value, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, 'brand' AS property, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part) GROUP BY property, value)) WHERE rank <= 20")
def design_tokens(spark, d):
    """The 20 most frequent values of each property, the first three named."""
    p = table(spark, d, "part").selectExpr("p_partkey", "stack(3, 'brand', p_brand, 'size', cast(p_size AS string), 'type', p_type) AS (property, value)")
    g = p.groupBy("property", "value").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    r = g.withColumn("rank", F.row_number().over(Window.partitionBy("property").orderBy(F.desc("n"), "first"))).where("rank <= 20")
    return r.select("property", "value", "n", "rank", F.when(r.rank == 1, "primary").when(r.rank == 2, "secondary").when(r.rank == 3, "accent").alias("token"))
