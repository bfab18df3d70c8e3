"""Queries of column functions and small operators over values made from the tables; their SQL names no constant of the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelathe.functions import html as H
from pagelathe.functions import text as X
from pagelathe.operators import files as O
from pagelathe.operators import jsonpath, jsonq, planning, reports, summary
from pagelathe.plans.catalog import register
from pagelathe.plans.files import SQL_FILES, files
from pagelathe.sources.tables import table


def made(spark, d, name, **columns):
    """The table's columns and those that expressions, the same in both languages, make."""
    return table(spark, d, name).selectExpr("*", *(f"{v} AS {k}" for k, v in columns.items()))


COLOR = "CASE p_size % 3 WHEN 0 THEN 'transparent' WHEN 1 THEN concat('rgba(0, 0, 0, ', p_size % 2, ')') ELSE concat('rgb(', p_size, ', 0, 0)') END"


@register("transparent_colors", f"SELECT p_partkey, c = 'transparent' OR contains(c, 'rgba(0, 0, 0, 0)') AS hidden FROM (SELECT p_partkey, {COLOR} AS c FROM part)")
def transparent_colors(spark, d):
    """colours that show nothing."""
    return made(spark, d, "part", c=COLOR).select("p_partkey", H.is_transparent(F.col("c")).alias("hidden"))


@register("todo_list", "SELECT id, status, priority, row_number() OVER (PARTITION BY status ORDER BY priority DESC, id) AS place FROM (SELECT o_orderkey AS id, o_orderstatus AS status, CAST(left(o_orderpriority, 1) AS INT) AS priority FROM orders) WHERE priority >= 3 AND status <> 'P'")
def todo_list(spark, d):
    """orders as todos."""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "completed").otherwise(F.col("o_orderstatus")).alias("status"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"))
    return summary.todos(t, least=3, completed=False)


LINK = "CASE page_id % 5 WHEN 0 THEN concat('//', url) WHEN 1 THEN concat('data:', url) WHEN 2 THEN concat(url, '?q=a b&c=d*~+') WHEN 3 THEN concat('/p?u=', url) ELSE url END"


@register("proxied_urls", f"SELECT page_id, CASE WHEN u = '' OR starts_with(u, 'data:') OR contains(u, 'localhost') OR contains(u, '/p?u=') THEN u WHEN starts_with(u, '//') THEN '/p?u=' || url_encode('https:' || u) ELSE '/p?u=' || url_encode(u) END AS via FROM (SELECT page_id, {LINK} AS u FROM pages)")
def proxied_urls(spark, d):
    """Addresses through a proxy."""
    return made(spark, d, "pages", u=LINK).select("page_id", X.proxied(F.col("u"), "/p?u=").alias("via"))


PART_ID = "CASE WHEN p_size % 4 = 0 THEN concat('id', p_partkey) ELSE '' END"
PART_CLASSES = "CASE p_size % 3 WHEN 0 THEN concat(p_size, 'x ', replace(p_brand, '#', '')) WHEN 1 THEN concat('-a ', p_size) ELSE replace(p_brand, '#', '') END"


@register("element_selectors", f"SELECT p_partkey, CASE WHEN i <> '' THEN '#' || i ELSE coalesce('div.' || list_filter(string_split(c, ' '), lambda x: NOT regexp_matches(x, '^[0-9-]'))[1], 'div') END AS selector FROM (SELECT p_partkey, {PART_ID} AS i, {PART_CLASSES} AS c FROM part)")
def element_selectors(spark, d):
    """Selectors by id, class or tag."""
    return made(spark, d, "part", i=PART_ID, c=PART_CLASSES).select("p_partkey", H.selector(F.lit("div"), F.col("i"), F.split("c", " ")).alias("selector"))


@register(
    "selector_forms",
    f"SELECT p_partkey, CASE WHEN i <> '' THEN '#' || i WHEN c = '' THEN 'div' ELSE 'div.' || replace(c, ' ', '.') END AS whole, CASE WHEN i <> '' THEN '#' || i WHEN c = '' THEN 'div' ELSE 'div.' || split_part(c, ' ', 1) END AS short, CASE WHEN i <> '' THEN 'DIV#' || i WHEN c = '' THEN 'DIV' ELSE 'DIV.' || split_part(c, ' ', 1) END AS tagged FROM (SELECT p_partkey, {PART_ID} AS i, {PART_CLASSES} AS c FROM part)",
)
def selector_forms(spark, d):
    """The other three forms of selectors."""
    p = made(spark, d, "part", i=PART_ID, c=PART_CLASSES)
    classes = F.filter(F.split("c", " "), lambda c: c != "")
    forms = H.full_selector(F.lit("DIV"), F.col("i"), classes).alias("whole"), H.short_selector(F.lit("DIV"), F.col("i"), F.col("c")).alias("short"), H.tagged_selector(F.lit("DIV"), F.col("i"), classes).alias("tagged")
    return p.select("p_partkey", *forms)


SELECTOR = "CASE p_size % 5 WHEN 0 THEN concat('#i', p_partkey) WHEN 1 THEN concat('a.c', p_size, ':hover.x') WHEN 2 THEN concat('b.', p_size, 'x') WHEN 3 THEN 'nav' ELSE concat('p.k[a=', p_size, '].z') END"


@register("fallback_selectors", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '#i' || p_partkey WHEN 1 THEN 'a,a.c' || p_size WHEN 2 THEN 'b' WHEN 3 THEN 'nav' ELSE 'p,p.k' END AS selectors FROM part")
def fallback_selectors(spark, d):
    """X11: selectors to fall back to."""
    return made(spark, d, "part", s=SELECTOR).select("p_partkey", F.array_join(H.fallback_selectors(F.col("s")), ",").alias("selectors"))


@register("display_names", "SELECT p_partkey, array_to_string(list_transform(string_split(trim(regexp_replace(replace(replace(x, '-', ' '), '_', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g')), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS name FROM (SELECT p_partkey, concat('main-', replace(p_name, ' ', '_'), 'NavBar') AS x FROM part)")
def display_names(spark, d):
    """Names for readers."""
    return made(spark, d, "part", x="concat('main-', replace(p_name, ' ', '_'), 'NavBar')").select("p_partkey", X.display_name(F.col("x")).alias("name"))


FONT = "CASE p_size % 3 WHEN 0 THEN concat('\"', p_brand, ' Sans\", Arial') WHEN 1 THEN concat(p_brand, ', serif') ELSE p_brand END"


@register("first_fonts", f"SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand || ' Sans' ELSE p_brand END AS font FROM part")
def first_fonts(spark, d):
    """The first font of a list."""
    return made(spark, d, "part", f=FONT).select("p_partkey", H.first_font(F.col("f")).alias("font"))


TYPES = "CASE p_size % 9 WHEN 0 THEN 'image/png' WHEN 1 THEN concat('/f/', p_partkey, '.woff2') WHEN 2 THEN 'text/javascript' WHEN 3 THEN 'text/css; charset=utf-8' WHEN 4 THEN 'text/html' WHEN 5 THEN 'application/json' WHEN 6 THEN concat('/i/', p_partkey, '.SVG') WHEN 7 THEN 'a.mjs' ELSE 'application/octet-stream' END"


@register("content_kinds", "SELECT p_partkey, ['image', 'font', 'script', 'stylesheet', 'document', 'json', 'image', 'script', 'other'][p_size % 9 + 1] AS kind FROM part")
def content_kinds(spark, d):
    """Kinds of resources."""
    return made(spark, d, "part", t=TYPES).select("p_partkey", X.content_kind(F.col("t")).alias("kind"))


@register("telling_lines", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10))[1:50], lambda x: regexp_matches(lower(x), 'error|failed|cannot|unexpected|missing|undefined|null|line|at '))[1:10], chr(10)) AS lines FROM documents")
def telling_lines(spark, d):
    """Lines of a text's head with a telling word."""
    return table(spark, d, "documents").select("doc_id", F.array_join(reports.context_lines(F.col("text")), "\n").alias("lines"))


@register("plain_terminal", "SELECT p_partkey, p_name || chr(10) AS line FROM part")
def plain_terminal(spark, d):
    """Terminal text without codes."""
    raw = F.concat(F.lit("\x1b[1;3"), (F.col("p_size") % 8).cast("string"), F.lit("m"), "p_name", F.lit("\x1b[0m\r\n"))
    return table(spark, d, "part").select("p_partkey", X.strip_ansi(raw).alias("line"))


@register("changed_styles", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'color' END, CASE WHEN p_size % 3 <> 0 THEN 'width' END, 'z'], lambda x: x IS NOT NULL), ',') AS changed FROM part")
def changed_styles(spark, d):
    """Styles of a state that differ."""
    base = F.create_map(F.lit("color"), F.lit("red"), F.lit("width"), F.lit("0"), F.lit("left"), F.lit("1"))
    over = F.create_map(F.lit("color"), F.when(F.col("p_size") % 2 == 0, "blue").otherwise("red"), F.lit("width"), (F.col("p_size") % 3).cast("string"), F.lit("z"), F.lit("9"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(reports.changed(base, over))), ",").alias("changed"))


FLAGS = {"colors": "p_size % 2", "elements": "0", "variables": "CASE WHEN p_size % 9 = 0 THEN 4 ELSE 0 END", "images": "0", "media_query": "p_size % 5 = 0", "dark_class": "p_size % 7 = 0"}


@register("theme_support", "SELECT p_partkey, CASE WHEN p_size % 2 = 1 OR p_size % 9 = 0 OR p_size % 5 = 0 THEN 'BOTH' WHEN p_size % 7 = 0 THEN 'DARK_ONLY' ELSE 'LIGHT_ONLY' END AS support FROM part")
def theme_support(spark, d):
    """Themes of a page."""
    return reports.theme_support(made(spark, d, "part", **FLAGS)).select("p_partkey", "support")


@register("accepted_code", "SELECT page_id, len(regexp_extract_all(html, 'href=\"')) >= 3 AND len(regexp_extract_all(html, 'src=\"http')) >= page_id % 2 AND page_id % 3 = 0 AS ok FROM pages")
def accepted_code(spark, d):
    """Code that meets its contract."""
    code = F.concat("html", F.when(F.col("page_id") % 3 == 0, "export default A").otherwise(""))
    return table(spark, d, "pages").select("page_id", planning.accepted(code, (F.col("page_id") % 2).cast("int"), F.lit(3)).alias("ok"))


@register("json_slash_path", "SELECT event_id, CAST(event_id % 50 AS VARCHAR) AS found, props->>'$.k' AS k FROM events")
def json_slash_path(spark, d):
    """Values at slash paths."""
    doc = F.concat(F.lit('{"a": {"b": [1, '), (F.col("event_id") % 50).cast("string"), F.lit("]}}"))
    return table(spark, d, "events").withColumn("doc", doc).select("event_id", jsonq.path("doc", "a/b/1").alias("found"), jsonq.path("props", "/k").alias("k"))


@register("json_nodes", "SELECT CAST(event_id AS VARCHAR) AS event_id, '$' AS path, 0 AS depth, CAST(json(props) AS VARCHAR) AS value FROM events UNION ALL SELECT CAST(event_id AS VARCHAR), '$.' || k, 1, json_extract(props, '$.' || k) FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_nodes(spark, d):
    """All nodes of documents."""
    return jsonpath.walk(table(spark, d, "events"), "event_id", "props")


@register("json_subset", "SELECT event_id, coalesce(props->>'$.k', '') AS k, CASE WHEN props->>'$.k' IS NULL THEN 'k,z' ELSE 'z' END AS missing FROM events")
def json_subset(spark, d):
    """The keys asked for, and those that aren't there."""
    has, missing = summary.subset(F.col("props"), ("k", "z"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(has, F.lit("k")), F.lit("")).alias("k"), F.array_join(missing, ",").alias("missing"))


@register("json_fields", "SELECT DISTINCT user_id, unnest(CASE WHEN value < 50 THEN ['a', 'b' || (user_id % 3)] ELSE ['a', 'c'] END) AS field FROM events")
def json_fields(spark, d):
    """E5: fields of the items of lists."""
    item = F.when(F.col("value") < 50, F.concat(F.lit('[{"a": 1}, 7, {"b'), (F.col("user_id") % 3).cast("string"), F.lit('": 2}]'))).otherwise(F.lit('[{"a": 1, "c": {"x": 0}}, "s", 1, 2, 3, {"late": 1}]'))
    return jsonq.union_keys(table(spark, d, "events").withColumn("doc", item), "user_id", "doc").distinct()


@register("shown_values", "SELECT doc_id, CASE WHEN text IS NULL THEN 'null' WHEN length(text) > 500 THEN left(text, 500) || '... (' || length(text) || ' chars)' ELSE text END AS shown FROM documents")
def shown_values(spark, d):
    """Values for readers."""
    return table(spark, d, "documents").select("doc_id", summary.formatted(F.col("text")).alias("shown"))


@register("missing_imports", "SELECT '/src/s' || s_suppkey || '.jsx' AS path, './s' || (s_suppkey + 2) AS import FROM supplier WHERE s_suppkey + 2 NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT '/src/s' || s_suppkey || '.jsx', '../lib/x' FROM supplier WHERE s_suppkey % 4 = 0")
def missing_imports(spark, d):
    """Relative imports without a file."""
    k = F.col("s_suppkey")
    code = F.concat(F.lit("import A from './s"), (k + 2).cast("string"), F.lit("'\nimport B from 'react'\n"), F.when(k % 4 == 0, "import '../lib/x'").otherwise("import '../src/s1.jsx'"))
    return O.unresolved_imports(table(spark, d, "supplier").select(F.concat(F.lit("/src/s"), k.cast("string"), F.lit(".jsx")).alias("path"), code.alias("content")))


@register("missing_packages", "SELECT DISTINCT 'pkg' || (s_suppkey % 50) AS name FROM supplier WHERE s_suppkey % 50 % 2 = 1 UNION SELECT DISTINCT '@sc' || (s_suppkey % 7) || '/p' FROM supplier")
def missing_packages(spark, d):
    """Packages that nothing declares."""
    k = F.col("s_suppkey")
    code = F.concat(F.lit("import a from 'pkg"), (k % 50).cast("string"), F.lit("/sub'\nimport r from 'react'\nconst b = require('@sc"), (k % 7).cast("string"), F.lit("/p/q')"))
    declared = table(spark, d, "supplier").select(F.concat(F.lit("pkg"), (k % 25 * 2).cast("string")).alias("name")).distinct()
    return O.undeclared_packages(table(spark, d, "supplier").select(code.alias("content")), declared)


@register("section_records", "SELECT p_partkey AS page_id, replace(lower(p_type), '-', '_') AS id, coalesce(CASE WHEN p_size % 2 = 0 THEN p_name END, lower(p_type)) AS name, CASE WHEN p_size % 3 = 0 THEN p_size * 400.0 ELSE p_size * 1.0 END AS y, 1920.0 AS width, 400.0 AS height, 'in:internal,out:external' AS links FROM part")
def section_records(spark, d):
    """Components as sections, links of both kinds in one list."""
    c = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_size").alias("index"), F.lower("p_type").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("name"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") * 1.0).alias("y"), F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"), F.array(F.lit("in")).alias("links_in"), F.array(F.lit("out")).alias("links_out"))
    return summary.sections_of(c).withColumn("links", F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["url"], x["kind"])), ","))


@register("sparse_styles", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'background_color=' || p_brand END, CASE WHEN p_size % 3 = 0 THEN 'float_=left' END, CASE WHEN p_size % 5 <> 0 THEN 'width=' || (p_size % 5) || 'px' END], lambda x: x IS NOT NULL), ';') AS styles FROM part")
def sparse_styles(spark, d):
    """styles that say something."""
    n = F.col("p_size")
    m = F.create_map(F.lit("backgroundColor"), F.when(n % 2 == 0, F.col("p_brand")).otherwise("none"), F.lit("float"), F.when(n % 3 == 0, "left").otherwise("auto"), F.lit("width"), F.concat((n % 5).cast("string"), F.lit("px")), F.lit("font-style"), F.lit("normal"), F.lit("x"), F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.transform(F.map_entries(H.sparse_styles(m)), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("styles"))


@register("significant_elements", "SELECT p_partkey FROM part WHERE p_size * 10 >= 50 AND p_partkey % 60 >= 30 AND (p_size % 4 = 0 OR p_size % 3 = 0 OR p_size % 5 = 0)")
def significant_elements(spark, d):
    """elements that matter by themselves."""
    n = F.col("p_size")
    classes = F.array(F.lit("x"), F.when(n % 3 == 0, "MyHeroBox").otherwise("y"))
    ok = H.is_significant(F.when(n % 4 == 0, "Section").otherwise("div"), F.when(n % 5 == 0, "i").otherwise(""), classes, n * 10, F.col("p_partkey") % 60)
    return table(spark, d, "part").where(ok).select("p_partkey")


@register("background_urls", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'http://a/' || p_partkey || '.png' WHEN 1 THEN '/b.png' WHEN 2 THEN 'c.png' END AS url FROM part")
def background_urls(spark, d):
    """Addresses of backgrounds."""
    k = F.col("p_size") % 4
    style = F.when(k == 0, F.concat(F.lit("url(\"http://a/"), F.col("p_partkey").cast("string"), F.lit('.png")'))).when(k == 1, "linear-gradient(red, blue), url('/b.png')").when(k == 2, "url(c.png) no-repeat").otherwise("none")
    return table(spark, d, "part").select("p_partkey", H.background_url(style).alias("url"))


SQL_PARTS = "SELECT p_partkey % 40 AS page_id, p_partkey AS id, p_type AS type, p_size % 4 AS n_links, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 5 END AS n_images, p_partkey * 3 AS tokens FROM part"


@register("component_stats", f"SELECT page_id, components, types, total_n_links, total_n_images, total_tokens, total_tokens // components AS avg_tokens FROM (SELECT page_id, count(*) AS components, count(DISTINCT type) AS types, sum(n_links) AS total_n_links, sum(coalesce(n_images, 0)) AS total_n_images, sum(tokens) AS total_tokens FROM ({SQL_PARTS}) GROUP BY page_id)")
def component_stats(spark, d):
    """Numbers of a page's components."""
    c = spark.sql(SQL_PARTS.replace("FROM part", "FROM {p}"), p=table(spark, d, "part"))
    s = summary.component_stats(c)
    return s.select("page_id", "components", F.size("by_type").cast("long").alias("types"), "total_n_links", "total_n_images", "total_tokens", "avg_tokens")


@register("image_users", "SELECT page_id, url, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT DISTINCT p_partkey % 40 AS page_id, p_partkey AS id, unnest([p_brand, p_brand, 'x' || p_size % 2]) AS url FROM part) GROUP BY page_id, url")
def image_users(spark, d):
    """Components that show an image."""
    c = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("page_id"), F.col("p_partkey").alias("id"), F.array("p_brand", "p_brand", F.concat(F.lit("x"), (F.col("p_size") % 2).cast("string"))).alias("images"))
    return summary.image_users(c).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@register("component_html", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN 'raw' WHEN 2 THEN NULL ELSE NULL END AS found FROM pages")
def component_html(spark, d):
    """P10: HTML of a component by its index."""
    k = F.col("page_id") % 4
    one = F.struct(F.when(k == 0, F.col("html")).otherwise("").alias("full_html"), F.lit(None).cast("string").alias("located_html"), F.when(k == 1, "raw").alias("raw_html"))
    return table(spark, d, "pages").select("page_id", summary.component_html(F.array(one, one), F.when(k == 3, 2).otherwise(1)).alias("found"))


@register("page_styles", "SELECT p_partkey AS page_id, least(p_size * 2, 50) AS variables, least(p_size, 20) AS colors, 0 AS fonts FROM part")
def page_styles(spark, d):
    """The first styles of pages."""
    list_ = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string"))
    s = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), list_(F.col("p_size") * 2).alias("variables"), list_(F.col("p_size")).alias("colors"), F.lit(None).cast("array<string>").alias("fonts"))
    return summary.page_styles(s).select("page_id", *(F.size(c).alias(c) for c in ("variables", "colors", "fonts")))


@register("spacing_scale", "SELECT page_id, step, CASE WHEN v = floor(v) THEN CAST(CAST(v AS INT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END || 'px' AS size FROM (SELECT page_id, v, CAST(row_number() OVER (PARTITION BY page_id ORDER BY v) AS INT) - 1 AS step FROM (SELECT DISTINCT page_id, v FROM (SELECT p_partkey AS page_id, unnest([p_size, p_size / 2, 8, 4, p_size + 0.5, 1, 2, 3, 5, 6, 7, 12]) AS v FROM part))) WHERE step < 10")
def spacing_scale(spark, d):
    """Steps of spacing."""
    n = F.col("p_size").cast("double")
    num = lambda *v: F.array(*(x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in v))
    s = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), num(n, n / 2, 8, 4, n + 0.5, n).alias("margins"), num(1, 2, 3, 5, 6, 7, 12, 4).alias("paddings"))
    return summary.spacing_scale(s)


@register("replay_stats", "SELECT user_id AS replay_id, coalesce(arg_min(CASE WHEN event_type = 'signup' THEN event_id % 6 END, CASE WHEN event_type = 'signup' THEN (epoch_ms(ts) % 100000000, event_id) END), 0) AS sections, count(*) FILTER (event_type = 'view') AS files, max(epoch_ms(ts) % 100000000) // 1000 AS duration_seconds FROM events GROUP BY user_id")
def replay_stats(spark, d):
    """Numbers of recordings."""
    k = F.col("event_type")
    e = table(spark, d, "events").select(F.col("user_id").alias("replay_id"), F.col("event_id").alias("seq"), (X.millis(F.col("ts")) % 100_000_000).alias("ts_ms"), F.when(k == "signup", "worker_spawned").when(k == "view", "file_written").otherwise(k).alias("type"), F.slice(F.sequence(F.lit(1), F.lit(6)), 1, (F.col("event_id") % 6).cast("int")).alias("workers"))
    return summary.replay_stats(e)


@register("found_files", f"SELECT 'content' AS mode, path FROM {SQL_FILES} WHERE regexp_matches(content, '(?i)licen[sc]e') UNION ALL SELECT 'files', path FROM {SQL_FILES} WHERE path GLOB '/src?/*1.txt'")
def found_files(spark, d):
    """Files that a pattern finds, by what kind of pattern it is."""
    f = files(spark, d)
    by = lambda p, mode=None: O.found(f, p, mode).select(F.lit(mode or O.search_mode(p)).alias("mode"), "path")
    return by("licen[sc]e", "content").union(by("/src?/*1.txt"))
