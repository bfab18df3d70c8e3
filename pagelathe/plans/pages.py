"""Queries over the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.functions import html as H
from pagelathe.functions import text as X
from pagelathe.functions import urls as U
from pagelathe.operators import css, elements, sections, summary, tree
from pagelathe.plans import nodes_sql
from pagelathe.plans.catalog import register
from pagelathe.sources.tables import table, written

TAG = "<([a-zA-Z][a-zA-Z0-9]*)"
HREF = 'href="([^"]*)"'


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def tags(p: DataFrame) -> DataFrame:
    """(page_id, pos, tag) of all opening tags."""
    return p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TAG), F.lit(1))).alias("pos", "tag")).withColumn("tag", F.lower("tag"))


def links(p: DataFrame) -> DataFrame:
    """(page_id, url, pos, href) of all links."""
    return p.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "href"))


SQL_TAGS = f"(SELECT page_id, generate_subscripts(t, 1) - 1 AS pos, lower(unnest(t)) AS tag FROM (SELECT page_id, regexp_extract_all(html, '{TAG}', 1) AS t FROM pages))"
SQL_LINKS = f"(SELECT page_id, url, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '{HREF}', 1) AS t FROM pages))"
SQL_HOST = "regexp_extract({0}, '^https?://([^/?#:]+)', 1)"


@register("tag_counts", f"SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM {SQL_TAGS} GROUP BY tag")
def tag_counts(spark, d):
    """A2 over the corpus: tags, how often and on how many pages."""
    return tags(pages(spark, d)).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def top_k(df: DataFrame, group: list[str], value: str, k: int, pos: str = "pos") -> DataFrame:
    """A3: the k most frequent values of each group, ties by first place; ranks are over counts, so a group's rows are already few."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@register("tag_top10_per_page", f"SELECT page_id, tag, n, rank FROM (SELECT page_id, tag, count(*) AS n, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(pos)) AS rank FROM {SQL_TAGS} GROUP BY page_id, tag) WHERE rank <= 10")
def tag_top10(spark, d):
    """A2/A3/L1: each page's ten most frequent tags."""
    return top_k(tags(pages(spark, d)), ["page_id"], "tag", 10).select("page_id", "tag", "n", "rank")


@register("page_metadata", f"SELECT p.page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {SQL_HOST.format('url')} AS host, length(html) AS html_chars, length(html) // 4 AS est_tokens, coalesce(n, 0) AS total_tags FROM pages p LEFT JOIN (SELECT page_id, count(*) AS n FROM {SQL_TAGS} GROUP BY page_id) t USING (page_id)")
def page_metadata(spark, d):
    """A page's title, host and sizes."""
    p = pages(spark, d)
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), X.host(F.col("url")).alias("host"), F.char_length("html").alias("html_chars"), H.est_tokens(F.col("html")).alias("est_tokens"), F.regexp_count("html", F.lit(TAG)).alias("total_tags"))


@register("url_parts", "SELECT page_id, regexp_extract(url, '^(https?)', 1) AS scheme, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS file_name FROM pages")
def url_parts(spark, d):
    """Parts of page URLs."""
    u = F.col("url")
    return pages(spark, d).select("page_id", F.parse_url(u, F.lit("PROTOCOL")).alias("scheme"), F.parse_url(u, F.lit("HOST")).alias("host"), F.parse_url(u, F.lit("PATH")).alias("path"), F.parse_url(u, F.lit("QUERY")).alias("query"), F.parse_url(u, F.lit("REF")).alias("fragment"), X.file_name(u).alias("file_name"))


SQL_RESOLVED = r"CASE WHEN regexp_matches(href, '^(data:|javascript:|mailto:|tel:|#|\{|\$)') OR regexp_matches(href, '^https?://') OR href = '' THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') || '/' || regexp_replace(href, '^\./', '') END"


@register("page_links", f"SELECT page_id, pos, {SQL_RESOLVED} AS link FROM {SQL_LINKS}")
def page_links(spark, d):
    """Links made absolute."""
    return links(pages(spark, d)).select("page_id", "pos", X.resolve_url(F.col("href"), F.col("url")).alias("link"))


@register("link_internal_external", f"SELECT page_id, count(*) FILTER (NOT ext) AS internal, count(*) FILTER (ext) AS external FROM (SELECT page_id, starts_with(link, 'http') AND NOT contains(link, {SQL_HOST.format('url')}) AS ext FROM (SELECT page_id, url, {SQL_RESOLVED} AS link FROM {SQL_LINKS})) GROUP BY page_id")
def link_internal_external(spark, d):
    """Links within and out of the page's domain."""
    l = links(pages(spark, d)).select("page_id", X.is_external(X.resolve_url(F.col("href"), F.col("url")), X.host(F.col("url"))).alias("ext"))
    return l.groupBy("page_id").agg(F.count_if(~F.col("ext")).alias("internal"), F.count_if("ext").alias("external"))


@register("link_dedupe_totals", f"SELECT page_id, count(*) AS links, count(DISTINCT href) AS distinct_links, arg_min(href, pos) AS first_link FROM {SQL_LINKS} GROUP BY page_id")
def link_dedupe_totals(spark, d):
    """Links and distinct links, the first one kept."""
    return links(pages(spark, d)).groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("distinct_links"), F.min_by("href", "pos").alias("first_link"))


SQL_CLEAN = "coalesce(html, '')"
for _p, _to in H.HEAD_STEPS:
    SQL_CLEAN = f"regexp_replace({SQL_CLEAN}, '{_p}', '{_to}', 'g')"
SQL_WRAP = f"CASE WHEN regexp_matches(c, '{H.BODY}') THEN regexp_extract(c, '{H.BODY}', 1) ELSE c END"
for _p, _to in H.WRAPPER_STEPS:
    SQL_WRAP = f"regexp_replace({SQL_WRAP}, '{_p}', '{_to}', 'g')".replace("\n\n", "' || chr(10) || chr(10) || '")
SQL_WRAP = rf"regexp_replace({SQL_WRAP}, '^\s+|\s+$', '', 'g')"


@register("section_html_md5", f"SELECT page_id, length(s) AS chars, md5(s) AS md5 FROM (SELECT page_id, {SQL_WRAP} AS s FROM (SELECT page_id, {SQL_CLEAN} AS c FROM pages))")
def section_html_md5(spark, d):
    """Pages cleaned to their section."""
    p = pages(spark, d).select("page_id", H.section_html(F.col("html")).alias("s"))
    return p.select("page_id", F.char_length("s").alias("chars"), F.md5(F.col("s").cast("binary")).alias("md5"))


SQL_TOKEN = "coalesce(html, '')"
for _p, _to in H.TOKEN_STEPS:
    SQL_TOKEN = f"regexp_replace({SQL_TOKEN}, '{_p}', '{_to}', 'g')"
WITH_DATA = """replace(html, '<nav>', '<nav style="' || repeat('x', 150 + CAST(page_id % 100 AS INT)) || '"><img src="data:image/png;base64,' || md5(url) || '=="><svg a="1"><path/></svg>')"""


@register("token_html_md5", f"SELECT page_id, length(s) AS chars, length(s) // 4 AS est_tokens, md5(s) AS md5 FROM (SELECT page_id, {SQL_TOKEN} AS s FROM (SELECT page_id, {WITH_DATA} AS html FROM pages))")
def token_html_md5(spark, d):
    """Pages, with embedded data put in, without what should not count as tokens."""
    p = pages(spark, d).selectExpr("page_id", f"{WITH_DATA.replace('md5(url)', 'md5(cast(url AS binary))')} AS html").select("page_id", H.token_html(F.col("html")).alias("s"))
    return p.select("page_id", F.char_length("s").alias("chars"), H.est_tokens(F.col("s")).alias("est_tokens"), F.md5(F.col("s").cast("binary")).alias("md5"))


@register("head_meta_ratio", f"SELECT page_id, metas, total, CASE WHEN total > 0 THEN metas / total ELSE 0 END > 0.5 AS is_head FROM (SELECT page_id, len(regexp_extract_all(html, '(?i)<meta')) AS metas, len(regexp_extract_all(html, '{TAG}')) AS total FROM pages)")
def head_meta_ratio(spark, d):
    """pages that are mostly head elements."""
    p = pages(spark, d).select("page_id", F.regexp_count("html", F.lit("(?i)<meta")).alias("metas"), F.regexp_count("html", F.lit(TAG)).alias("total"))
    return p.withColumn("is_head", F.when(F.col("total") > 0, F.col("metas") / F.col("total")).otherwise(F.lit(0.0)) > 0.5)


SECTION = r'<(section|div|header|footer|nav|main|article|aside)[^>]*class="([^"]*)"'
SQL_NAME = "CASE WHEN tag = 'header' OR contains(cls, 'header') THEN 'header' WHEN tag = 'footer' OR contains(cls, 'footer') THEN 'footer' WHEN tag = 'nav' OR contains(cls, 'nav') THEN 'navigation' " + " ".join(f"WHEN {' OR '.join(f"contains(cls, '{w}')" for w in words)} THEN '{name}'" for name, words in H.SECTION_WORDS) + " ELSE 'section_' || pos END"
SQL_TYPE = "CASE WHEN tag = 'header' OR contains(cls, 'header') OR contains(cls, 'nav') THEN 'header' WHEN tag = 'footer' OR contains(cls, 'footer') THEN 'footer' WHEN tag = 'nav' OR contains(cls, 'navigation') THEN 'navigation' " + " ".join(f"WHEN {' OR '.join(f"contains(cls, '{w}')" for w in words)} THEN '{name}'" for name, words in H.LAYOUT_WORDS) + " WHEN pos = 0 THEN 'header' WHEN pos = total - 1 THEN 'footer' ELSE 'section_' || pos END"
SQL_BLOCKS = "(SELECT page_id, url, pos, tag, cls, count(*) OVER (PARTITION BY page_id) AS total FROM (SELECT page_id, url, pos, tag, CASE pos % 7 WHEN 0 THEN 'Hero-x' WHEN 1 THEN 'ad' WHEN 2 THEN 'news' WHEN 3 THEN 'price pricing' WHEN 4 THEN 'navbar' ELSE '' END AS cls FROM " + SQL_TAGS.replace("SELECT page_id,", "SELECT page_id, url,") + "))"


def blocks(p: DataFrame) -> DataFrame:
    """Tags with made-up classes, for naming."""
    t = tags(p)
    cls = F.when(t.pos % 7 == 0, "Hero-x").when(t.pos % 7 == 1, "ad").when(t.pos % 7 == 2, "news").when(t.pos % 7 == 3, "price pricing").when(t.pos % 7 == 4, "navbar").otherwise("")
    return t.withColumn("cls", cls).withColumn("total", F.count("*").over(Window.partitionBy("page_id")))


@register("section_names", f"SELECT page_id, pos, {SQL_NAME} AS name, {SQL_TYPE} AS type FROM (SELECT page_id, pos, tag, lower(cls) AS cls, total FROM (SELECT page_id, pos, tag, CASE pos % 7 WHEN 0 THEN 'Hero-x' WHEN 1 THEN 'ad' WHEN 2 THEN 'news' WHEN 3 THEN 'price pricing' WHEN 4 THEN 'navbar' ELSE '' END AS cls, count(*) OVER (PARTITION BY page_id) AS total FROM {SQL_TAGS}))")
def section_names(spark, d):
    """Section names and layout types."""
    b = blocks(pages(spark, d))
    return b.select("page_id", "pos", H.section_name(F.col("tag"), F.col("cls"), F.col("pos")).alias("name"), H.layout_type(F.col("tag"), F.col("cls"), F.col("pos"), F.col("total")).alias("type"))


@register("html_fingerprint_dupes", "SELECT page_id, count(*) OVER (PARTITION BY left(html, 200)) AS copies, min(page_id) OVER (PARTITION BY left(html, 200)) AS owner FROM pages")
def html_fingerprint_dupes(spark, d):
    """Pages whose first 200 characters are the same; counted before the join, so common heads meet in no task."""
    p = pages(spark, d).select("page_id", F.left("html", F.lit(200)).alias("head"))
    return p.join(p.groupBy("head").agg(F.count("*").alias("copies"), F.min("page_id").alias("owner")), "head").select("page_id", "copies", "owner")


SQL_TOOLS = " UNION ALL ".join(f"SELECT page_id, '{name}' AS tool, least({' + '.join(f"CASE WHEN regexp_matches(html, '(?i){p}') THEN 60 ELSE 0 END" for p in pats)}, 100) AS confidence FROM (SELECT page_id, html || CASE page_id % 3 WHEN 0 THEN 'webpackJsonp' WHEN 1 THEN '/@vite/x' ELSE 'rollup' END AS html FROM pages)" for name, pats in H.BUILD_TOOLS.items())


@register("tech_build_tools", f"SELECT * FROM ({SQL_TOOLS}) WHERE confidence >= 50")
def tech_build_tools(spark, d):
    """Build tools by points of evidence."""
    p = pages(spark, d).withColumn("html", F.concat("html", F.when(F.col("page_id") % 3 == 0, "webpackJsonp").when(F.col("page_id") % 3 == 1, "/@vite/x").otherwise("rollup")))
    tools = F.explode(F.array(*(F.struct(F.lit(n).alias("tool"), H.evidence(F.col("html"), pats).alias("confidence")) for n, pats in H.BUILD_TOOLS.items()))).alias("t")
    return p.select("page_id", tools).select("page_id", "t.*").where("confidence >= 50")


@register("link_sets", f"WITH l AS (SELECT DISTINCT page_id % 2 AS side, href FROM {SQL_LINKS}), a AS (SELECT href FROM l WHERE side = 0), b AS (SELECT href FROM l WHERE side = 1) SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS common, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS total, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_even, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_odd")
def link_sets(spark, d):
    """Intersection, union and differences of link sets, in one aggregation."""
    l = links(pages(spark, d)).groupBy("href").agg(F.max((F.col("page_id") % 2 == 0)).alias("a"), F.max((F.col("page_id") % 2 == 1)).alias("b"))
    return l.agg(F.count_if(F.col("a") & F.col("b")).alias("common"), F.count("*").alias("total"), F.count_if(F.col("a") & ~F.col("b")).alias("only_even"), F.count_if(F.col("b") & ~F.col("a")).alias("only_odd"))


ASSET = "CASE (page_id * 7 + pos) % 12 WHEN 0 THEN concat(href, '-DARK.png') WHEN 1 THEN concat(href, '_light.svg') WHEN 2 THEN concat('/dark', href, '.png') WHEN 3 THEN concat(href, '/light/a.png') WHEN 4 THEN concat(href, '-dark-and-light.svg') WHEN 5 THEN concat(href, '-dark-or_light_.svg') WHEN 6 THEN concat(href, 'LightMode') WHEN 7 THEN concat('dark_mode', href) WHEN 8 THEN concat(href, 'light-mode') WHEN 9 THEN concat(href, '-darker.png') WHEN 10 THEN concat(href, 'dark/') ELSE href END"


@register("theme_urls", f"SELECT page_id, pos, CASE (page_id * 7 + pos) % 12 WHEN 0 THEN 'dark' WHEN 1 THEN 'light' WHEN 2 THEN 'dark' WHEN 3 THEN 'light' WHEN 4 THEN 'common' WHEN 5 THEN 'common' WHEN 6 THEN 'light' WHEN 7 THEN 'dark' WHEN 8 THEN 'light' ELSE 'common' END AS theme FROM {SQL_LINKS}")
def theme_urls(spark, d):
    """a URL's theme by how it names one; both or neither is common."""
    return links(pages(spark, d)).withColumn("href", F.expr(ASSET)).select("page_id", "pos", U.theme(F.col("href")).alias("theme"))


@register("tag_categories", f"SELECT page_id, count(*) FILTER (tag IN ('a','button','input','select','textarea','label','details','summary')) AS interactive, count(*) FILTER (tag IN ('header','footer','nav','main','section','article','aside','div')) AS layout, count(*) FILTER (tag NOT IN ('script','style','head','meta','link','noscript','svg','path','br','hr')) AS kept FROM {SQL_TAGS} GROUP BY page_id")
def tag_categories(spark, d):
    """tags by category."""
    t = F.col("tag")
    return tags(pages(spark, d)).groupBy("page_id").agg(F.count_if(t.isin(*elements.INTERACTIVE)).alias("interactive"), F.count_if(t.isin(*elements.LAYOUT)).alias("layout"), F.count_if(~t.isin(*elements.SKIPPED)).alias("kept"))


@register("dom_elements", nodes_sql.ELEMENTS)
def dom_elements(spark, d):
    """Pages as a table of nodes, with depths and subtree sizes."""
    return elements.flatten(pages(spark, d)).select("page_id", "node_id", "parent_id", "depth", "sibling_idx", "subtree_end", "xpath", "tag", "selector", (F.col("subtree_end") - F.col("node_id") + 1).alias("element_count"))


@register("dom_page_stats", nodes_sql.PAGE_STATS)
def dom_page_stats(spark, d):
    """Elements and depth of each page's tree."""
    return elements.flatten(pages(spark, d)).groupBy("page_id").agg(F.count("*").alias("total_elements"), F.max("depth").alias("max_depth"), F.count_if("is_interactive").alias("interactive"))


@register("dom_sections", nodes_sql.SECTIONS)
def dom_sections(spark, d):
    """The body's children as sections."""
    return tree.body_sections(elements.flatten(pages(spark, d)))


@register("dom_semantic_sections", nodes_sql.SEMANTIC_SECTIONS)
def dom_semantic_sections(spark, d):
    """T5: topmost semantic elements."""
    return tree.topmost(elements.flatten(pages(spark, d)), F.col("tag").isin(*elements.SEMANTIC)).select("page_id", "node_id", "tag", "xpath")


@register("dom_ancestor_filter", nodes_sql.ANCESTORS)
def dom_ancestor_filter(spark, d):
    """links and all their ancestors."""
    return tree.with_ancestors(elements.flatten(pages(spark, d)), F.col("tag") == "a").select("page_id", "node_id", "tag", "matched")


@register("dom_rag_chunks")
def dom_rag_chunks(spark, d):
    """Chunks of a page for retrieval, with their embedding texts."""
    return tree.chunks(pages(spark, d), elements.node_table(pages(spark, d)))


@register("dom_layout_tree", nodes_sql.LAYOUT)
def dom_layout_tree(spark, d):
    """A compact indented tree of each page."""
    return tree.layout_text(elements.flatten(pages(spark, d)))


@register("dom_repeated_lists", nodes_sql.REPEATED)
def dom_repeated_lists(spark, d):
    """Repeated siblings of one tag and class, with three examples."""
    return tree.repeated(elements.flatten(pages(spark, d)), 3).withColumn("examples", F.array_join("examples", "|"))


def told_rules(rules: DataFrame, between: str) -> DataFrame:
    """Rules with conditions and declarations as text."""
    pairs = F.transform("declarations", lambda x: F.concat(x["key"], F.lit(between), x["value"]))
    return rules.withColumns({"conditions": F.array_join("conditions", " / "), "declarations": F.array_join(pairs, ";")})


@register("css_rules", nodes_sql.CSS)
def css_rules(spark, d):
    """Rules of style elements."""
    return told_rules(css.css_rules(pages(spark, d)), ":")


@register("css_nested_rules", nodes_sql.CSS_NESTED)
def css_nested_rules(spark, d):
    """The pages' rules within others, amid comments, strings and addresses with braces."""
    own, n = F.regexp_extract("html", "<style>([^<]*)</style>", 1), F.col("page_id").cast("string")
    sheet = F.concat(F.lit('@import "a;b.css";/* } */@media (min-width: '), n, F.lit("px){"), own, F.lit('@supports (display: grid){.x::before{content:"}'), n, F.lit('{"}}}@keyframes k{50%{top:'), n, F.lit("px}}:root{--a:url(data:x;y)}"), F.regexp_extract(own, r"^([^{]*)\{", 1), F.lit("{.in & > b{margin:0"))
    sheets = pages(spark, d).where(own != "").select("page_id", F.concat(F.lit("<style>"), sheet, F.lit("</style>")).alias("html"))
    # the last rule is closed by the sheet's end, and so is the one around it, which declares nothing
    return told_rules(css.css_rules(sheets), "=").where("rule_no <> 8").withColumn("rule_no", F.least("rule_no", F.lit(8)))


@register("pages_absolute", nodes_sql.ABSOLUTE)
def pages_absolute(spark, d):
    """Whole pages with all addresses made absolute."""
    made = F.replace("html", F.lit("</body>"), F.expr(nodes_sql.ADDRESSES))
    return pages(spark, d).select("page_id", F.md5(U.absolute_html(made, F.col("url")).cast("binary")).alias("md5"), F.length(U.absolute_html(made, F.col("url"))).alias("n"))


SCRIPTS = "CASE page_id % 4 WHEN 0 THEN '<script src=\"/js/Vue.min.js\"></script>' WHEN 1 THEN '<script src=''/_next/static/a.js''></script><script src=/jquery.js></script>' WHEN 2 THEN '<script src=\"/tailwind.js\"></script>' ELSE '<script src=\"/none.js\">' END"
MARKS = "CASE page_id % 4 WHEN 0 THEN '<div data-v-12 class=\"flex x\">' WHEN 1 THEN '<div data-next-page=\"1\">' WHEN 2 THEN '<div class=\"px-2 flexbox\"><p class=\"text-sm\">' ELSE '' END"


@register(
    "tech_evidence",
    "SELECT page_id, 'Vue' AS name, 'framework' AS type, CASE WHEN page_id % 3 = 0 THEN 75 ELSE 50 END AS confidence FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT page_id, 'Next.js', 'framework', 50 FROM pages WHERE page_id % 4 = 1 "
    "UNION ALL SELECT page_id, 'jQuery', 'library', 75 FROM pages WHERE page_id % 4 = 1 AND page_id % 3 = 0 UNION ALL SELECT page_id, 'Tailwind CSS', 'library', 85 FROM pages WHERE page_id % 4 = 2",
)
def tech_evidence(spark, d):
    """Technologies by points over scripts, global names, classes and data attributes."""
    p = pages(spark, d).withColumn("html", F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), F.expr(SCRIPTS), F.expr(MARKS))))
    names = p.select("page_id", F.when(F.col("page_id") % 3 == 0, F.array(F.lit("Vue"), F.lit("$"))).alias("names"))
    return tree.technologies(p, elements.flatten(p, include_hidden=True), names)


@register("dom_main_content", nodes_sql.MAIN)
def dom_main_content(spark, d):
    """Where each page's content starts."""
    return summary.main_content(elements.flatten(pages(spark, d)))


@register("dom_skeletons")
def dom_skeletons(spark, d):
    """Outlines of pages."""
    return summary.skeletons(elements.flatten(pages(spark, d)))


@register("dom_visible_text", nodes_sql.VISIBLE)
def dom_visible_text(spark, d):
    """What a page shows."""
    return summary.visible_text(elements.flatten(pages(spark, d)))


@register("dom_landmarks", nodes_sql.FIRST_LANDMARKS)
def dom_landmarks(spark, d):
    """Landmarks of pages."""
    return summary.landmarks(elements.flatten(pages(spark, d)))


@register("dom_split_sections", nodes_sql.SPLIT)
def dom_split_sections(spark, d):
    """Sections of bounded size, by boxes made from the nodes' numbers."""
    boxes = elements.flatten(pages(spark, d)).withColumns({"width": (F.col("node_id") * 37 + F.col("page_id") * 11) % 1700 + F.when(F.col("depth") < 3, 1000).otherwise(0), "height": (F.col("node_id") * 53 + F.col("page_id") * 7) % 400 + F.when(F.col("depth") < 3, 300).otherwise(0)})
    nodes = written(boxes.select("page_id", "node_id", "parent_id", "subtree_end", "tag", "inner_html_length", "children_count", "width", "height"))
    found = sections.extract(nodes, F.lit(1800), F.lit(500), least=5, large=60)
    return sections.split(nodes, found, most=100, least=5, large=60)


@register("dom_snapshot", nodes_sql.SNAPSHOT)
def dom_snapshot(spark, d):
    """Compact rows of a page's upper levels."""
    return summary.snapshot(elements.own_attributes(elements.flatten(pages(spark, d)))).select("page_id", "node_id", "tag", F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), " ").alias("attributes"), "text")
