"""Tree operators over the node table: prefixes and suffixes of the pre-order in place of range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.functions import html as H
from pagelathe.operators.elements import LAYOUT, SEMANTIC, SKIPPED


def _nodes(start: int, end: int) -> Window:
    """A page's nodes in pre-order, from `start` to `end` around a node."""
    return Window.partitionBy("page_id").orderBy("node_id").rowsBetween(start, end)


def topmost(nodes: DataFrame, match: Column) -> DataFrame:
    """Matching nodes without a matching ancestor: no earlier match's subtree reaches them."""
    reach = F.max(F.when(match, F.col("subtree_end"))).over(_nodes(Window.unboundedPreceding, -1))
    return nodes.withColumn("_reach", reach).where(match & (F.coalesce("_reach", F.lit(-1)) < F.col("node_id"))).drop("_reach")


def without_subtrees(nodes: DataFrame, drop: Column) -> DataFrame:
    """Nodes but for those that match and all below them."""
    reach = F.max(F.when(drop, F.col("subtree_end"))).over(_nodes(Window.unboundedPreceding, -1))
    return nodes.withColumn("_reach", reach).where(~drop & (F.coalesce("_reach", F.lit(-1)) < F.col("node_id"))).drop("_reach")


def with_ancestors(nodes: DataFrame, match: Column) -> DataFrame:
    """Matching nodes and their ancestors: the next match, from the node on, lies in its subtree. matched tells them apart."""
    nxt = F.min(F.when(match, F.col("node_id"))).over(_nodes(0, Window.unboundedFollowing))
    return nodes.withColumn("matched", match).withColumn("_next", nxt).where(F.col("_next") <= F.col("subtree_end")).drop("_next")


def body_sections(nodes: DataFrame) -> DataFrame:
    """The body's children: name, type, text, numbers of elements; skipped tags don't count."""
    rows = nodes.where((F.col("depth") == 2) & ~F.col("tag").isin(*SKIPPED))
    w = Window.partitionBy("page_id").orderBy("node_id")
    rows = rows.withColumns({"index": F.row_number().over(w) - 1, "total": F.count("*").over(Window.partitionBy("page_id")), "cls": F.array_join("classes", " ")})
    text = F.when(F.char_length("text_content") >= 200, F.concat("text_content", F.lit("..."))).otherwise(F.col("text_content"))
    return rows.select("page_id", "index", "tag", "selector", H.section_name(F.col("tag"), F.col("cls"), F.col("index")).alias("name"), H.layout_type(F.col("tag"), F.col("cls"), F.col("index"), F.col("total")).alias("type"), text.alias("text"), (F.col("subtree_end") - F.col("node_id") + 1).alias("element_count"), "raw_html_length")


def layout_text(nodes: DataFrame, max_depth: int = 15, max_lines: int = 300) -> DataFrame:
    """An indented tree of layout tags: others go with all below them; lines beyond the first ones are cut."""
    kept = without_subtrees(nodes, ~F.col("tag").isin("body", *LAYOUT, "ul", "li", "p", "h1", "h2", "h3")).where(F.col("depth") <= max_depth)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), "selector")
    rows = kept.groupBy("page_id").agg(F.count("*").alias("nodes"), F.max(F.col("depth") - 1).alias("max_depth"), F.sort_array(F.collect_list(F.struct("node_id", line.alias("line")))).alias("l"))
    return rows.select("page_id", "nodes", "max_depth", F.array_join(F.transform(F.slice("l", 1, max_lines), lambda x: x["line"]), "\n").alias("tree"))


def repeated(nodes: DataFrame, least: int = 10) -> DataFrame:
    """Siblings of one tag and first two classes, `least` or more, with the texts of the first three."""
    key = F.concat_ws(".", "tag", F.slice("classes", 1, 2))
    g = nodes.where("parent_id IS NOT NULL").groupBy("page_id", "parent_id", key.alias("shape")).agg(F.count("*").alias("items"), F.sort_array(F.collect_list(F.struct("node_id", "text_content"))).alias("all"))
    return g.where(F.col("items") >= least).select("page_id", "parent_id", "shape", "items", F.transform(F.slice("all", 1, 3), lambda x: x["text_content"]).alias("examples"))


def technologies(pages: DataFrame, nodes: DataFrame, names: DataFrame | None = None, attributes: int = 50, classes: int = 100) -> DataFrame:
    """(page_id, name, type, confidence) of each page's scripts, its first data attributes and classes, and, where `names` (page_id, names) has them, its global names."""
    found = nodes.select("page_id", "node_id", F.posexplode(F.concat(F.filter(F.map_keys("attributes"), lambda k: k.startswith("data-")), F.transform("classes", lambda c: F.concat(F.lit("."), c)))).alias("k", "v"))
    one = found.groupBy("page_id", "v").agg(F.min(F.struct("node_id", "k")).alias("at"))
    first = lambda css, most: F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.col("v").startswith(".") == css, F.struct("at", "v")))), 1, most), lambda x: x["v"])
    seen = one.groupBy("page_id").agg(first(False, attributes).alias("attributes"), F.transform(first(True, classes), lambda v: F.substring(v, 2, 1_000_000)).alias("classes"))
    urls = F.array_join(F.regexp_extract_all("html", F.lit(r"""(?i)<script[^>]*\ssrc=["']?([^"'\s>]+)"""), F.lit(1)), " ")
    rows = pages.select("page_id", urls.alias("urls")).join(seen, "page_id", "left")
    rows = rows.join(names, "page_id", "left") if names is not None else rows.withColumn("names", F.lit(None).cast("array<string>"))
    tech = F.explode(H.technologies(F.col("urls"), F.col("names"), F.col("attributes"), F.col("classes"))).alias("t")
    return rows.select("page_id", tech).select("page_id", "t.*")


# Words of component classes and how deep components are looked for; style properties of a design with their headings and how many values are named.
COMPONENT_WORDS, COMPONENT_DEPTH = ("card", "button", "btn", "form", "input", "modal", "dropdown", "menu", "tab", "accordion", "slider", "carousel"), 8
DESIGN = (("background-color", "Background Colors", 5), ("color", "Text Colors", 5), ("font-family", "Font Families", 3), ("font-size", "Font Sizes", 8), ("margin", "Margins", 5), ("padding", "Paddings", 5))


def design_chunk(nodes: DataFrame) -> DataFrame:
    """The commonest values of each page's own style attributes, by property."""
    values = nodes.select("page_id", "node_id", F.explode(H.declarations(F.col("style"))).alias("property", "value")).where(F.col("property").isin(*(p for p, _, _ in DESIGN)))
    counted = values.groupBy("page_id", "property", "value").agg(F.count("*").alias("n"), F.min("node_id").alias("first"))
    w = Window.partitionBy("page_id", "property").orderBy(F.desc("n"), "first", "value")
    top = counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(n for _, _, n in DESIGN)).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("r", "property", "value"))).alias("l"))
    lines = []
    for prop, heading, most in DESIGN:
        named = F.array_join(F.transform(F.slice(F.filter("l", _is_property(prop)), 1, most), lambda x: x["value"]), ", ")
        lines.append(F.concat(F.lit(f"{heading}: "), F.coalesce(F.nullif(named, F.lit("")), F.lit("none"))))
    rows = nodes.select("page_id").distinct().join(top, "page_id", "left")
    return rows.select("page_id", F.lit(1).alias("k"), F.lit(0).alias("at"), F.lit("design").alias("type"), F.lit("Design System").alias("name"), F.concat_ws("\n", F.lit("Design System Tokens:"), *lines).alias("embedding_text"))


def _is_property(name: str):
    return lambda x: x["property"] == name


def layout_chunk(nodes: DataFrame, levels: int = 3) -> DataFrame:
    """The elements that matter on a page's upper levels, in order."""
    large = F.lit(10_000)
    rows = nodes.where((F.col("depth") <= levels + 1) & H.is_significant(F.col("tag"), F.col("id"), F.col("classes"), large, large))
    name = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.get("classes", F.lit(0)), F.col("tag"))
    listed = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("node_id", F.concat(name, F.lit(" ("), "tag", F.lit(")")).alias("t")))).alias("l"))
    rows = nodes.select("page_id").distinct().join(listed, "page_id", "left")
    lines = F.transform(F.coalesce("l", F.array().cast("array<struct<node_id:int,t:string>>")), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"]))
    return rows.select("page_id", F.lit(2).alias("k"), F.lit(0).alias("at"), F.lit("layout").alias("type"), F.lit("Page Layout").alias("name"), F.array_join(F.concat(F.array(F.lit("Page Layout Structure:")), lines), "\n").alias("embedding_text"))


def chunks(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, chunk_no, id, type, name, embedding_text): an overview, the design's values, the layout, a chunk for each semantic section and each component, and the links. Numbers run over all types of a page. Static pages have no sizes, so none are asked for."""
    words, hero = F.lower(F.array_join("classes", " ")), "hero|banner"
    tops = topmost(nodes, F.col("tag").isin(*SEMANTIC) | words.rlike(hero) | F.lower(F.coalesce("id", F.lit(""))).contains("hero"))
    counts = nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.min("node_id").alias("first"))
    rank = Window.partitionBy("page_id").orderBy(F.desc("n"), "first")
    top = counts.withColumn("r", F.row_number().over(rank)).where("r <= 10").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("r", F.concat_ws(": ", "tag", F.col("n").cast("string")).alias("t")))).alias("t"))
    title = pages.select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    size = nodes.groupBy("page_id").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))
    overview = title.join(size, "page_id").join(top, "page_id").select("page_id", F.lit(0).alias("k"), F.lit(0).alias("at"), F.lit("overview").alias("type"), F.col("title").alias("name"), F.concat_ws("\n", F.concat(F.lit("Page: "), "title"), F.concat(F.lit("URL: "), "url"), F.concat(F.lit("Elements: "), F.col("n").cast("string")), F.concat(F.lit("Depth: "), F.col("depth").cast("string")), F.concat(F.lit("Tags: "), F.array_join(F.transform("t", lambda x: x["t"]), ", "))).alias("embedding_text"))
    inside = F.col("subtree_end") - F.col("node_id")
    sections = tops.select("page_id", F.lit(3).alias("k"), F.col("node_id").alias("at"), F.lit("section").alias("type"), F.col("selector").alias("name"), F.concat_ws("\n", F.concat(F.lit("Section: "), "tag"), F.concat(F.lit("Selector: "), "selector"), F.concat(F.lit("Elements: "), inside.cast("string")), F.nullif(F.col("text_content"), F.lit(""))).alias("embedding_text"))
    parts = topmost(nodes.where(F.col("depth") <= COMPONENT_DEPTH + 1), F.col("tag").isin("form", "button", "input", "select") | words.rlike("|".join(COMPONENT_WORDS)) | F.col("is_interactive"))
    kind = H.chunk_type(F.col("tag"), F.col("classes"))
    called = H.component_name(F.col("id"), F.col("classes"), F.concat(F.initcap(kind), F.lit(" Component")))
    facts = F.concat(F.lit("Component: "), called), F.concat(F.lit("Type: "), kind), F.concat(F.lit("Tag: "), "tag"), F.concat(F.lit("ID: "), F.nullif(F.col("id"), F.lit(""))), F.when(F.size("classes") > 0, F.concat(F.lit("Classes: "), F.array_join("classes", ", "))), F.concat(F.lit("Interactive: "), F.col("is_interactive").cast("string")), F.concat(F.lit("Text: "), F.nullif(F.col("text_content"), F.lit("")))
    components = parts.select("page_id", F.lit(4).alias("k"), F.col("node_id").alias("at"), F.lit("component").alias("type"), called.alias("name"), F.concat_ws("\n", *facts).alias("embedding_text"))
    w = Window.partitionBy("page_id").orderBy("node_id")
    hrefs = nodes.where((F.col("tag") == "a") & F.element_at("attributes", F.lit("href")).isNotNull()).withColumn("r", F.row_number().over(w)).where("r <= 10")
    assets = hrefs.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("r", F.element_at("attributes", F.lit("href")).alias("h")))).alias("l")).select("page_id", F.lit(5).alias("k"), F.lit(0).alias("at"), F.lit("assets").alias("type"), F.lit("Assets").alias("name"), F.concat(F.lit("Links: "), F.array_join(F.transform("l", lambda x: x["h"]), ", ")).alias("embedding_text"))
    every = overview.unionByName(design_chunk(nodes)).unionByName(layout_chunk(nodes)).unionByName(sections).unionByName(components).unionByName(assets)
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("k", "at"))
    return every.withColumn("chunk_no", number).select("page_id", "chunk_no", F.format_string("chunk_%04d", "chunk_no").alias("id"), "type", "name", "embedding_text")


# Tags that make no component, and the least side of one.
NO_COMPONENT = ("script", "style", "noscript", "meta", "link", "br", "hr", "svg", "path")
LEAST_SIDE = 10


def component_tree(nodes: DataFrame) -> DataFrame:
    """Nodes (page_id, node_id, parent_id, subtree_end, tag, width, height) as components: id by pre-order, parent_id the one around it, emitted its place in post-order, n_children. Skipped and small nodes go with all below them."""
    kept = without_subtrees(nodes, F.lower("tag").isin(*NO_COMPONENT) | (F.col("width") < LEAST_SIDE) | (F.col("height") < LEAST_SIDE))
    page = Window.partitionBy("page_id")
    name = lambda n: F.format_string("comp_%04d", n)
    rows = kept.withColumn("n", F.row_number().over(page.orderBy("node_id"))).withColumn("emitted", F.row_number().over(page.orderBy("subtree_end", F.desc("node_id"))))
    up = rows.select("page_id", F.col("node_id").alias("parent_id"), F.col("n").alias("up"))
    inner = rows.where("parent_id IS NOT NULL").groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"))
    out = rows.join(up, ["page_id", "parent_id"], "left").join(inner, ["page_id", "node_id"], "left")
    return out.select("page_id", "node_id", name(F.col("n")).alias("id"), F.when(F.col("up").isNotNull(), name(F.col("up"))).alias("parent_id"), "emitted", F.coalesce("n_children", F.lit(0)).alias("n_children"), "tag")
