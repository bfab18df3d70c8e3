"""Summaries of pages and JSON documents: main content, skeletons, snapshots, landmarks, formatted values."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.operators.elements import SEMANTIC


def main_content(nodes: DataFrame, share: float = 0.9, rounds: int = 15) -> DataFrame:
    """(page_id, node_id) of where a page's content starts: from the body down through lone children and wrappers of at least `share` of its length, as long as they are html, body or div."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        kids = {k: g for k, g in x.sort_values("node_id").groupby("parent_id")}
        at = x.loc[x["parent_id"].isna()].iloc[0]
        for _ in range(rounds):
            below = kids.get(at["node_id"])
            if below is None:
                break
            wide = below[(below["tag"] == "div") & (below["raw_html_length"] >= share * max(at["raw_html_length"], 1))]
            if at["tag"] not in ("html", "body", "div") or wide.empty:
                break
            at = wide.iloc[0]
        return pd.DataFrame({"page_id": [at["page_id"]], "node_id": [at["node_id"]], "tag": [at["tag"]]})

    return nodes.select("page_id", "node_id", "parent_id", "tag", "raw_html_length").groupBy("page_id").applyInPandas(run, "page_id long, node_id int, tag string")


class Taken:
    """Spans that don't overlap, in order: whether one is free is told by bisection."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        """Take a span if it overlaps none taken before."""
        i = bisect_right(self.starts, start)
        if (i and self.ends[i - 1] > start) or (i < len(self.starts) and self.starts[i] < end):
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def allocate(spans: DataFrame) -> DataFrame:
    """For wanted patterns in order (page_id, seq, starts) with candidate starts, the first start in text order that no earlier one took; null where none is left.

    What comes from the same list of candidates goes on where the last one stopped, so the time is that of sorting.
    Sequential within a page; null and empty lists get null.
    """

    def run(x: pd.DataFrame) -> pd.DataFrame:
        used, out, at, order = set(), [], {}, {}
        for r in x.sort_values("seq", kind="stable").itertuples(index=False):
            key = tuple(r.starts) if r.starts is not None else ()
            own = order.setdefault(key, sorted(key))
            i = at.get(key, 0)
            while i < len(own) and own[i] in used:
                i += 1
            at[key] = i
            start = own[i] if i < len(own) else None
            used.add(start)
            out.append((r.page_id, r.seq, start))
        return pd.DataFrame(out, columns=["page_id", "seq", "start"]).astype({"start": "Int64"})

    return spans.groupBy("page_id").applyInPandas(run, "page_id long, seq long, start long")


def skeletons(nodes: DataFrame, depth: int = 3, kids: int = 5, classes: int = 3, text: int = 50) -> DataFrame:
    """HTML of each page's outline: some levels, children, classes and characters of text.

    Only what an outline can show is gathered: of the upper levels the first children of each node, and how many there are.
    """

    def render(rows):
        below: dict = {}
        for n in sorted(rows, key=lambda n: n["node_id"]):
            below.setdefault(n["parent_id"], []).append(n)

        def one(n, level: int) -> str:
            own = below.get(n["node_id"], [])
            more = own[0]["siblings"] - kids if own else 0
            cls = f' class="{" ".join(n["classes"])}"' if n["classes"] else ""
            inner = "..." if own and level >= depth else "".join(one(k, level + 1) for k in own[:kids]) + (f"<!-- {more} more -->" if more > 0 else "")
            return f"<{n['tag']}{cls}>{n['text']}{inner}</{n['tag']}>"

        return one(below[None][0], 1)

    # all windows and groups are within pages, which are dealt out once
    upper = nodes.where(F.col("depth") <= depth + 1).select("page_id", "node_id", "parent_id", "tag", F.slice("classes", 1, classes).alias("classes"), F.left("text_content", F.lit(text)).alias("text")).repartition("page_id")
    own = Window.partitionBy("page_id", "parent_id")
    first = upper.withColumns({"place": F.row_number().over(own.orderBy("node_id")), "siblings": F.count("*").over(own)}).where(F.col("place") <= max(kids, 1))
    shown = F.collect_list(F.struct("node_id", "parent_id", "tag", "classes", "text", "siblings"))
    return first.groupBy("page_id").agg(shown.alias("rows")).select("page_id", F.udf(render, "string")("rows").alias("skeleton"))


def snapshot(nodes: DataFrame, depth: int = 6) -> DataFrame:
    """Compact rows of a page's upper levels: no scripts and styles, attribute values cut at 100 characters."""
    kept = nodes.where((F.col("depth") <= depth) & ~F.col("tag").isin("script", "style", "noscript"))
    return kept.select("page_id", "node_id", "parent_id", "tag", F.transform_values("attributes", lambda k, v: F.when(F.char_length(v) > 100, F.concat(F.left(v, F.lit(100)), F.lit("..."))).otherwise(v)).alias("attributes"), F.left("text_content", F.lit(200)).alias("text"))


def visible_text(nodes: DataFrame) -> DataFrame:
    """Visible elements, and texts of over two characters joined and cut at 1000; whether that is content."""
    t = F.when(F.char_length("text_content") > 2, F.struct("node_id", F.col("text_content").alias("t")))
    g = nodes.where("is_visible").groupBy("page_id").agg(F.count("*").alias("elements"), F.sort_array(F.collect_list(t)).alias("l"))
    text = F.left(F.array_join(F.transform("l", lambda x: x["t"]), " "), F.lit(1000))
    return g.select("page_id", "elements", text.alias("text")).withColumn("has_content", (F.col("elements") > 5) | (F.char_length("text") > 50))


def landmarks(nodes: DataFrame) -> DataFrame:
    """The first node of each landmark on a page."""
    return nodes.where(F.col("tag").isin(*SEMANTIC)).groupBy("page_id", "tag").agg(F.min("node_id").alias("node_id"), F.min_by("selector", "node_id").alias("selector"))


def joined_css(sheets: DataFrame) -> DataFrame:
    """(page_id, url, seq, content) joined by page, each under a line that names it."""
    part = F.concat(F.lit("/* === "), F.coalesce("url", F.lit("inline")), F.lit(" === */\n"), "content")
    return sheets.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", part.alias("c")))), lambda x: x["c"]), "\n\n").alias("css"))


def styling(classes: Column, scripts: Column) -> Column:
    """C20: how a page is styled, by its class names and script addresses, the first that fits."""
    has = lambda p: F.exists(classes, lambda c: c.rlike(p))
    return F.when(has(r"^(sc-|styled-)"), "styled-components").when(has(r"^css-[a-z0-9]+$"), "emotion").when(has(r"^_?[A-Za-z]+_[A-Za-z]+__[A-Za-z0-9]{5}$"), "css-modules").when(F.exists(scripts, lambda s: s.contains("tailwind")) | has(r"^(flex|grid|p-\d|m-\d)$"), "tailwind").otherwise("css")


def todos(rows: DataFrame, status: str | None = None, least: int | None = None, completed: bool = True) -> DataFrame:
    """todos by status and least priority, the urgent ones first within their status."""
    if status:
        rows = rows.where(F.col("status") == status)
    if least is not None:
        rows = rows.where(F.col("priority") >= least)
    if not completed:
        rows = rows.where(F.col("status") != "completed")
    w = Window.partitionBy("status").orderBy(F.desc("priority"), "id")
    return rows.withColumn("place", F.row_number().over(w))


def subset(doc: Column, keys: tuple[str, ...]) -> tuple[Column, Column]:
    """The object with the keys that it has of those asked for, and the list of the others."""
    m = F.from_json(doc, "map<string,string>")
    want = F.array(*map(F.lit, keys))
    return F.map_filter(m, lambda k, v: k.isin(*keys)), F.array_except(want, F.map_keys(m))


def formatted(value: Column, most: int = 500) -> Column:
    """A JSON value as text for a reader: long ones are cut, with their length."""
    return F.when(value.isNull(), "null").when(F.char_length(value) > most, F.concat(F.left(value, F.lit(most)), F.lit("... ("), F.char_length(value).cast("string"), F.lit(" chars)"))).otherwise(value)


def sections_of(components: DataFrame) -> DataFrame:
    """Components (page_id, index, id, name, y, width, height, links_in, links_out) as sections: missing rectangles are rows of 400 over the whole width, links are tagged and joined, dashes in ids become underscores."""
    tag = lambda c, kind: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda u: F.struct(u.alias("url"), F.lit(kind).alias("kind")))
    return components.select(
        "page_id",
        F.replace("id", F.lit("-"), F.lit("_")).alias("id"),
        F.coalesce("name", "id").alias("name"),
        F.coalesce("y", F.col("index") * 400.0).alias("y"),
        F.coalesce("width", F.lit(1920.0)).alias("width"),
        F.coalesce("height", F.lit(400.0)).alias("height"),
        F.concat(tag(F.col("links_in"), "internal"), tag(F.col("links_out"), "external")).alias("links"),
    )


def component_stats(components: DataFrame) -> DataFrame:
    """Of each page's components (page_id, type, n_links, n_images, tokens): number, numbers by type, sums, and the mean tokens rounded down."""
    by = components.groupBy("page_id", "type").agg(F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("n_links", "n_images", "tokens")))
    sums = (F.sum(c).alias(f"total_{c}") for c in ("n_links", "n_images", "tokens"))
    out = by.groupBy("page_id").agg(F.sum("n").alias("components"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type"), *sums)
    return out.withColumn("avg_tokens", F.floor(F.col("total_tokens") / F.col("components")))


def image_users(components: DataFrame) -> DataFrame:
    """(page_id, url, ids): the components (page_id, id, images) that show each image, by id."""
    return components.select("page_id", "id", F.explode(F.array_distinct("images")).alias("url")).groupBy("page_id", "url").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def component_html(components: Column, index: Column) -> Column:
    """P10: of an array of components (full_html, located_html, raw_html) the HTML of the one at an index: the first of the three that isn't empty; null out of bounds or without any."""
    own = F.get(components, index)
    return F.coalesce(*(F.nullif(own[c], F.lit("")) for c in ("full_html", "located_html", "raw_html")))


# How many variables, colours and fonts a page's styles show.
STYLE_CAPS = {"variables": 50, "colors": 20, "fonts": 10}


def page_styles(styles: DataFrame) -> DataFrame:
    """Of pages' lists of variables, colors and fonts the first ones."""
    return styles.withColumns({c: F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n) for c, n in STYLE_CAPS.items()})


def spacing_scale(spacing: DataFrame, most: int = 10) -> DataFrame:
    """(page_id, step, size) from (page_id, margins, paddings): the distinct numbers of both in order, the first ones, in pixels, steps from 0."""
    sizes = F.array_sort(F.array_compact(F.array_union(F.coalesce("margins", F.array().cast("array<double>")), F.coalesce("paddings", F.array().cast("array<double>")))))
    return spacing.select("page_id", F.posexplode(F.slice(sizes, 1, most)).alias("step", "value")).select("page_id", "step", F.concat(F.regexp_replace(F.col("value").cast("string"), r"\.0$", ""), F.lit("px")).alias("size"))


def replay_stats(events: DataFrame) -> DataFrame:
    """Of each recording (replay_id, ts_ms, type, workers array): sections of its first spawn, files written, whole seconds to its last event."""
    first = F.min_by(F.size("workers"), F.when(F.col("type") == "worker_spawned", F.struct("ts_ms", "seq")))
    return events.groupBy("replay_id").agg(F.coalesce(first, F.lit(0)).alias("sections"), F.count_if(F.col("type") == "file_written").alias("files"), F.floor(F.max("ts_ms") / 1000).alias("duration_seconds"))


def raw_positions(pages: DataFrame, wanted: DataFrame, prefix: int = 200, reach: int = 1000) -> DataFrame:
    """(page_id, seq, char_start, char_end) of elements (page_id, seq, html, tag, id, classes) in their page's raw HTML (page_id, html).

    Tried in turn, in either case: the element's own beginning, where it has over 50 characters; its tag with its id; with
    its first class, unless that starts with a digit; its tag alone. The first place that overlaps none taken before, in
    order of seq, counts; 0 and 0 where there is none. Each pattern is searched for once in a page: a place that was
    taken stays taken, so the next element of a pattern goes on where the last one stopped. Sequential within a page.
    """

    def patterns(r):
        tag = re.escape(r.tag or "")
        if r.html and len(r.html) > 50:
            yield re.escape(r.html[:prefix].strip()), len(r.html)
        if tag and r.id:
            yield rf"""<{tag}[^>]*id=["']?{re.escape(r.id)}["']?[^>]*>""", None
        first = r.classes[0] if r.classes is not None and len(r.classes) else ""
        if tag and first and not first[0].isdigit():
            yield rf"""<{tag}[^>]*class=["'][^"']*{re.escape(first)}[^"']*["'][^>]*>""", None
        if tag:
            yield f"<{tag}[^>]*>", None

    def spans(raw: str, tag: str, pattern: str, size: int | None):
        """The places of a pattern in order. The next end tag is looked for only once the last one found is passed."""
        close = -2
        for m in re.finditer(pattern, raw, re.IGNORECASE):
            end = m.start() + (size or reach)
            if size is None:
                if close != -1 and close <= m.start():
                    close = raw.find(f"</{tag}>", m.start())
                if close > m.start():
                    end = close + len(tag) + 3
            if (span := (m.start(), min(end, len(raw)))) != (0, 0):
                yield span

    def run(raw: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        html, taken, out, searches = (raw["html"].iloc[0] or "") if len(raw) else "", Taken(), [], {}
        for r in x.sort_values("seq", kind="stable").itertuples(index=False):
            found = (0, 0)
            for pattern, size in patterns(r):
                search = searches.setdefault((r.tag, pattern, size), spans(html, r.tag, pattern, size))
                if found := next((s for s in search if taken.take(*s)), None):
                    break
            out.append((r.page_id, r.seq, *(found or (0, 0))))
        return pd.DataFrame(out, columns=["page_id", "seq", "char_start", "char_end"])

    sides = pages.select("page_id", "html").groupBy("page_id").cogroup(wanted.select("page_id", "seq", "html", "tag", "id", "classes").groupBy("page_id"))
    return sides.applyInPandas(run, "page_id long, seq long, char_start long, char_end long")
