"""Operators outside the optional subpackage: fixtures worked out by hand, properties, streams against batches, and SQL."""

import json
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagelathe.functions import html as H
from pagelathe.functions import text as X
from pagelathe.operators import elements, files, jsonpath, jsonq, logs, memory, rects, stores, tree
from pagelathe.plans import registry
from pagelathe.streaming import queries as streams

PAGE = '<!DOCTYPE html><html><head><title>T</title></head><body><header id="top"><a href="/x">go</a></header><ul class="l"><li class="card item">a<li class="card item">b</ul><div class="9x hero-box" style="display:none"><p>hidden</p></div><p>one<p>two<br>three</body></html>'


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in values.items()))
    return df.select(expr.alias("r")).first().r


def test_flatten(spark):
    nodes = elements.flatten(spark.createDataFrame([(1, PAGE), (2, None), (3, "no body")], "page_id long, html string")).collect()
    assert {n.page_id for n in nodes} == {1}
    by = {n.xpath: n for n in nodes}
    assert [n.xpath for n in sorted(nodes, key=lambda n: n.node_id)] == ["/body", "/body/header[1]", "/body/header[1]/a[1]", "/body/ul[1]", "/body/ul[1]/li[1]", "/body/ul[1]/li[2]", "/body/p[1]", "/body/p[2]", "/body/p[2]/br[1]"]
    assert by["/body"].children_count == 5 and by["/body"].depth == 1 and by["/body/header[1]"].selector == "#top" and by["/body/ul[1]/li[1]"].selector == "li.card"
    assert by["/body/p[2]"].text_content == "twothree" and by["/body/header[1]/a[1]"].is_interactive
    everything = elements.flatten(spark.createDataFrame([(1, PAGE)], "page_id long, html string"), include_hidden=True)
    assert everything.where("xpath = '/body/div[1]/p[1]'").count() == 1 and everything.where("selector = 'div.hero-box'").count() == 1


def test_deep_nodes(spark):
    """Whole trees, however deep; a depth cuts them only where it is given."""
    page = spark.createDataFrame([(1, "<body>" + "<div><b></b>" * 300)], "page_id long, html string")
    nodes = elements.flatten(page)
    assert nodes.count() == 601 and nodes.agg({"depth": "max"}).first()[0] == 302
    assert nodes.where("node_id = 600").first().xpath == "/body" + "/div[1]" * 300 + "/b[1]"
    assert elements.flatten(page, max_depth=50).agg({"depth": "max"}).first()[0] == 50


def test_references_end_with_semicolons(spark):
    """Texts and attributes keep ampersands that begin no reference with a semicolon."""
    html = '<body><h1>a &amp;&amp; b&amp</h1><a href="?x=1&copy=2&amp;y=3">&#65;&#x42;&#67 &no; &ampx; &amp;lt;\ue000</a>'
    by = {n.tag: n for n in elements.flatten(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()}
    assert by["h1"].text_content == "a && b&amp" and by["a"].attributes["href"] == "?x=1&copy=2&y=3"
    assert by["a"].text_content == "AB&#67 &no; &ampx; &lt;\ue000"


def test_nested_sets(spark, sf):
    n = elements.flatten(spark.read.parquet(f"{sf}/pages.parquet")).toPandas()
    for _, p in n.groupby("page_id"):
        end = dict(zip(p.node_id, p.subtree_end, strict=True))
        assert all(pd.isna(a) or (a < i and end[i] <= end[a]) for i, a in zip(p.node_id, p.parent_id, strict=True))
        assert (p.subtree_end >= p.node_id).all() and p.depth.min() == 1 and (p.depth == 1).sum() == 1


def test_tree_operators(spark):
    nodes = elements.flatten(spark.createDataFrame([(1, PAGE)], "page_id long, html string")).cache()
    assert [r.tag for r in tree.topmost(nodes, F.col("tag").isin("ul", "li", "a")).orderBy("node_id").collect()] == ["a", "ul"]
    assert [r.tag for r in tree.with_ancestors(nodes, F.col("tag") == "li").orderBy("node_id").collect()] == ["body", "ul", "li", "li"]
    assert [r.tag for r in tree.without_subtrees(nodes, F.col("tag") == "ul").orderBy("node_id").collect()] == ["body", "header", "a", "p", "p", "br"]
    assert [(r.name, r.element_count) for r in tree.body_sections(nodes).orderBy("index").collect()] == [("header", 2), ("section_1", 3), ("section_2", 1), ("section_3", 2)]
    assert tree.repeated(nodes, 2).select("shape", "items").collect()[0] == ("li.card.item", 2)
    assert tree.layout_text(nodes).first().tree.split("\n")[1] == "  #top"
    page = spark.createDataFrame([(1, "http://a.b/c", PAGE)], "page_id long, url string, html string")
    chunks = tree.chunks(page, nodes).orderBy("chunk_no").collect()
    assert [c.type for c in chunks] == ["overview", "design", "layout", "section", "component", "component", "component", "assets"] and len({c.id for c in chunks}) == 8
    assert chunks[1].embedding_text.split("\n")[2] == "Text Colors: none" and chunks[2].embedding_text == "Page Layout Structure:\n1. top (header)\n2. card (li)\n3. card (li)" and chunks[5].embedding_text.startswith("Component: Card\nType: card\nTag: li\nClasses: card, item")
    tech = spark.createDataFrame([(1, '<body data-v-1="x"><script src="/vue.js"></script><script src="/jquery.js"></script></body>')], "page_id long, html string")
    assert [(r.name, r.confidence) for r in tree.technologies(tech, elements.flatten(tech)).collect()] == [("Vue", 50)]


@pytest.mark.parametrize(("n", "cut"), [(199, False), (200, True)])
def test_long_styles(spark, n, cut):
    assert ("LONG_STYLES" in one(spark, H.token_html(F.col("h")), h=f'<a style="{"x" * n}">')) == cut


@pytest.mark.parametrize(("n", "cut"), [(499, False), (500, True)])
def test_long_srcset(spark, n, cut):
    assert ("[SRCSET]" in one(spark, H.token_html(F.col("h")), h=f'<img srcset="{"x" * n}">')) == cut


def test_cleaners(spark):
    html = "<!doctype html><!-- a --><body> <script>x</script><svg a><b/></svg><p>hi</p>\n \n \nx</body>"
    assert one(spark, H.section_html(F.col("h")), h=html) == "<svg a><b/></svg><p>hi</p>\n\nx"
    once = one(spark, H.token_html(F.col("h")), h=html)
    assert once == one(spark, H.token_html(F.col("h")), h=once) and "<svg>[SVG]</svg>" in once
    assert one(spark, H.example_html(F.col("h")), h=f'<svg>x</svg><i title="{"t" * 120}" data-z="{"d" * 500}">') == f'<!-- svg --><i title="{"t" * 100}...">'


@pytest.mark.parametrize(("url", "want"), [("/a", "http://h.x/a"), ("//c.d/e", "https://c.d/e"), ("a/b", "http://h.x/p/a/b"), ("#t", "#t"), ("{x}", "{x}"), ("mailto:a", "mailto:a"), ("https://z/", "https://z/"), ("", "")])
def test_resolve(spark, url, want):
    assert one(spark, X.resolve_url(F.col("u"), F.col("b")), u=url, b="http://h.x/p/?q=1") == want


def test_text_functions(spark):
    assert one(spark, X.quote(F.col("u")), u="a b*~/é") == "a%20b%2A~%2F%C3%A9"
    assert one(spark, X.proxied(F.col("u"), "/p?u="), u="//a/b") == "/p?u=https%3A%2F%2Fa%2Fb"
    assert one(spark, X.byte_label(F.col("n")), n=1536) == "1.5 KB" and one(spark, X.byte_label(F.col("n")), n=0) == "0 B"
    assert one(spark, X.pascal(F.col("s")), s="hero-banner_two x") == "HeroBannerTwoX"
    assert one(spark, X.display_name(F.col("s")), s="mainNav-bar") == "Main Nav Bar"
    assert one(spark, X.strip_ansi(F.col("s")), s="\x1b[31mred\x1b[0m\r") == "red"
    assert one(spark, X.clean_title(F.col("s")), s="Home page | Site") == "Home page"
    assert one(spark, X.content_kind(F.col("s")), s="a/b.woff2") == "font" and one(spark, X.content_kind(F.col("s")), s="text/html") == "document"
    at = one(spark, X.location(F.col("s")), s="Error in /src/a.jsx:12:5")
    assert (at.file, at.line, at.column) == ("/src/a.jsx", 12, 5)
    assert one(spark, H.color_hex(F.col("s")), s="rgb(1, 2, 255)") == "#0102FF" and one(spark, H.color_hex(F.col("s")), s="red") == "red"
    assert one(spark, H.first_font(F.col("s")), s='"Open Sans", Arial') == "Open Sans"
    assert one(spark, H.declarations(F.col("s")), s="a: b; c; d:e:f; a:z") == {"a": "z", "d": "e:f"}
    assert one(spark, H.is_transparent(F.col("s")), s="rgba(0, 0, 0, 0)")
    h = 0
    for c in "Cannot find":
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    assert one(spark, X.string_hash(F.col("s")), s="Cannot find") == f"{abs(h - (1 << 32) if h >= 1 << 31 else h):x}"


def rect_frame(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r[:4]), r[4] if len(r) > 4 else 0, 1000.0, 1000.0) for i, r in enumerate(rows)], "page_id long, id long, x double, y double, w double, h double, tokens long, page_width double, page_height double")


def test_rect_thresholds(spark):
    r = rect_frame(spark, [(0, 0, 10, 10), (0, 0, 10, 10.1), (600, 600, 5, 5)])
    assert [tuple(x)[1:3] for x in rects.overlaps(r).collect()] == [] and len(rects.overlaps(r, 99).collect()) == 1
    rows = {x.id: x.row_no for x in rects.rows(rect_frame(spark, [(0, 0, 10, 100), (20, 70, 10, 100), (40, 139, 10, 100)])).collect()}
    assert rows == {0: 1, 1: 2, 2: 3 - 1}
    gaps = {x.id: (x.top, x.bottom) for x in rects.merge_gaps(rect_frame(spark, [(0, 5, 1, 95), (0, 130, 1, 70), (0, 231, 1, 69)])).collect()}
    assert gaps == {0: (0.0, 100.0), 1: (130.0, 215.5), 2: (215.5, 1000.0)}
    kept = [x.id for x in rects.remove_overlaps(rect_frame(spark, [(0, 0, 10, 10, 5), (0, 1, 10, 10, 9), (0, 40, 10, 10, 1), (5, 40, 10, 10, 2)])).orderBy("place").collect()]
    assert kept == [1, 2, 3]
    assert rects.coverage(rect_frame(spark, [(0, 0, 800, 1000)])).first().warning is False


@pytest.mark.parametrize("seed", range(40))
def test_diff(seed):
    rng = random.Random(seed)
    a = [rng.choice("abc") for _ in range(rng.randrange(9))]
    b = [rng.choice("abc") for _ in range(rng.randrange(9))]
    for f in (files.diff, files._ahead):
        d = f(a, b)
        assert [x for t, x, *_ in d if t != "added"] == a and [x for t, x, *_ in d if t != "removed"] == b
        assert sum(t == "added" for t, *_ in d) - sum(t == "removed" for t, *_ in d) == len(b) - len(a)
    assert files.diff(a, a) == [("same", x, i, i) for i, x in enumerate(a, 1)]


def plain_lcs(a, b):
    """The longest common subsequence's length by its definition."""
    if not a or not b:
        return 0
    return 1 + plain_lcs(a[:-1], b[:-1]) if a[-1] == b[-1] else max(plain_lcs(a[:-1], b), plain_lcs(a, b[:-1]))


@pytest.mark.parametrize("seed", range(12))
def test_diff_is_shortest(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
    assert sum(t == "same" for t, *_ in files.diff(a, b)) == plain_lcs(a, b)


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        ("abc", "axc", "=a -b +x =c"),  # neither side has the other's line: changed one for one
        ("ab", "xyab", "+x +y =a =b"),
        ("xyab", "ab", "-x -y =a =b"),
        ("pq", "qp", "+q =p -q"),  # as far on both sides: the new side's lines come first
        ("p12q", "qp", "+q =p -1 -2 -q"),
        ("a" + "0123456789" + "b", "b", "-a -0 -1 -2 -3 -4 -5 -6 -7 -8 -9 -b".replace("-a", "-a +b", 1)),  # ten lines ahead is too far
        ("", "ab", "+a +b"),
        ("ab", "", "-a -b"),
    ],
)
def test_diff_ahead(old, new, want):
    sign = {"same": "=", "added": "+", "removed": "-"}
    assert " ".join(sign[t] + x for t, x, *_ in files._ahead(list(old), list(new))) == want


def plain_keep(rows, ratio):
    """Overlap removal one by one."""
    kept = []
    for r in sorted(rows, key=lambda r: (r["y"], r["x"], r["id"])):
        for o in kept:
            w = min(r["x"] + r["w"], o["x"] + o["w"]) - max(r["x"], o["x"])
            h = min(r["y"] + r["h"], o["y"] + o["h"]) - max(r["y"], o["y"])
            least = min(r["w"] * r["h"], o["w"] * o["h"])
            if w > 0 and h > 0 and least > 0 and w * h / least > ratio:
                if r["tokens"] > o["tokens"]:
                    kept.remove(o)
                    kept.append(r)
                break
        else:
            kept.append(r)
    return [r["id"] for r in kept]


@pytest.mark.parametrize("ratio", [0.2, 0.5, 0.9])
def test_keep_by_brute_force(spark, ratio):
    rng = random.Random(3)
    rows = [dict(page_id=i % 4, id=i, x=float(rng.randrange(60)), y=float(rng.randrange(90)), w=float(rng.choice((0, 5, 12, 30))), h=float(rng.choice((0, 4, 16))), tokens=rng.randrange(5), page_width=100.0, page_height=100.0) for i in range(600)]
    got = rects.remove_overlaps(spark.createDataFrame(rows), ratio).orderBy("page_id", "place").collect()
    for page in range(4):
        assert [r.id for r in got if r.page_id == page] == plain_keep([r for r in rows if r["page_id"] == page], ratio)


def test_nearest(spark):
    """Brute force over selectors with crowded, missing and far stretches, and ties."""
    rng = random.Random(5)
    rows = [(s, i, float(rng.choice((rng.randrange(300), 5000, -900)))) for i, s in enumerate(rng.choice("aab") for _ in range(300))] + [("d", 999, 7.0)]
    wanted = [(s, float(t)) for s in "abcd" for t in (-2000, -900, 0, 63, 64, 65, 100.5, 149, 2600, 5000, 9000)]
    got = {(r.selector, r.target): r.id for r in rects.nearest(spark.createDataFrame(wanted, "selector string, target double"), spark.createDataFrame(rows, "selector string, id long, y double")).collect()}
    want = {(s, t): min((abs(y - t), i) for o, i, y in rows if o == s)[1] for s, t in wanted if s != "c"}
    assert got == want


def test_diffs_of_pairs(spark):
    """Each pair of texts is diffed by itself: none waits in a batch of pandas or Arrow; nulls are empty."""
    pairs = spark.createDataFrame([("a", "x\ny", "x\nz"), ("b", None, "q"), ("c", "", None)], "path string, old string, new string")
    out = files.diffs(pairs)
    assert sorted(map(tuple, out.collect())) == [("a", 0, "same", "x", 1, 1), ("a", 1, "removed", "y", 2, None), ("a", 2, "added", "z", None, 2), ("b", 0, "removed", "", 1, None), ("b", 1, "added", "q", None, 1), ("c", 0, "same", "", 1, 1)]
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_long_diff():
    a = [str(i) for i in range(1001)]
    assert [x for x in files.diff(a, a[:500] + ["new"] + a[500:]) if x[0] != "same"] == [("added", "new", None, 501)]


def test_files(spark):
    f = spark.createDataFrame([("/s/a.js", "import x from './b'\nimport y from './gone'\nimport z from '@o/p/q'\nrequire('left')"), ("/s/b.ts", "import {k} from '../c'\nfrom 'react'"), ("/c/index.jsx", "ok")], "path string, content string")
    assert sorted(map(tuple, files.unresolved_imports(f).collect())) == [("/s/a.js", "./gone")]
    assert sorted(r.name for r in files.undeclared_packages(f, spark.createDataFrame([("left",)], "name string")).collect()) == ["@o/p"]
    assert {(r.node, r.is_file, r.files) for r in files.tree(f).collect()} == {("s", False, 2), ("c", False, 1), ("s/a.js", True, 1), ("s/b.ts", True, 1), ("c/index.jsx", True, 1)}
    assert one(spark, files.read_lines(F.col("s"), 2, -2), s="1\n2\n3\n4") == "2\n3"
    assert one(spark, files.replaced(F.col("s"), "a", "b"), s="aa") is None and one(spark, files.replaced(F.col("s"), "a", "b", True), s="aa") == "bb"
    assert one(spark, files.numbered(F.col("s")), s="x\ny") == "   1 x\n   2 y"
    assert one(spark, F.col("p").rlike(X.glob_regex("/src/*.js")), p="/src/a/b.js")


def test_json(spark):
    assert [jsonq.normal_path(p) for p in ("$.a.b[0]", "a.b[0]", "a/b/0", "$")] == ["$.a.b[0]"] * 3 + ["$"]
    with pytest.raises(ValueError, match="no path"):
        jsonq.normal_path("a..b")
    doc = {"a": [{"b": i} for i in range(40)], "name": "x", "list": list(range(200))}
    df = spark.createDataFrame([("1", json.dumps(doc)), ("2", None), ("3", "{bad")], "id string, doc string")
    r = jsonq.matches(df, "doc", "$.a[*].b").where("id = '1'").first()
    assert (r.n_matches, len(r.shown)) == (40, 30)
    w = jsonpath.walk(df, "id", "doc").where("id = '1'")
    assert w.count() == 1 + 3 + 40 * 2 + 200 and w.where("path = '$.a[3].b'").first().value == "3"
    hits = spark.createDataFrame([("1", json.dumps({"Key": {"key": 1}, "v": ["akeyb"] * 120}))], "id string, doc string")
    first = jsonpath.found(hits, "id", "doc", "key", 1).first()
    assert (first.path, first.value, first.n_matches) == ("$.Key", '{"key":1}', 50) and jsonpath.found(hits, "id", "doc", "KEY", 500, most=500).count() == 101
    assert [jsonq.describe(x) for x in ({"a": 1}, [1], "ab", None, True, 1)] == ["object (1 keys) - keys: a", "array (1 items)", "string (2 chars)", "null", "boolean", "number"]
    assert [jsonq.infer(x) for x in (None, True, [1], [])] == ["string | null", "boolean", "number[]", "any[]"]
    assert jsonq.truncate({"a": "x" * 501, "b": list(range(11))}) == {"a": "x" * 500 + "…(501 chars)", "b": [*range(10), "…(11 items)"]}
    assert jsonq.find_field(["img_url", "title"], ["title", "url"]) == "title" and jsonq.find_field(["img_url"], ["url"]) == "img_url"


def test_stores(spark):
    e = spark.createDataFrame([(i, f"2024-01-01 00:{i:02}:00", 10) for i in range(30)], "id long, t string, size long").withColumn("ts", F.to_timestamp("t")).withColumn("last_accessed", F.col("ts"))
    now = F.lit("2024-01-01 00:30:00").cast("timestamp")
    assert stores.live(e, now, 600).count() == 9 and stores.live(e, now, 600, strict=True).count() == 10
    assert sorted(r.id for r in stores.byte_budget(e, 35).collect()) == [27, 28, 29]
    assert sorted(r.id for r in stores.capacity(e, 2, "id").collect()) == [28, 29]


def test_memory_bound(spark):
    m = spark.createDataFrame([(1, t, "system" if t == 0 else "user", "x" * 40) for t in range(25)], "conv_id long, turn long, role string, text string")
    assert memory.recent(m, 10).where("kept").count() == 11
    assert [r.state for r in memory.running(m, 100).orderBy("turn").collect()][:10] == ["ok"] * 5 + ["warn", "warn", "error", "error", "compact"]
    assert memory.compact(m, 10).first().compacted == 14 and memory.compact(m, 30).count() == 0


def test_severity(spark):
    s = spark.createDataFrame([(1, "HIGH")] * 2 + [(2, "HIGH")] * 3 + [(3, "LOW"), (4, "CRITICAL")], "k long, severity string")
    assert {r.k: r.severity for r in logs.overall_severity(s, ["k"]).collect()} == {1: "HIGH", 2: "CRITICAL", 3: "LOW", 4: "CRITICAL"}


def drain(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(40)
    q.stop()  # one with timeouts would go on
    return df.sparkSession.table(name)


def test_streams(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    u = s.select(F.col("user_id").alias("key"), (F.col("event_id") * 31 % 97).alias("version"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    held = drain(streams.versions(u), "update", "versions")
    top = held.groupBy("key").agg(F.max("version").alias("v"))
    assert {tuple(r) for r in top.collect()} == {tuple(r) for r in e.groupBy("user_id").agg(F.max(F.col("event_id") * 31 % 97)).collect()}
    p = drain(streams.phases(s), "update", "phases").groupBy("user_id").agg(F.max("progress").alias("p"))
    assert p.count() == e.select("user_id").distinct().count()
    assert drain(streams.first_seen(s, ["user_id", "event_type"], "60 days"), "append", "seen").count() == e.select("user_id", "event_type").distinct().count()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(pd.Timestamp(v).tz_localize(None)) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if sql := registry.oracle_sql().get(name):
        r = duck.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == columns
        order = sorted(range(len(names)), key=lambda i: names[i])
        want = sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=str)
        assert [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in x) for x in rows] == [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or v.__class__.__name__ == "Decimal" else str(v) for v in x) for x in want]
