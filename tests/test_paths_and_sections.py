"""JSONPath, tree walks, the table function of pages and sections by geometry, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagelathe.operators import elements, jsonpath, sections, tree
from pagelathe.plans import registry


def rows_of(df, path, most=10_000):
    out = {}
    for r in sorted(jsonpath.select(df, "id", "doc", path, most).collect(), key=lambda r: (r.id, r.place)):
        out.setdefault(r.id, []).append(r.value)
    return out


def told(v):
    """A value as the library shows it."""
    return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), sort_keys=True)


def kids(v):
    return [v[k] for k in sorted(v)] if isinstance(v, dict) else v if isinstance(v, list) else []


def below(v):
    return [v, *(x for k in kids(v) for x in below(k))]


def some(rng, depth=0):
    k = rng.random()
    if depth < 4 and k < 0.35:
        return {rng.choice("abcd"): some(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if depth < 4 and k < 0.7:
        return [some(rng, depth + 1) for _ in range(rng.randint(0, 6))]
    return rng.choice([1, 2.5, -3, "x", "y", "", True, False, None])


def number(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def name(v, n):
    return [v[n]] if isinstance(v, dict) and n in v else []


PLAIN = {
    "$": lambda v: [v],
    "$.a": lambda v: name(v, "a"),
    "a.b": lambda v: [y for x in name(v, "a") for y in name(x, "b")],
    "$[*]": kids,
    "$.*.*": lambda v: [y for x in kids(v) for y in kids(x)],
    "$[0]": lambda v: v[:1] if isinstance(v, list) else [],
    "$[-1]": lambda v: v[-1:] if isinstance(v, list) else [],
    "$[1:3]": lambda v: v[1:3] if isinstance(v, list) else [],
    "$[::-1]": lambda v: v[::-1] if isinstance(v, list) else [],
    "$[-3:-1]": lambda v: v[-3:-1] if isinstance(v, list) else [],
    "$[5:0:-2]": lambda v: v[5:0:-2] if isinstance(v, list) else [],
    "$[::0]": lambda v: [],
    "$['b', 'a']": lambda v: name(v, "b") + name(v, "a"),
    "$[1, 'a', -1]": lambda v: (v[1:2] + v[-1:] if isinstance(v, list) else []) + name(v, "a"),
    "$..a": lambda v: [y for x in below(v) for y in name(x, "a")],
    "$..[0]": lambda v: [x[0] for x in below(v) if isinstance(x, list) and x],
    "$..*": lambda v: [y for x in below(v) for y in kids(x)],
    "$.a..b": lambda v: [z for x in name(v, "a") for y in below(x) for z in name(y, "b")],
    "$..[?(@.a > 1)]": lambda v: [y for x in below(v) for y in kids(x) if any(number(z) and z > 1 for z in name(y, "a"))],
    "$[?@.a]": lambda v: [y for y in kids(v) if name(y, "a")],
    "$[?(!@.a && @.b == 'x')]": lambda v: [y for y in kids(v) if not name(y, "a") and name(y, "b") == ["x"]],
    "$[?(@ == null || @ != true && @ < 'y')]": lambda v: [y for y in kids(v) if y is None or (y is not True and isinstance(y, str) and y < "y")],
    "$[?(@.a == @.b)]": lambda v: [y for y in kids(v) if (lambda a, b: (not a and not b) or (bool(a) and bool(b) and not isinstance(a[0], (dict, list)) and (a[0] == b[0] and type(a[0]) is type(b[0]) or number(a[0]) and number(b[0]) and a[0] == b[0])))(name(y, "a"), name(y, "b"))],
}


@pytest.fixture(scope="module")
def shelf(spark):
    rng = random.Random(11)
    docs = [some(rng) for _ in range(120)]
    rows = [(f"{i:03}", json.dumps(v)) for i, v in enumerate(docs)] + [("800", None), ("801", "{bad"), ("802", "[" * 5000 + "]" * 5000), ("803", '{"a":' * 1500 + "1" + "}" * 1500), ("804", "")]
    return dict(zip((f"{i:03}" for i in range(120)), docs)), spark.createDataFrame(rows, "id string, doc string").repartition(4).cache()


@pytest.mark.parametrize("path", sorted(PLAIN))
def test_paths(shelf, path):
    docs, df = shelf
    got = rows_of(df, path)
    want = {k: [told(x) for x in PLAIN[path](v)] for k, v in docs.items()}
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("path", ["$.", "$[", "$[]", "$.a[1", "$[a]", "$[?(@.a >)]", "$[?(1)]", "$[?(@.a > 1]", "$.a b", "$[?(@.a ~ 1)]"])
def test_no_paths(path):
    with pytest.raises(ValueError):
        jsonpath.compiled(path)


def test_brackets_in_names(spark):
    df = spark.createDataFrame([("1", json.dumps({"a]b": {"it's": [1]}, "x.y": 2}))], "id string, doc string")
    assert rows_of(df, r"""$["a]b"]['it\'s'][0]""") == {"1": ["1"]} and rows_of(df, "$['x.y']") == {"1": ["2"]}


def test_walk_of_deep_documents(shelf):
    docs, df = shelf
    got = {}
    for r in jsonpath.walk(df, "id", "doc").collect():
        got.setdefault(r.id, []).append((r.path, r.depth, r.value))
    assert "800" not in got and got["801"] == got["802"] == got["803"] == got["804"] == [("$", 0, None)]
    assert all(sorted(x for _, _, x in got[k]) == sorted(json.dumps(x, separators=(",", ":"), sort_keys=True) for x in below(v)) for k, v in docs.items())
    assert jsonpath.found(df, "id", "doc", "x").where("id >= '800'").count() == 0


def search(v, word, at="$"):
    """The keyword search said plainly."""
    out = []
    if isinstance(v, dict):
        for k in sorted(v):
            out += [(f"{at}.{k}", v[k])] if word in k.lower() else search(v[k], word, f"{at}.{k}")
    elif isinstance(v, list):
        for i, x in enumerate(v[:3]):
            out += search(x, word, f"{at}[{i}]")
    elif isinstance(v, str) and word in v.lower():
        out.append((at, v))
    return out


@pytest.mark.parametrize("word", ["A", "x", ""])
def test_found(shelf, word):
    docs, df = shelf
    got = {}
    for r in sorted(jsonpath.found(df, "id", "doc", word, 4, items=3, most=6).collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append((r.path, r.value, r.n_matches))
    want = {}
    for k, v in docs.items():
        if hits := search(v, word.lower()):
            want[k] = [(p, told(x), min(6, len(hits))) for p, x in hits[:4]]
    assert got == want


def test_walk_stays_in_the_jvm(shelf):
    plan = jsonpath.walk(shelf[1], "id", "doc")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_page_nodes_in_sql(spark):
    elements.register(spark)
    pages = spark.createDataFrame([(1, "<body><p>a<div hidden><b>x</b></div></body>"), (2, None)], "page_id long, html string")
    seen = spark.sql("SELECT p.page_id, n.tag FROM {pages} p, LATERAL page_nodes(p.html, 50, false) n", pages=pages)
    assert [r.tag for r in seen.collect()] == ["body", "p"]
    assert elements.flatten(pages, include_hidden=True).count() == 4 and elements.flatten(pages, max_depth=1).count() == 1


def test_pages_are_parsed_once(spark, sf):
    """No plan parses a page twice: that of the chunks reads the written nodes."""
    for q in ("dom_elements", "dom_layout_tree", "dom_rag_chunks"):
        plan = registry.queries()[q](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("page_nodes") + plan.count("Nodes(") <= 1 and "MapInPandas" not in plan
    assert "Generate" not in registry.queries()["dom_rag_chunks"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().replace("Generate explode", "")


SKIPPED = {"script", "style", "head", "meta", "link", "noscript", "svg", "path", "br", "hr"}


def plain_sections(nodes, page_w, page_h, most, least, splits):
    """Extraction and splitting said plainly, over (tag, width, height, inner length) by node with children."""
    kids = {}
    for n in nodes:
        kids.setdefault(n["parent_id"], []).append(n)
    t = lambda n: n["inner_html_length"] // 4
    ok = lambda n: n["height"] >= 50 and (n["width"] >= 0.2 * page_w or t(n) >= 1000)

    def mains(n):
        c = kids.get(n["node_id"], [])
        if n["tag"] in ("html", "body") or (n["tag"] == "div" and c and n["width"] >= 0.9 * page_w and n["height"] >= 0.9 * page_h):
            return [m for x in c for m in mains(x)]
        return [n]

    def take(n):
        if n["tag"] in SKIPPED:
            return []
        if not ok(n):
            return [m for x in kids.get(n["node_id"], []) for m in take(x)]
        return [n] if t(n) >= least else []

    def cut(n, level):
        fit = [x for x in kids.get(n["node_id"], []) if x["tag"] not in SKIPPED and t(x) >= least and (x["height"] >= 50 or t(x) >= 1000)]
        if t(n) <= most or level >= splits or not fit:
            return [(n["node_id"], t(n), level)]
        return [y for x in fit for y in cut(x, level + 1)]

    return [y for m in mains(nodes[0]) for n in take(m) for y in cut(n, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_sections(spark, seed):
    rng = random.Random(seed)
    rows, pages = [], {}
    for page in range(12):
        nodes = []

        def grow(parent, depth, length):
            me = {"page_id": page, "node_id": len(nodes), "parent_id": parent, "tag": "body" if parent is None else rng.choice(["div", "div", "section", "p", "script", "svg"]), "inner_html_length": length, "width": rng.choice([50.0, 199.0, 200.0, 899.0, 900.0, 1000.0]), "height": rng.choice([10.0, 49.0, 50.0, 900.0, 899.9, 1000.0]), "children_count": 0}
            nodes.append(me)
            while depth < 22 and rng.random() < (0.97 if depth < 18 and page % 4 == 0 else 0.6) and me["children_count"] < 4 and length > 40:
                me["children_count"] += 1
                grow(me["node_id"], depth + 1, int(length * rng.uniform(0.2, 0.99)))
                if page % 4 == 0 and depth > 1:
                    break
            me["subtree_end"] = len(nodes) - 1

        grow(None, 0, rng.choice([3999, 40000, 300000, 44004, 8_000_000]))
        pages[page] = nodes
        rows += nodes
    df = spark.createDataFrame(rows, "page_id long, node_id int, parent_id int, tag string, inner_html_length int, width double, height double, children_count int, subtree_end int")
    found = sections.extract(df, F.lit(1000.0), F.lit(1000.0))
    for splits in (15, 2):
        got = {}
        for r in sections.split(df, found, splits=splits).collect():
            got.setdefault(r.page_id, set()).add((r.node_id, r.tokens, r.level))
        want = {p: set(plain_sections(n, 1000, 1000, 10_000, 50, splits)) for p, n in pages.items()}
        assert got == {p: v for p, v in want.items() if v}


def test_sections_of_odd_nodes(spark):
    schema = "page_id long, node_id int, parent_id int, tag string, inner_html_length int, width double, height double, children_count int, subtree_end int"
    df = spark.createDataFrame([(1, 0, None, "body", None, None, None, 1, 1), (1, 1, 0, "DIV", 4000, None, None, 0, 1), (2, 0, None, "body", 400, 1000.0, 1000.0, 1, 1), (2, 1, 0, "DIV", 400, 1000.0, 60.0, 0, 1)], schema)
    found = sections.extract(df, F.lit(1000.0), F.lit(1000.0))
    assert [(r.page_id, r.node_id, r.level) for r in sections.split(df, found).collect()] == [(2, 1, 0)]
    assert sections.split(df.limit(0), found.limit(0)).count() == 0
    assert tree.topmost(df, F.col("tag") == "DIV").count() == 2


def test_sections_are_split_in_one_plan(spark, sf, tmp_path):
    """Splitting needs no recursion, whose levels the driver holds, and no join."""
    nodes = "page_id long, node_id int, parent_id int, tag string, inner_html_length int, width double, height double, children_count int, subtree_end int"
    df = spark.createDataFrame([(1, i, i - 1 if i else None, "div", 4 * (20_000 - i), 1000.0, 900.0, int(i < 39), 39) for i in range(40)], nodes)
    out = sections.split(df, df.where("node_id = 3"))
    assert [(r.node_id, r.level, r.tokens) for r in out.collect()] == [(18, 15, 19_982)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "UnionLoop" not in plan and "Join" not in plan


def test_matches_are_dealt_by_the_size_of_documents(spark, monkeypatch):
    """More documents are more tasks, not larger ones."""
    monkeypatch.setattr(jsonpath, "SHARE", 100)
    docs = spark.range(100).selectExpr("id", """concat('{"n": ', id, ', "m": [{"n": 1}]}') AS doc""")
    for path, matches in (("$..n", 2), ("$.n", 1)):
        out = jsonpath.select(docs, "id", "doc", path)
        assert out.rdd.getNumPartitions() == 26
        assert out.groupBy("id").count().where(f"count <> {matches}").count() == 0
    assert jsonpath.found(docs, "id", "doc", "n").rdd.getNumPartitions() > 20
    assert jsonpath.select(docs.limit(0), "id", "doc", "$..n").count() == 0
