"""Style sheets printed and parsed again, addresses against the standard library, allocation of ranges against plain search."""

import random
import re
import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagelathe.functions import urls
from pagelathe.operators import css, summary

VALUES = ["red", '"}"', "'{;'", r'"\"}"', "url(a;b{c}.png)", "url('x)y')", "rgb(1, 2, 3)", "calc(1px + (2 * 3px))", "a/b", '"/* no */"', r"\;x", "u", "1px\\}"]
PRELUDES = ["a", ".b > c", "&:hover", '[d="}"]', "e:not(.f, .g)", "h::before", ":root", "u l"]
ATS = ["@media (min-width: 1px)", "@supports (display: grid) and (not (a: b))", "@layer x", "@font-face", "@keyframes k", "@-webkit-keyframes k", "@page :first"]


def sheet(rng, out, conditions, outer, depth, top):
    """A random sheet's text; its rows go to `out` in order."""
    text = []
    gap = lambda: rng.choice(["", " ", "\n", "/* } { ; \" ' */", "/**/"])
    for _ in range(rng.randint(1, 4)):
        if top and rng.random() < 0.15:
            said = rng.choice(['@import "a;b"', "@charset 'x'", "@layer a, b"])
            out.append([len(out), said.split()[0], said, conditions, []])
            text.append(f"{gap()}{said};")
            continue
        at = rng.random() < 0.4
        prelude = rng.choice(ATS if at else PRELUDES)
        row = [len(out), prelude.split()[0].split("(")[0] if at else "", prelude if at else " ".join([*outer, prelude]), conditions, []]
        out.append(row)
        body = []
        for _ in range(rng.randint(0, 3)):
            key, value = rng.choice(["color", "--x", "content", "transition"]), rng.choice(VALUES)
            row[4].append((key, value))
            body.append(f"{gap()}{key}{rng.choice(['', ' '])}:{gap()}{value}{gap()};")
        inner = ""
        if depth < 3 and rng.random() < 0.5:
            holds = row[1] in css.CONDITIONS or row[1].endswith("keyframes")
            inner = sheet(rng, out, [*conditions, prelude] if holds else conditions, outer if at else [*outer, prelude], depth + 1, False)
        text.append(f"{gap()}{prelude}{gap()}{{{''.join(body)}{inner}{gap()}}}")
    return "".join(text)


@pytest.mark.parametrize("seed", range(40))
def test_printed_sheets_parse_again(seed):
    rng, want = random.Random(seed), []
    text = sheet(rng, want, [], [], 0, True)
    assert [(n, name, re.sub(r"\s+", " ", s), c, d) for n, name, s, c, d in css.rules(text)] == [(n, name, s, c, d) for n, name, s, c, d in want], text


def test_broken_sheets():
    assert css.rules(None) == css.rules("") == css.rules("}}/* x") == []
    assert css.rules("a{b:c") == [(0, "", "a", [], [("b", "c")])]
    assert css.rules('a{b:"c\n;d:e}f{}') == [(0, "", "a", [], [("b", '"c'), ("d", "e")]), (1, "", "f", [], [])]
    assert css.rules("@media x{a{b:c}d{e:f") == [(0, "@media", "@media x", [], []), (1, "", "a", ["@media x"], [("b", "c")]), (2, "", "d", ["@media x"], [("e", "f")])]
    assert css.rules("a{b;c:d;:e}") == [(0, "", "a", [], [("c", "d")])]
    began = time.time()
    css.rules("a{b:" + '"' * 200_000 + "(" * 200_000 + "{" * 2000)
    assert time.time() - began < 20


def test_kinds(spark):
    text = "<style>:root{--a: 1}.x{color:red;transition: all}@media (a){.y{b:c}}a::before{d:e}@keyframes k{from{a:b}}@font-face{s:t}</style><p><STYLE type=x>z{}</STYLE>"
    df = spark.createDataFrame([(1, text), (2, None), (3, "<p>")], "page_id long, html string")
    got = [(r.kind, r.selector) for r in css.css_rules(df).orderBy("page_id", "rule_no").collect()]
    assert got == [("variables", ":root"), ("transition", ".x"), ("media", "@media (a)"), ("rule", ".y"), ("pseudo", "a::before"), ("keyframes", "@keyframes k"), ("step", "from"), ("font-face", "@font-face"), ("rule", "z")]


def test_addresses(spark):
    rng = random.Random(5)
    base = ["http://a.b/c/d", "https://x.y", "http://a.b/", "http://h.i/p/q/r/?s=/t/../u", "http://a.b/c#top"]
    parts = ["a", "..", ".", "b.png", "", "ü"]
    rows = [(rng.choice(base), "/".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) + rng.choice(["", "?x=../y", "#z", "?"])) for _ in range(400)]
    rows = [(b, u) for b, u in rows if u and not u.startswith("/") and not u.startswith("#")]
    df = spark.createDataFrame(rows, "b string, u string").select("b", "u", urls.absolute(F.col("u"), F.col("b")).alias("got"))
    for r in df.collect():
        root = re.sub("[?#].*", "", r.b).rstrip("/") + "/"
        # the library drops an empty query, the rewriting keeps what stands there
        assert r.got == (urljoin(root, r.u[:-1]) + "?" if r.u.endswith("?") else urljoin(root, r.u)), r
    fixed = spark.createDataFrame([(u,) for u in ("data:a", "javascript:b", "mailto:c", "tel:1", "#d", "{e}", "$f", "http://g", "ftp://h", "//i/j", "/k/../l")], "u string").select(urls.absolute(F.col("u"), F.lit("http://a.b/c")).alias("x"))
    assert [r.x for r in fixed.collect()] == ["data:a", "javascript:b", "mailto:c", "tel:1", "#d", "{e}", "$f", "http://g", "ftp://h", "https://i/j", "http://a.b/k/../l"]


def test_pages_rewritten(spark):
    html = """<a href='x' href="">t</a><img srcset=" a 1x , b  2x 3w,"><p style='background:url("y.png")' src=z>href="q" <b poster="#">"""
    df = spark.createDataFrame([(html, "http://a.b/c/"), (html, None), (None, "http://a.b"), ("", "http://a.b"), ("no addresses", "http://a.b"), (html, "nonsense")], "h string, u string")
    got = [r.x for r in df.select(urls.absolute_html(F.col("h"), F.col("u")).alias("x")).collect()]
    # the srcset's candidates are joined anew even where the base is of no use
    assert got[1:5] == [html, None, "", "no addresses"] and got[5] == html.replace('" a 1x , b  2x 3w,"', '"a 1x, b 2x 3w"')
    assert got[0] == """<a href='http://a.b/c/x' href="">t</a><img srcset="http://a.b/c/a 1x, http://a.b/c/b 2x 3w"><p style='background:url("http://a.b/c/y.png")' src=z>href="http://a.b/c/q" <b poster="#">"""
    sheet_ = spark.createDataFrame([("a{b:url( x);c:url(y);d:url('../z')}",)], "c string").select(urls.absolute_css(F.col("c"), F.lit("http://a.b/c/d")).alias("x")).first().x
    assert sheet_ == "a{b:url( x);c:url(http://a.b/c/d/y);d:url('http://a.b/c/z')}"


def plain_place(raw, items):
    """Positions by comparing every place with all taken ones."""
    taken, out = [], []
    for tag in items:
        span = (0, 0)
        for m in re.finditer(f"<{tag}[^>]*>", raw, re.IGNORECASE):
            close = raw.find(f"</{tag}>", m.start())
            end = close + len(tag) + 3 if close > m.start() else min(m.start() + 1000, len(raw))
            if all(m.start() >= e or end <= s for s, e in taken):
                span = m.start(), end
                break
        if span != (0, 0):
            taken.append(span)
        out.append(span)
    return out


def wanted_of(spark, tags, page=1):
    return spark.createDataFrame([(page, i, None, t, None, None) for i, t in enumerate(tags)], "page_id long, seq long, html string, tag string, id string, classes array<string>")


@pytest.mark.parametrize("seed", range(3))
def test_positions(spark, seed):
    rng = random.Random(seed)
    raw = "x" + "".join(rng.choice(["<p>", "</p>", "<b class=1>", "</b>", "<I>", "text", "</i>", "<p hidden>"]) for _ in range(300))
    tags = [rng.choice(["p", "b", "i", "u"]) for _ in range(200)]
    pages = spark.createDataFrame([(1, raw)], "page_id long, html string")
    got = [(r.char_start, r.char_end) for r in summary.raw_positions(pages, wanted_of(spark, tags)).orderBy("seq").collect()]
    assert got == plain_place(raw, tags)


def test_many_positions(spark):
    """Ten thousand spans of a page in less than the square's time."""
    n = 10_000
    pages = spark.createDataFrame([(1, " " + "<p>a</p>" * n)], "page_id long, html string")
    began = time.time()
    got = summary.raw_positions(pages, wanted_of(spark, ["p"] * n + ["q"])).orderBy("seq").collect()
    assert [(r.char_start, r.char_end) for r in got] == [(1 + 8 * i, 9 + 8 * i) for i in range(n)] + [(0, 0)]
    spans = spark.createDataFrame([(1, i, list(range(n))) for i in range(300)] + [(1, 300, None)], "page_id long, seq long, starts array<long>")
    assert [r.start for r in summary.allocate(spans).orderBy("seq").collect()] == [*range(300), None]
    assert time.time() - began < 30
