"""Contracts, reports, sources and tools against fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from pagelathe.functions import text as X
from pagelathe.operators import planning, reports
from pagelathe.plans.tools import Tool, Tools
from pagelathe.sources import files as S


def test_plan(spark):
    s = spark.createDataFrame([(1, 1, "Hero Box", "hero", 2, None), (1, 2, "site-foot", "footer", None, 3), (1, 3, "Odd", "weird", 0, 0), (1, 4, "Top", "header", 0, 0)], "page_id long, section_id long, name string, type string, n_images int, n_links int")
    made = planning.contracts(s)
    assert {r.section_id: (r.namespace, r.component, r.type, r.min_images, r.min_links) for r in made.collect()}[1] == ("hero_box", "HeroBoxSection", "hero", 2, 0)
    assert [(r.section_id, r.position) for r in planning.integration_plan(made).orderBy("place").collect()] == [(4, "start"), (1, "after:top"), (3, "after:hero_box"), (2, "after:odd")]
    code = spark.createDataFrame([('<img src="http://a"><a href="b"> export default X',)], "code string")
    assert code.select(planning.accepted(F.col("code"), F.lit(1), F.lit(1)).alias("a"), planning.accepted(F.col("code"), F.lit(2), F.lit(1)).alias("b")).first() == (True, False)
    files = spark.createDataFrame([("/src/components/sections/hero/HeroSection.jsx",), ("/src/App.jsx",)], "path string")
    assert [tuple(r) for r in planning.imports(files).collect()] == [("hero", "HeroSection", "import HeroSection from './components/sections/hero/HeroSection.jsx';")]
    wanted = spark.createDataFrame([("A B", None), ("C", 5.0), ("X", None)], "name string, y double")
    layout = spark.createDataFrame([("a_b", 7.0), ("c", 8.0)], "name string, y double")
    assert {r.name: r.y for r in planning.matched(wanted, layout).collect()} == {"A B": 7.0, "C": 5.0, "X": None}


def test_reports(spark):
    log = spark.createDataFrame([(1, i, f"error {i}" if i % 2 else "warn") for i in range(60)], "t long, seq long, line string")
    r = reports.diagnosis(log, "t", "seq", "line").first()
    assert (r.errors, r.warnings, r.report) == (25, 25, "error 11\nerror 13\nerror 15\n+22 more")
    e = spark.createDataFrame([("[plugin:vite:css] /a/b.css:3:4 bad\n  1 | x\n    | ^\n  at f (y)",)], "t string").select(reports.build_error(F.col("t")).alias("e")).first().e
    assert (e.plugin, e.file, e.line, e.column, len(e.frame), len(e.stack)) == ("vite:css", "/a/b.css", 3, 4, 2, 1)
    errors = spark.createDataFrame([(1, "bad a.js and b.js")], "error_id long, message string")
    files = spark.createDataFrame([("/x/a.js",), ("/y/a.js",), ("/z/c.js",)], "path string")
    assert [r.path for r in reports.related(errors, files).orderBy("path").collect()] == ["/x/a.js", "/y/a.js"]
    code = spark.createDataFrame([("/a", "<img src='http://i/1.png'> url(http://i/2.gif) url(http://i/3)"), ("/b", '["http://i/1.png"] "http://i/4.png"')], "path string, content string")
    assert {(r.path, r.url, r.is_new) for r in reports.image_urls(code).collect()} == {("/a", "http://i/1.png", True), ("/a", "http://i/2.gif", True), ("/b", "http://i/1.png", False)}
    assert spark.range(1).select(reports.restored(F.lit("/i/ab /i/a"), {"/i/a": "S", "/i/ab": "L"})).first()[0] == "L S"
    pages = spark.createDataFrame([(1, 0, 10, 50, True), (2, 0, 11, 50, True), (3, 1, 20, 900, False), (4, 2, 0, 0, False)], "id long, children int, text_chars int, html_chars int, has_root boolean")
    assert sorted(r.id for r in reports.blank_pages(pages).collect()) == [1, 3]
    themes = spark.createDataFrame([(1, 0, 0, 0, 0, True, False), (2, 0, 0, 0, 0, False, True), (3, 1, 0, 0, 0, False, True), (4, 0, 0, 0, 0, False, False)], "id long, colors int, elements int, variables int, images int, media_query boolean, dark_class boolean")
    assert {r.id: r.support for r in reports.theme_support(themes).collect()} == {1: "BOTH", 2: "DARK_ONLY", 3: "BOTH", 4: "LIGHT_ONLY"}
    assert spark.range(1).select(reports.changed(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4")))).first()[0] == {"b": "3", "c": "4"}
    assert spark.range(1).select(F.size(reports.context_lines(F.lit("ok\nLine 4\nerror\nfine")))).first()[0] == 2


def test_sources(spark, tmp_path):
    for i, t in enumerate(("2024-01-02", "2024-01-03")):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": str(i), "source_url": "u", "created_at": t, "data": {"a": "é"}}, ensure_ascii=False))
    (tmp_path / "bad.json").write_text("{")
    assert [(r.id, r.json_size) for r in S.json_sources(spark, str(tmp_path)).collect()] == [("1", 11), ("0", 11)]
    assert S.file_tree(spark, str(tmp_path)).count() == 3
    f = spark.createDataFrame([("/a", "x"), ("/public/images/b", "x"), ("/c", "[Binary 3]"), ("/.d", "x"), ("/n/node_modules/e", "x"), ("/f", "")], "path string, content string")
    assert sorted(r.path for r in S.exported(f).collect()) == [".d", "a", "f", "n/node_modules/e"]
    assert sorted(r.path for r in S.snapshot(f).collect()) == ["/a", "/c", "/public/images/b"]
    assert json.loads(S.ndjson(f).first().value) == {"path": "/a", "content": "x"}


def test_tools(spark):
    t = Tools()
    t.add("range", Tool(lambda s, n: s.range(n), {"n": int}, ("n",), category="rows"))
    assert t.call(spark, "range", {"n": 3}).count() == 3 and t.by_category() == {"rows": 1}
    with pytest.raises(ValueError, match="twice"):
        t.add("range", t.tools["range"])
    for args, kind, text in ((("none", {}), LookupError, "discovery"), (("range", {}), ValueError, "missing"), (("range", {"n": "x"}), ValueError, "another type"), (("range", {"n": 1}, lambda _: False), PermissionError, "permission")):
        with pytest.raises(kind, match=text):
            t.call(spark, *args)


def test_millis_are_rounded(spark):
    """The nearest millisecond, halves away from zero."""
    us = spark.createDataFrame([(1704699763999896,), (1704699763999499,), (1704699763999500,), (0,), (-315619199999500,), (-499,), (None,)], "us long")
    got = [r.ms for r in us.select(X.millis(F.timestamp_micros("us")).alias("ms")).collect()]
    assert got == [1704699764000, 1704699763999, 1704699764000, 0, -315619200000, 0, None]
