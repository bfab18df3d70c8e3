"""Summaries against fixtures."""

from pyspark.sql import functions as F

from pagelathe.operators import elements, summary

PAGE = f'<body><div id="root"><div class="a b c d"><header>top text</header><p title="{"t" * 101}">one</p></div></div></body>'


def test_pages(spark):
    nodes = elements.flatten(spark.createDataFrame([(1, PAGE)], "page_id long, html string")).cache()
    assert tuple(summary.main_content(nodes, 0.6).first())[1:] == (2, "div")
    assert summary.skeletons(nodes, 3).first().skeleton == '<body><div><div class="a b c">...</div></div></body>'
    v = summary.visible_text(nodes).first()
    assert (v.elements, v.text, v.has_content) == (5, "top text one", False)
    assert [(r.tag, r.node_id) for r in summary.landmarks(nodes).collect()] == [("header", 3)]
    assert summary.snapshot(nodes).where("tag = 'p'").first().attributes["title"] == "t" * 100 + "..."


def test_skeletons(spark):
    """Levels, children, classes and texts are cut; no group of rows goes through pandas."""
    wide = "<body>" + "".join(f'<ul class="a b"><li>{"x" * 60}<b>1</b></li><li>2</li></ul>' for _ in range(7)) + "</body>"
    df = spark.createDataFrame([(1, wide), (2, "<body>t</body>"), (3, "<body hidden><p>1</p></body>"), (4, None), (5, "<body><p>1<p hidden>2<p>3</body>")], "page_id long, html string")
    out = summary.skeletons(elements.flatten(df), kids=2)
    ul = f'<ul class="a b"><li>{"x" * 50}...</li><li>2</li></ul>'
    assert {r.page_id: r.skeleton for r in out.collect()} == {1: f"<body>{ul}{ul}<!-- 5 more --></body>", 2: "<body>t</body>", 5: "<body><p>1</p><p>3</p></body>"}
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rows(spark):
    s = spark.createDataFrame([(1, 1, [5, 9]), (1, 2, [5, 9]), (1, 3, [9])], "page_id long, seq long, starts array<long>")
    assert [r.start for r in summary.allocate(s).orderBy("seq").collect()] == [5, 9, None]
    css = spark.createDataFrame([(1, "u", 1, "b"), (1, None, 0, "a")], "page_id long, url string, seq int, content string")
    assert summary.joined_css(css).first().css == "/* === inline === */\na\n\n/* === u === */\nb"
    t = spark.createDataFrame([(1, "open", 3), (2, "open", 9), (3, "completed", 9)], "id long, status string, priority int")
    assert [(r.id, r.place) for r in summary.todos(t, least=3, completed=False).orderBy("place").collect()] == [(2, 1), (1, 2)]
    kept, missing = summary.subset(F.lit('{"a": 1, "b": "x"}'), ("b", "c"))
    assert spark.range(1).select(kept.alias("k"), missing.alias("m"), summary.formatted(F.lit("x" * 9), 5).alias("f")).first() == ({"b": "x"}, ["c"], "xxxxx... (9 chars)")
    c = spark.createDataFrame([(1, 2, "a-b", None, None, None, None, ["i"], ["o"])], "page_id long, index int, id string, name string, y double, width double, height double, links_in array<string>, links_out array<string>")
    r = summary.sections_of(c).first()
    assert (r.id, r.name, r.y, r.width, r.height, [tuple(x) for x in r.links]) == ("a_b", "a-b", 800.0, 1920.0, 400.0, [("i", "internal"), ("o", "external")])
    assert spark.range(1).select(summary.styling(F.array(F.lit("css-1ab2c")), F.array().cast("array<string>"))).first()[0] == "emotion"
