"""Component types, text location, fixes, JSON search, showcases and streams, worked out by hand."""

import json

from pyspark.sql import functions as F

from pagelathe.functions import html as H
from pagelathe.operators import files, jsonpath, jsonq, logs, memory, summary, tree
from pagelathe.plans.tools import Tool, Tools
from pagelathe.sources import journal, showcase
from pagelathe.streaming import queries as streams


def test_json(spark):
    deep = "[" * 100_000 + "]" * 100_000
    docs = spark.createDataFrame([(1, '{"aKey": {"key": 1}, "l": ["the KEY", 5], "n": null}'), (2, "{"), (3, None), (4, deep), (5, "[1]")], "id long, doc string")
    assert [(r.id, r.place, r.path, r.value, r.n_matches) for r in jsonpath.found(docs, "id", "doc", "key").orderBy("place").collect()] == [("1", 1, "$.aKey", '{"key":1}', 2), ("1", 2, "$.l[0]", "the KEY", 2)]
    assert [(r.place, r.value) for r in jsonq.dispatch(docs, "id", "doc", ".l[*]").orderBy("place").collect()] == [(1, "the KEY"), (2, "5")]
    got = {r.id: r.lines for r in jsonq.described(docs, "id", "doc").collect()}
    assert got["1"] == "- **aKey**: dict[1 keys]\n- **l**: list[2 items]\n- **n**: NoneType" and got["2"] is got["3"] is got["4"] is got["5"] is None
    assert jsonq.brief("x" * 51) == '"' + "x" * 50 + '..."'


def test_location(spark):
    rows = spark.createDataFrame([("a", "one\ntwo words\nthree"), ("b", "x\n two \t words \nthree"), ("c", "word\nnothing\nwords of two"), ("d", "")], "path string, content string")
    got = {(r.path, r.tier, r.line_no) for r in files.located(rows, "two words").collect()}
    assert got == {("a", "exact", 2), ("b", "spacing", 2), ("c", "similar", 3)}
    assert files.similar_lines(rows, "a of").count() == 0
    edit = lambda s, e, new="N": [r[0] for r in rows.orderBy("path").select(files.replaced_lines(F.col("content"), s, e, new)).collect()]
    assert edit(2, 2)[0] == "one\nN\nthree" and edit(0, 99) == ["N"] * 4 and edit(9, 12)[0] == "one\ntwo words\nthree\nN" and edit(3, 1)[0] == "one\ntwo words\nN\nthree"


def test_fixes(spark):
    rows = spark.createDataFrame([("MISSING_IMPORT", "/src/a/App.jsx", "no '../b/Box.ts'"), ("MISSING_CSS", None, "x"), ("TYPE_ERROR", "f", "x"), (None, None, None)], "c string, f string, m string")
    got = [r[0] for r in rows.select(logs.fix_command(F.col("c"), F.col("f"), F.col("m"))).collect()]
    assert 'write_file(path="/src/a/b/Box.ts"' in got[0] and "from '../b/Box.ts'" in got[0] and got[1:] == [None] * 3


def test_components(spark):
    rows = spark.createDataFrame([(1, 0, None, 4, "body", 99, 99), (1, 1, 0, 3, "div", 50, 50), (1, 2, 1, 3, "p", 9, 50), (1, 3, 2, 3, "a", 50, 50), (1, 4, 0, 4, "svg", 50, 50)], "page_id long, node_id int, parent_id int, subtree_end int, tag string, width int, height int")
    got = [(r.id, r.parent_id, r.emitted, r.n_children) for r in tree.component_tree(rows).orderBy("node_id").collect()]
    assert got == [("comp_0001", None, 2, 1), ("comp_0002", "comp_0001", 1, 0)]
    media = spark.createDataFrame([(None,), ("<video>",), ("<p>" + "x" * 50_000,)], "h string").select(H.clean_media(F.col("h")).alias("h")).collect()
    assert [r.h and len(r.h) for r in media] == [None, 7, 50_003]
    box = spark.createDataFrame([(["hero"],), (None,)], "t array<string>").select(H.layout_box(F.col("t")).alias("b")).collect()
    assert box[0].b.split("\n")[3] == "|" + " " * 27 + "HERO" + " " * 27 + "|" and len(box[1].b.split("\n")) == 3


def test_raw_positions(spark):
    raw = '<div id="a" class="x">1</div><div class="x y">2</div><div>3</div>' + '<p class="z">' + "t" * 60 + "</p>"
    pages = spark.createDataFrame([(1, raw), (2, None)], "page_id long, html string")
    long = '<p class="z">' + "t" * 60 + "</p>"
    rows = [(1, 0, None, "div", None, ["x"]), (1, 1, None, "div", "a", ["x"]), (1, 2, None, "div", None, ["9"]), (1, 3, long, "p", None, []), (1, 4, None, "b", None, None), (2, 0, None, "p", None, None), (3, 0, None, "p", None, None)]
    wanted = spark.createDataFrame(rows, "page_id long, seq long, html string, tag string, id string, classes array<string>")
    got = {(r.page_id, r.seq): raw[r.char_start : r.char_end] for r in summary.raw_positions(pages, wanted).collect()}
    assert got[1, 0] == '<div id="a" class="x">1</div>' and got[1, 1] == '<div class="x y">2</div>' and got[1, 3] == long and got[1, 4] == got[2, 0] == got[3, 0] == ""


def test_tools(spark):
    t = Tools()
    t.add("n", Tool(lambda s, n: s.range(n), {"n": int}, ("n",)))
    assert t.tools["n"].schema() == {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}
    assert t.formatted(spark, "n", {"n": 2}) == '{"id":0}\n{"id":1}' and t.formatted(spark, "n", {}) == "Error: validation: n missing"
    assert t.formatted(spark, "n", {"n": 2}, aborted=lambda: True) == "Error: abort: n" and t.formatted(spark, "x", {}).startswith("Error: discovery")


def test_segments(spark):
    said = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(6)], "conv_id long, turn long, role string, text string")
    got = memory.compact(said, 2, segments=("Count", "Nothing"), extractors={"Count": lambda: F.count("*").cast("string")}).first()
    assert got.compacted == 4 and got.summary == "## Count\n- 4"
    runs = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 1, 9)], "k long, a long, b long")
    assert [tuple(r) for r in logs.concurrency(runs, ["k"], "a", "b").collect()] == [(1, 3, 2, True)]


def test_journal(spark, tmp_path):
    at, schema = f"file://{tmp_path}/log", "id long, step string"
    assert journal.entries(spark, at, schema).count() == 0
    for i in range(2):
        journal.append(at, spark.createDataFrame([(i, "x")], schema))
    assert sorted(r.id for r in journal.entries(spark, at, schema).collect()) == [0, 1]
    journal.clear(spark, at, schema)
    assert journal.entries(spark, at, schema).count() == 0


def test_showcase(spark, tmp_path):
    at = f"file://{tmp_path}/shows/one"
    meta = spark.createDataFrame([("n", 2)], "name string, events long")
    showcase.write(at, meta, spark.range(3), spark.createDataFrame([("/a", "x")], "path string, content string"))
    assert showcase.read(spark, at, "replay", "id long").count() == 3 and showcase.read(spark, at + "x", "replay", "id long") is None
    assert [(r.showcase, r.name) for r in showcase.index(spark, f"file://{tmp_path}/shows").collect()] == [("one", "n")]


def test_streams(spark, tmp_path):
    def stream(name, schema, *rows):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text("\n".join(json.dumps(r) for r in rows))
        return spark.readStream.schema(schema).json(str(tmp_path / name))

    def drain(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    asked = stream("asked", "url string, method string, resource_type string, ts timestamp", *({"url": u, "method": "GET", "resource_type": t, "ts": s} for u, t, s in (("/a", "xhr", "2024-01-01T00:00:00Z"), ("/b", "image", "2024-01-01T00:00:00Z"), ("/c", "xhr", "2024-01-01T00:00:00Z"), ("/z", "xhr", "2024-01-02T00:00:00Z"))))
    told = stream("told", "url string, status long, body string, ts timestamp", *({"url": u, "status": 200, "body": "ok", "ts": s} for u, s in (("/a", "2024-01-01T00:00:02Z"), ("/b", "2024-01-01T00:00:01Z"), ("/z", "2024-01-02T00:00:01Z"))))
    got = {r.url: (r.status, r.millis, r.body) for r in drain(streams.tapped(asked, told), "tapped")}
    assert got == {"/a": (200, 2000.0, "ok"), "/b": (200, 1000.0, None), "/z": (200, 1000.0, "ok"), "/c": (None, None, None)}
    said = stream("said", "conv_id long, seq long, tokens long", *({"conv_id": 1, "seq": i, "tokens": 40} for i in range(7)), {"conv_id": 2, "seq": 0, "tokens": 5})
    seen = []
    streams.handled(said.withColumn("kind", F.when(F.col("conv_id") == 1, "a").otherwise("b")), "kind", {"b": lambda x: seen.append(("b", x.count())), "a": lambda x: seen.append(("a", x.count()))}, str(tmp_path / "at")).awaitTermination(120)
    assert seen == [("b", 1), ("a", 7)]
