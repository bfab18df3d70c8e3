"""The ten operators and the pipeline against brute force, round trips and held-out rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagelathe.llm import covertree, licenses, lines, mixing, mpeg, pieces, secrets, simhash, tokencount, toxicity
from pagelathe.llm import registry as R
from pagelathe.llm.common import table
from pagelathe.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, fp string, score string, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long_ = " ".join(f"word{i % 977} licence" for i in range(30000))
    rows = [
        (1, "", "en", "a", 0, "x", "x", "x", "x", "x"),
        (2, None, None, None, None, None, None, None, None, None),
        (3, long_, "en", "a", len(long_), "x", "x", "x", "x", "x"),
        (4, "one two", "en", "b", 7, "x", "x", "x", "x", "x"),
        (4, "one two", "en", "b", 7, "x", "x", "x", "x", "x"),
        (5, "one two", "en", None, 7, "x", "x", "x", "x", "x"),
        (None, "one two three four", "de", "b", 18, "x", "x", "x", "x", "x"),
        (6, " \t\n ", "en", "é", 4, "x", "x", "x", "x", "x"),
        (7, "Released under the MIT License.\npassword=abcdef123 😀 " + "a" * 3000, "en", "é", 0, "x", "x", "x", "x", "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    """An empty table."""
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def over(spark, docs):
    """Each operator's rows over a table."""
    return {
        "mix": mixing.Mix(docs).taken(),
        "mixed": mixing.Mix(docs).documents(),
        "lines": lines.classes(docs),
        "dedup": lines.dedup(docs),
        "secrets": secrets.digest(secrets.scan(docs)),
        "pieces": pieces.encode(docs),
        "simhash": simhash.near_duplicates(docs),
        "first": simhash.keep_first(docs),
        "toxic": toxicity.judged(docs, labels(spark)),
        "tokens": tokencount.count(docs),
        "media": mpeg.features(mpeg.media(docs)),
        "licenses": licenses.scan(docs),
    }


def test_empty_tables(spark, none):
    for name, df in over(spark, none).items():
        assert df.count() == 0, name


def test_odd_rows(spark, odd):
    got = {k: v.collect() for k, v in over(spark, odd).items()}
    for k in ("mix", "secrets", "pieces", "simhash", "toxic", "tokens", "media", "licenses"):
        assert len(got[k]) == 9, k
    assert {r.doc_id: r.n_assign for r in got["secrets"]}[7] == 1
    assert {r.doc_id: r.notices for r in got["licenses"]}[7] == "0:mit"
    assert {r.doc_id: r.n_tokens for r in got["tokens"]}[2] == 0
    by = {r.doc_id: r for r in got["simhash"]}
    assert by[1].component_id == by[2].component_id == by[6].component_id == 1 and by[5].component_id == 4
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in got["toxic"])
    assert sorted(r.doc_id or 0 for r in got["first"]) == [0, 1, 3, 4, 7]
    assert {r.doc_id: r.payload_bytes for r in got["media"]}[1] == 64


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges[:-1]:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def brute_fingerprint(text, words=3):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query(spark, sf):
    got = R.op5_simhash(spark, sf).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    want = {i: brute_fingerprint(t) for i, t in docs.text.items()}
    assert {i: f"{f:016x}" for i, f in want.items()} == got.fingerprint.to_dict()
    label = {i: i for i in want}
    for _ in range(9):
        for i in want:
            label[i] = min(label[j] for j in want if (want[i] ^ want[j]).bit_count() <= 3)
    assert label == got.component_id.to_dict()


@pytest.mark.parametrize(("n", "radius", "block"), [(600, 3, 4096), (900, 3, 64), (300, 9, 4096)])
def test_bit_sliced_links(spark, n, radius, block):
    g = np.random.default_rng(n)
    fp = g.integers(0, 1 << 63, n, dtype=np.uint64) * 2
    for i in range(n // 2, n):
        fp[i] = fp[g.integers(0, i)] ^ np.uint64(sum({1 << int(b) for b in g.integers(0, 64, g.integers(0, 5))}))
    fp = np.unique(fp)
    label = np.arange(len(fp))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius)
    label = simhash.join_labels(label, i, j)
    rows = pd.DataFrame({"fp": fp.view(np.int64), "node": np.arange(len(fp))})
    key = F.explode(F.array(*simhash.band_keys(radius))) if radius < 9 else F.lit(1).cast("long")
    keyed = spark.createDataFrame(rows).select(key.alias("key"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), "node")
    got = {r.node: r.component for r in components(simhash.link_keyed(keyed, radius, block)).collect()}
    assert [got.get(k, k) for k in range(len(fp))] == label.tolist()


def test_wide_groups(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, k = [], 0
    for _ in range(60):
        base = [word() for _ in range(300)]
        rows.append((k, " ".join(base)))
        for _ in range(2):
            k += 1
            copy = list(base)
            for i in rng.sample(range(300), 4):
                copy[i] = word()
            rows.append((k, " ".join(copy)))
        k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_first(docs).collect())
    assert len(set(range(0, 180, 3)) - set(kept)) == 0 and len(kept) <= 63


@pytest.mark.parametrize(("n", "block"), [(4, 1024), (40, 1024), (200, 1024), (40, 16)])
def test_near_groups_at_the_similarity(spark, n, block):
    """Pairs right at and right below 0.8, of short and long texts: five-word shingles, brute force."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    rows = []
    for k in range(150):
        base = [word() for _ in range(n + 4)]
        more = n // 4 if k % 2 else n // 4 + 1  # n of n + more shingles are shared: 0.8, or less
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + [word() for _ in range(more)]))]
    if block < 1024:  # one chain in hot keys
        base = [word() for _ in range(300)]
        rows += [(1000 + i, " ".join(base[: 300 - i])) for i in range(80)]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    got = {r.doc_id: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == label


def test_mixing(spark, sf):
    got = R.op1_mixing(spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    n = docs.set_index("doc_id").text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert got.set_index("doc_id")["size"].to_dict() == n.to_dict()
    assert (got.taken <= 2 * got["size"]).all()
    got["source"] = got.doc_id.map(docs.set_index("doc_id").source)
    by = got.groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.told).all() and ((by.taken - by.target).abs() <= 1).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 or (by.target == 2 * by["size"]).any()
    again = R.op1_mixing(spark, sf).toPandas()
    assert got.set_index("doc_id").taken.to_dict() == again.set_index("doc_id").taken.to_dict()


def test_mix_texts(spark):
    """The mixed texts hold the words that rows() names, and all slots hold blocks of one source."""
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(i % 97))) for i in range(150)], "doc_id long, text string").withColumn("source", F.concat(F.lit("s"), F.pmod("doc_id", F.lit(3)).cast("string")))
    m = mixing.Mix(docs, block=8, shard_slots=50)
    rows = m.rows().toPandas()
    assert (rows.groupby(["shard", "slot"]).block.nunique() == 1).all()
    whole = collections.Counter(w for r in m.documents().collect() for w in r.text.split())
    assert whole == collections.Counter(f"d{r.doc_id}w{k}" for r in rows.itertuples() for k in range(r.word_from, r.word_to))


CLASH = ("size", "part", "pass", "taken", "tie", "row", "whole", "start", "s", "base", "_text", "n", "doc", "kept", "score", "gone", "left", "_doc", "_tie", "parts", "block", "word_from", "fp", "held_out")


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda x: x[0])
def test_stages_keep_columns(spark, stage):
    """Columns with any names and their values stay; nulls, empty texts, ties, repeated rows and empty tables are defined."""
    rows = [(i, f"text {i} has its own words {i * 7} and {i * 13} more of them", "en", "ab"[i % 2], 40) for i in range(12)]
    rows += [(20, None, None, None, None), (21, "", "en", "a", 0), (None, "a row without doc_id that has words", "en", "b", 5), rows[3], (4, "another text that shares the doc_id of a row", "en", "a", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    docs = spark.createDataFrame([(*r, *(f"{c} {r[0]} {len(r[1] or '')}" for c in CLASH)) for r in rows], schema)
    sf = "/root/testdata/sf0.001"
    out = stage[1](spark, docs, sf)
    assert out.columns == docs.columns
    got = out.collect()
    by = {(r.doc_id, r.size): r for r in docs.collect()}
    for r in got:  # every row is one of docs, with its own values
        was = by[r.doc_id, r.size]
        assert all(r[c] == was[c] for c in CLASH) and r.lang == was.lang and r.source == was.source
        assert r.text == was.text and r.n_chars == was.n_chars or r.n_chars == len(r.text)
    ids = collections.Counter(r.doc_id for r in got)
    if stage[0] == "toxicity":
        assert sum(ids.values()) == len(rows)
    if stage[0] == "line dedup":  # equal rows keep the same lines
        assert sum(ids.values()) == len(rows) and {r.doc_id: r.text for r in got if r.doc_id != 4} == {r[0]: r[1] for r in rows if r[0] != 4}
    if stage[0] == "near dedup":  # repeated rows and one of the two texts without words go
        assert ids == collections.Counter([*range(12), 4, 20, None])
    if stage[0] == "mixing":
        assert set(ids) <= {*range(12), None}
    assert stage[1](spark, docs.limit(0), sf).count() == 0


def test_links_through_rows_without_id(spark):
    """Fingerprints that only rows without doc_id bear link others: distances 3, 3 and 6."""
    fps = [0b111000, 0b111, 0]
    made = spark.createDataFrame([(7, fps[0]), (None, fps[2]), (9, fps[1]), (11, 1 << 40 | 0xFFF0000), (None, 0x7F << 50)], "doc_id long, fp long")
    was = simhash.fingerprints
    simhash.fingerprints = lambda *a, **k: made
    try:
        got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(made).collect()}
    finally:
        simhash.fingerprints = was
    assert got == {(7, fps[0]): 7, (None, 0): 7, (9, fps[1]): 7, (11, 1 << 40 | 0xFFF0000): 11, (None, 0x7F << 50): None}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutation(n):
    p = mixing.Permutation(n, 1, 2)
    assert sorted(p(np.arange(n))) == list(range(n)) and (p.inverse(p(np.arange(n))) == np.arange(n)).all()


def test_water_fill():
    assert mixing.water_fill([10, 10, 100], [3, 1, 2], 180, 2) == [20, 20, 140]
    assert mixing.water_fill([0, 10], [3, 1], 15, 2) == [0, 15]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("edits", "per", "block"), [(2, 5, 1024), (2, 6, 4), (1, 4, 1024), (3, 3, 1024)])
def test_lines_join(spark, edits, per, block):
    """Equal and near lines of all lengths by brute force, with rows that repeat, share a doc_id or have none."""
    rng = random.Random(1)

    def mutate(x, k):
        x = list(x)
        for _ in range(k):
            i = rng.randrange(max(1, len(x)))
            x[i : i + rng.randrange(2)] = rng.choice(["", rng.choice("abcdé😀")])
        return "".join(x)

    base = ["".join(rng.choice("abcd") for _ in range(rng.choice((2, 5, 9, 10, 11, 12, 13, 14)))) for _ in range(50)]
    texts = [mutate(rng.choice(base), rng.randrange(4)) for _ in range(300)]
    rows = [(i, "\n".join(texts[i : i + 2])) for i in range(0, 300, 2)]
    rows += [rows[3], rows[3], (8, "\n".join(texts[5:9])), (None, "\n".join(texts[20:24])), (None, texts[30]), (400, None), (401, ""), (402, " \n\t\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.line_no, r.n_chars, r.first_doc, r.first_line, r.n_links, r.kept) for r in lines.classes(docs, edits, per, block).collect())
    tie = {r.text: r.tie for r in docs.select("text", F.xxhash64("text").alias("tie")).collect()}
    at = [((d is None, d or 0, tie[t], k), x) for d, t in rows if t for k, x in enumerate(t.split("\n")) if x.strip()]
    first = {}
    for k, x in sorted(at):
        first.setdefault(x, k)
    near = {t: [u for u in first if u != t and distance(t, u) <= min(edits, min(len(t), len(u)) // per)] for t in first}
    want, seen = collections.Counter(), set()
    for k, t in at:
        best = min([first[t], *(first[u] for u in near[t])])
        want[(None if k[0] else k[1], k[3], len(t), None if best[0] else best[1], best[3], len(near[t]), best == k and k not in seen)] += 1
        seen.add(k)
    assert got == want


def test_banded_distance(spark):
    rng = random.Random(0)
    pairs = [tuple(sorted(("".join(rng.choice("abé😀") for _ in range(rng.randrange(5, 12))) for _ in range(2)), key=len, reverse=True)) for _ in range(800)]
    for e in (1, 2, 3):
        rows = spark.createDataFrame(pairs, "a string, b string").select(F.levenshtein("a", "b").alias("w"), lines.banded_distance(F.col("a"), F.col("b"), e).alias("g")).collect()
        assert all(r.w == r.g for r in rows if min(r.w, r.g) <= e)


def test_line_dedup_texts(spark):
    """Equal lines of any length and near longer ones go, blank ones stay, unless no other is left; n_chars follows."""
    a, b, c = ("the first long line of the text", "another line that is long enough", "a third line, long enough as well")
    near = "the first long line of the next"
    docs = spark.createDataFrame([(1, f"{a}\nshort\n \n{b}\nshort", 5), (2, f"{near}\n{c}\n \nshirt", 6), (3, b, 7), (4, "short", 8), (5, "short dup", 9), (6, "short dup", 9), (7, None, 1), (8, "", 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.dedup(docs).collect()}
    one, two = f"{a}\nshort\n \n{b}", f"{c}\n \nshirt"
    assert got == {1: (one, len(one)), 2: (two, len(two)), 5: ("short dup", 9), 7: (None, 1), 8: ("", 0)}
    assert [(r.doc_id, r.kept) for r in lines.classes(docs.where("doc_id IN (5, 6)")).orderBy("doc_id").collect()] == [(5, True), (6, False)]


def test_line_dedup_shared_ids(spark):
    """Rows without doc_id, or that share one, lose their own repeated lines alone."""
    say = lambda x: f"{x} is a line that is long enough {x * 9}"
    rows = [(1, say("a")), (None, f"{say('b')}\n{say('c')}"), (None, f"{say('a')}\n{say('d')}"), (None, f"{say('e')}\n{say('a')}"), (None, f"{say('f')}\n{say('g')}"), (7, f"{say('h')}\n{say('i')}"), (7, f"{say('h')}\n{say('j')}"), (7, f"{say('a')}\n{say('k')}")]
    got = [r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x for t in got for x in t.split("\n")) == sorted(map(say, "abcdefghijk")) and len(got) == 8


def brute_spans(text):
    out = []
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    keys = "|".join(map(letters, ("password", "passwd", "secret", "token"))) + "|" + letters("api") + "_?" + letters("key")
    for m in re.finditer(rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [("assign", *m.span())] if len(m[2]) >= 6 else []
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_secrets():
    rng = random.Random(2)
    parts = ["password", "Token", "secret", "apikey", "API_KEY", "=", ":", " ", '"', "'", "abcdef", "12", "AKIA", "A" * 16, "0a" * 12, "é", "ſ", "K", "\n", "İ"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [x for x in secrets.find(text) if x[0] in secrets.BASE] == brute_spans(text), text
    body = "a" * 30
    good = "ghp_" + body + secrets._base62(zlib.crc32(body.encode()))
    assert [x[0] for x in secrets.find(f"x {good} y")] == ["github", "hex"] and not any(x[0] == "github" for x in secrets.find(f"x {good[:-1]}! ghp_{'b' * 36}"))


def plain_spans(text):
    """Tokens and keys by the plain patterns, from the left, without overlap within a kind."""
    import base64
    import json

    out = []
    for m in re.finditer(r"(eyJ[A-Za-z0-9_-]{8,})\.(eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{16,}", text):
        try:
            head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
        except ValueError:
            continue
        out += [("jwt", *m.span())] if isinstance(head, dict) and "alg" in head else []
    key = r"(?:[A-Z]+ )?PRIVATE KEY-----"
    return out + [("pem", *m.span()) for m in re.finditer(rf"-----BEGIN {key}\s+[A-Za-z0-9+/=\s]{{64,}}-----END {key}", text)]


def test_secret_tokens():
    import base64

    rng = random.Random(6)
    code = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    parts = [code('{"alg":"HS256"}'), code('{"typ":"JWT"}'), code('{"a": 1}'), "eyJ", ".", ".", "s" * 16, "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "\n", "QUJD" * 16, " ", "-"]
    parts += [f"{parts[0]}.{parts[2]}.", f"{parts[1]}.{parts[2]}.{'s' * 16}", f"-----BEGIN PRIVATE KEY-----\n{'QUJD' * 16}", "\n-----END RSA PRIVATE KEY-----"]
    found = 0
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        got = sorted(x for x in secrets.find(text) if x[0] in ("jwt", "pem"))
        assert got == sorted(plain_spans(text)), text
        found += len(got)
    assert found > 100


def test_secrets_of_hostile_texts():
    """Deep nesting is no secret and no crash; time grows in proportion to the length."""
    import base64
    import time

    deep = base64.urlsafe_b64encode(b'{"a":' + b"[" * 200_000).decode().rstrip("=")
    assert secrets.find(f"{deep}.{deep}.{'x' * 20}") == []
    wide = base64.urlsafe_b64encode(b'{"alg":' + b"9" * 9000 + b"}").decode().rstrip("=")
    assert secrets.find(f"{wide}.{wide}.{'x' * 20}") == []
    for unit in ("eyJ", "eyJaaaaaaaaa.", "-----BEGIN PRIVATE KEY-----" + " " * 99, " " * 50 + "password", "token=", "AKIA", "0a" * 11 + " ", "ghp_"):
        for text in (lambda n: unit * (n // len(unit)), lambda n: "-----BEGIN PRIVATE KEY-----" + (unit if unit.isspace() else " ") * n):  # noqa: B023
            spent = []
            for n in (200_000, 800_000):
                at = time.process_time()
                secrets.find(text(n))
                spent.append(time.process_time() - at)
            assert spent[1] < 10 * spent[0] + 0.5 and spent[1] < 8, (unit, spent)


def test_secrets_query(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    for r in R.op3_secrets(spark, sf).collect():
        base = brute_spans(docs[r.doc_id])
        assert r.base_sha256 == secrets.sha256_of(base) and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in secrets.BASE)


def test_pieces(spark, sf):
    import sentencepiece

    lib, own, rng = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.load(), random.Random(0)
    texts = ["".join(rng.choice("    aaabbb thetionin.,\n\t▁é漢字😀01<s>AZ") for _ in range(rng.randrange(50))) for _ in range(4000)]
    texts += [" " * k + "x" + " " * k + "\n" + " " * k + "漢" for k in range(50)] + ["a" * 300, "lo" * 200]
    got = own.encode(texts)
    assert [x.tolist() for x in got] == lib.encode(texts) and [own.decode(x) for x in got] == [lib.decode(x.tolist()) for x in got]
    rows = R.op4_pieces(spark, sf).collect()
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    assert all(r.round_trip and list(r.ids) == lib.encode(docs[r.doc_id]) for r in rows)


def message(*fields):
    """A message in the wire format of model files: (number, value) with value an int, float, bytes or str."""
    import struct

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for k, v in fields:
        if isinstance(v, float):
            out += number(k << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += number(k << 3) + number(v)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += number(k << 3 | 2) + number(len(v)) + v
    return out


@pytest.mark.parametrize("fallback", [False, True])
def test_pieces_of_scores(tmp_path, fallback):
    """Viterbi over a stated vocabulary against the public library, sums of scores by brute force."""
    import sentencepiece

    rng = random.Random(4)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7))) for _ in range(300)}
    plain = [*"abcdé▁", "▁▁", "▁a", "▁ab", "▁abc", *sorted(words)]
    scored = [(p, -1.0 - rng.randrange(4, 900) / 64) for p in plain]  # sums of these are exact
    pieces_ = [message((1, "<unk>"), (2, 0.0), (3, 2))] + [message((1, f"<0x{b:02X}>"), (2, 0.0), (3, 6)) for b in range(256) if fallback] + [message((1, p), (2, s)) for p, s in scored]
    trainer, norm = message((3, 1), (35, int(fallback)), (40, 0), (41, (1 << 64) - 1), (42, (1 << 64) - 1), (43, (1 << 64) - 1)), message((1, "identity"), (3, 1), (4, 0), (5, 1))
    path = str(tmp_path / "unigram.model")
    (tmp_path / "unigram.model").write_bytes(message(*((1, p) for p in pieces_), (2, trainer), (3, norm)))
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path)
    assert isinstance(own, pieces.Unigram) and isinstance(pieces.load(), pieces.BytePair)
    texts = ["".join(rng.choice("aabbccddee  xé漢😀\n") for _ in range(rng.randrange(40))) for _ in range(1500)] + ["", " ", "   a  ", "abc" * 500]
    got, want = own.encode(texts), lib.encode(texts)
    score = dict(scored) | {i: own.least for i in (own.unknown, *own.bytes_)}
    for t, g, w in zip(texts, got, want, strict=True):
        if fallback:
            assert own.decode(g) == t == lib.decode(g.tolist())
        if g.tolist() != w:  # only among equal sums
            total = lambda ids: sum(score.get(lib.id_to_piece(i), 0.0) for i in ids)
            assert total(g.tolist()) == total(w), t
    assert sum(g.tolist() == w for g, w in zip(got, want, strict=True)) > 1400


def test_pieces_generations(monkeypatch):
    """Dropping old words from the cache changes no identifiers."""
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefgh ") for _ in range(6)) for _ in range(30)) for _ in range(200)]
    want = pieces.load().encode(texts)
    monkeypatch.setattr(pieces, "KEPT", 200)
    own = pieces.load()
    assert all((x == y).all() for x, y in zip(chain_(own.encode([t]) for t in texts * 2), want * 2, strict=True))


def chain_(parts):
    return [x for part in parts for x in part]


def test_token_counts(spark, sf, tmp_path):
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    encode = tokencount._encoder(tokencount.RANKS).encode_ordinary
    want = {i: len(encode(t)) for i, t in docs.items()}
    got = tokencount.count(table(spark, sf, "documents"), block_bytes=1 << 10).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    ids = [7, 7, 9, 9, 9, 5, 9, 1, 2, 3, 4]
    (tmp_path / "x.bin").write_bytes(np.array(ids, "<u4").tobytes())
    (tmp_path / "y.bin").write_bytes(b"")
    for block in (4, 8, 12, 4096):
        rows = tokencount.scan_files(spark, f"file://{tmp_path}", 9, "<u4", block).orderBy("ordinal").collect()
        assert [(r.ordinal, r.n_tokens) for r in rows] == [(0, 2), (1, 0), (2, 0), (3, 1), (4, 4)]


def test_cover_tree(spark):
    g = np.random.default_rng(0)
    x, base = g.normal(size=(700, 16)), g.normal(size=(9, 16))
    x[:300] = base[g.integers(0, 9, 300)] + 0.12 * g.normal(size=(300, 16))
    x[300:320] = x[299]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [1.0, None]), (704, [1.0, 2.0]), (705, [2.0, 4.0]), (706, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    label = simhash.join_labels(np.arange(700), *np.nonzero(s))
    for block in (8192, 90):
        got = covertree.near_duplicates(v, 0.9, block).toPandas().set_index("vec_id").sort_index()
        assert (got.n_links[:700] == s.sum(1) - 1).all() and (got.component_id[:700] == label).all()
        assert got.n_links[700:].tolist() == [0, 0, 0, 0, 1, 1, 0] and got.component_id[700:].tolist() == [700, 701, 702, 703, 704, 704, 706]
        assert (got.kept == (got.index == got.component_id)).all()


def test_cover_tree_deals_clusters(spark):
    g = np.random.default_rng(1)
    base = g.normal(size=(30, 32))
    x = np.concatenate([base[g.integers(0, 30, 900)] + 0.15 * g.normal(size=(900, 32)), base[0] + 0.1 * g.normal(size=(400, 32)), g.normal(size=(100, 32))])
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    got = covertree.near_duplicates(v, 0.9, 100).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links == s.sum(1) - 1).all() and (got.component_id == simhash.join_labels(np.arange(len(x)), *np.nonzero(s))).all()
    c = covertree.top_level(u, 14)
    cell = (u @ c.T).argmax(1)
    far = np.array([np.sqrt(np.maximum(0, 2 - 2 * (u @ c.T)[cell == k, k])).max() for k in range(len(c))])
    reach = covertree.reachable(u, cell, c, far, 0.9)
    i, j = np.nonzero(s)
    assert reach[i, cell[j]].all() and reach.mean() < 0.7
    assert covertree.near_duplicates(v.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id or -1, r.n_links) for r in covertree.near_duplicates(twice).collect()) == [(-1, 0), (1, 0), (1, 1), (1, 1)]


def test_media():
    rng = random.Random(1)
    for n in (0, 1, 64, 936, 937, 938, 5000):
        b = rng.randbytes(n)
        s = mpeg.parse(mpeg.pack(b))
        assert s.payload == b and not s.bad and not s.skipped and s.table_ok and s.table_frames == len(s.offsets) and s.table_bytes + s.tag_bytes == len(mpeg.pack(b))
        assert s.seconds == len(s.offsets) * 1152 / 48000
    m = bytearray(mpeg.pack(rng.randbytes(20000)))
    clean = mpeg.parse(bytes(m))
    m[clean.offsets[4] + 10] ^= 1
    assert mpeg.parse(bytes(m)).bad == 1
    m[clean.offsets[9] : clean.offsets[9]] = b"junk\xff\xfb" * 5
    s = mpeg.parse(bytes(m))
    assert s.skipped == 30 and len(s.offsets) == len(clean.offsets)
    assert mpeg.parse(None).payload == b"" and mpeg.parse(b"\xff" * 100).samples == 0


def test_media_tag():
    """Text that looks like a trailing tag is payload; a tag after the last frame is none."""
    for n in (192, 5000):
        for k in range(max(0, n - 400), n - 3):
            b = bytes(k) + b"TAG" + bytes(n - 3 - k)
            m = mpeg.pack(b)
            s = mpeg.parse(m)
            assert s.payload == b and not s.skipped, k
        t = mpeg.parse(m + b"TAG" + bytes(125))
        assert t.payload == b and not t.skipped and t.offsets == s.offsets


def test_media_query(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    for r in R.op9_media(spark, sf).collect():
        b = docs[r.doc_id].encode()
        p = b + bytes(64 * max(1, -(-len(b) // 64)) - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_toxicity_held_out(spark):
    got = R.op6_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    lab = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    m = got.merge(lab, on="doc_id")
    m = m[m.held_out]
    assert m.toxic[m.predicted == 1].mean() > 0.85 and m.predicted[m.toxic == 1].mean() > 0.65


def test_licenses(spark):
    """Families of the templates, no notice in the other sentences, and texts that the model never saw, wrapped ones too."""
    rows = [(k, t, f) for k, (f, t) in enumerate((f, t) for f, ts in licenses.TEMPLATES.items() for t in ts)]
    other = [(1000 + k, t, "") for k, t in enumerate(licenses.OTHERS)] + [(2000, "He has no licence for that, nor a permission.", ""), (2001, "The students at MIT renewed the license of the laboratory under new rules.\nVersion 3 of the general plan is public.", "")]
    unseen = [
        ("Copyright (c) 2024 A. Nobody\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe text goes on.", "mit"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n", "bsd"),
        ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.", "gpl"),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Preamble", "gpl"),
        ("This file is dual MIT/Apache.", "mit-or-apache"),
        ("Dieses Werk steht unter CC BY-SA 4.0.", "cc-by-sa"),
        ("Distributed under the GPL v3.", "gpl"),
        ("Released under CC BY 4.0.", "cc-by"),
        ("Released under CC BY-NC 4.0.", "cc-by-nc"),
        ("Text: CC BY-SA 4.0", "cc-by-sa"),
        ("The code is released under the ISC license.", "isc"),
        ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)", "bsl-1.0"),
        ("A letter to a friend.\nWe went to the sea, and all of the boats were in the bay.\nIt is hereby said that any person may come.", ""),
    ]
    rows += other + [(3000 + k, t, f) for k, (t, f) in enumerate(unseen)]
    got = {r.doc_id: ",".join(r.families) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, family string")).collect()}
    wrong = [(k, t[:60], f, got[k]) for k, t, f in rows if got[k] != f]
    assert not wrong, wrong
    where = {r.doc_id: r.notices for r in licenses.scan(spark.createDataFrame(rows[-13:], "doc_id long, text string, family string")).collect()}
    assert where[3000] == "2:mit" and where[3003] == "0:gpl" and where[3012] == ""


SHORT_NOTICES = [
    ("// SPDX-License-Identifier: CC0-1.0", "cc0"),
    ("// SPDX-License-Identifier: LGPL-3.0-or-later", "lgpl"),
    ("/* SPDX-License-Identifier: GPL-2.0 */", "gpl"),
    ("# SPDX-License-Identifier: GPL-2.0-only", "gpl"),
    (" * SPDX-License-Identifier: GPL-2.0-or-later", "gpl"),
    ("// SPDX-License-Identifier: AGPL-3.0-or-later", "agpl"),
    ("Licensed under the GNU General Public License v2.0", "gpl"),
    ("License: GPL-3.0", "gpl"),
    ('license = "MIT"', "mit"),
    ('  "license": "Apache-2.0",', "apache-2.0"),
    ("License :: OSI Approved :: Apache Software License", "apache-2.0"),
    ("License :: OSI Approved :: MIT License", "mit"),
    ("License :: OSI Approved :: BSD License", "bsd"),
    ("License :: OSI Approved :: Mozilla Public License 2.0 (MPL 2.0)", "mpl"),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY', "mit"),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.", "zlib"),
    ("SPDX-License-Identifier: Zlib", "zlib"),
    ("Text under CC BY-ND 4.0.", "cc-by-nd"),
    ("I do not license this under the MIT license.", ""),
    ("This work is not licensed under the GNU General Public license.", ""),
    ("The Apache-2.0 license does not apply to the logo.", ""),
    ("Read what spdx license identifiers are.", ""),
    ("License: see the file", ""),
    ("Version 1.0 of the license identifier list", ""),
]


def made_notices():
    """Notices in words and forms that no template has, and sentences about licences that are none."""
    out = []
    for family, ids in licenses.IDENTIFIERS.items():
        for i in ids:
            out += [(form.format(i), family) for form in ("/*! SPDX-License-Identifier: {} */", 'license: "{}"', "<license>{}</license>", "@license {}", "The code here is distributed under license {}.")]
            out += [(form.format(i), "") for form in ("It was never put under {}.", "The file is not licensed under {}.", "We talked of {} and other matters.")]
    return out


def test_short_notices(spark):
    """The short notices of the world, each by itself; precision and recall of made ones."""
    rows = [(k, t) for k, (t, _) in enumerate(SHORT_NOTICES)]
    got = {r.doc_id: ",".join(r.families) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(t, got[k]) for k, (t, f) in enumerate(SHORT_NOTICES) if got[k] != f] == []
    made = made_notices()
    got = {r.doc_id: ",".join(r.families) for r in licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(made)], "doc_id long, text string")).collect()}
    right = sum(got[k] == f for k, (_, f) in enumerate(made) if f)
    named, due = sum(map(bool, got.values())), sum(bool(f) for _, f in made)
    assert due > 100 and right / due >= 0.9 and right / named >= 0.9, [(t, f, got[k]) for k, (t, f) in enumerate(made) if got[k] != f]


def test_license_cues():
    """No share of a template's n-grams that confirms it is without a cue, and the pattern finds just the paragraphs with a cue."""
    cue, pattern = licenses.cue_grams(), re.compile(licenses.cues())
    short = {t for ts in licenses.SHORT.values() for t in ts}
    assert all(licenses.grams(licenses.tokens(t)) & cue for t in short)  # these must be there as a whole
    every = [licenses.grams(licenses.tokens(t)) for ts in licenses.TEMPLATES.values() for t in ts if t not in short]
    assert all(len(g - cue) / len(g) < licenses.CONFIRM - 1e-9 for g in every)
    rng = random.Random(2)
    words = sorted({w for g in every for x in g for w in x.split()})
    for _ in range(3000):
        text = "".join(rng.choice(words) + rng.choice((" ", ", ", "-", "\n", "é", "x")) for _ in range(rng.randrange(1, 5)))
        assert bool(pattern.search(text)) == bool(licenses.grams(licenses.tokens(text)) & cue), text


def brute_notices(text, model):
    """Notices of a text by dense scores of every line and run of lines."""
    lines, units = re.split(r"\r?\n", text), []
    for k, x in enumerate(lines):
        units.append((k, k, x))
        if x.strip() and (not k or not lines[k - 1].strip()):
            end = next((e for e in range(k, len(lines)) if not lines[e].strip()), len(lines)) - 1
            units += [(k, end, " ".join(lines[k : end + 1]))] * (end > k)
    weight = {(r.gram, r.family): r.weight for r in model.weights.itertuples()}
    found = []
    for s, e, x in units:
        g = licenses.grams(licenses.tokens(x))
        z = {f: model.bias[f] + sum(weight.get((y, f), 0.0) for y in g) for f in model.families if any((y, f) in weight for y in g)}
        if z:
            top = max(z, key=lambda f: (z[f], f))
            p = 1 - 1 / (1 + sum(np.exp(v) for v in z.values()))
            share = max(0.0 if t in licenses.SHORT[top] and not own <= g else len(g & own) / len(own) for t, own in ((t, licenses.grams(licenses.tokens(t))) for t in licenses.TEMPLATES[top]))
            if p >= model.least and share >= licenses.CONFIRM - 1e-9 and g & licenses.own_grams()[top]:
                found.append((s, e, top))
    return [(s, f) for s, e, f in sorted(found) if s == e or not any(a == b and s <= a <= e and f == o for a, b, o in found)]


def test_licenses_by_brute_force(spark, sf):
    model, rng = licenses.train(), random.Random(11)
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    texts = list(docs.text)[:120]
    every = [t for ts in licenses.TEMPLATES.values() for t in ts]
    for _ in range(120):  # wrapped, cut and mixed
        words = [w for _ in range(rng.randrange(1, 4)) for w in rng.choice([rng.choice(every), rng.choice(licenses.OTHERS)]).split() if rng.random() < 0.95]
        texts.append("".join(w + rng.choice((" ", " ", " ", " ", "\n", "\n\n" if rng.random() < 0.2 else " ")) for w in words))
    got = {r.doc_id: r.notices for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {k: ",".join(f"{s}:{f}" for s, f in brute_notices(t, model)) for k, t in enumerate(texts)}
    assert got == want and sum(map(bool, want.values())) > 40


def test_pipeline(spark, sf):
    docs, columns = table(spark, sf, "documents"), None
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns and docs.count() > 150
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) > 150 and all(len(r.ids) > 0 for r in out)
