"""Packing, spelling variants and vector codes against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagelathe.llm import codes, packing, spelling
from pagelathe.llm import registry as R
from pagelathe.llm.common import table

DOCS = "doc_id long, text string, lang string, ids string, n string, word string, key string, loss string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(1, ""), (2, None), (3, " ".join(f"wordling{i % 977} colour" for i in range(20000))), (4, "one two colour"), (4, "one two colour"), (None, "colours COLOURS"), (5, " İstanbul <|endoftext|> Å ﬁne \t\n😀é" + "a" * 5000)]
    return spark.createDataFrame([(i, t, None, "x", "x", "x", "x", None) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.MODEL)


def sequences(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.sequence_id].append(r)
    return out


def check_pieces(rows, want, tokens, segments, loss):
    """Each identifier of the examples (key, identifiers) lies in one piece, sequences are gapless and within their limits."""
    for s in sequences(rows).values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(r.length for r in s[:i]) for i in range(len(s))]
        assert sum(r.length for r in s) <= tokens and len(s) <= segments and sum(r.loss for r in s) <= loss
    assert all(r.length * 4 == len(r.ids) and r.length > 0 for r in rows)
    whole = collections.defaultdict(list)
    for r in rows:
        whole[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    got = {k: sorted(v) for k, v in whole.items()}
    due = collections.defaultdict(list)
    for key, ids in want:
        due[key, len(ids)].append(ids)
    assert got.keys() == due.keys()
    for k, pieces in got.items():
        copies = due[k]
        assert sum(len(x) for _, x in pieces) == sum(map(len, copies))
        if len(copies) == 1:
            assert [i for _, x in pieces for i in x] == copies[0]
            assert [s for s, _ in pieces] == [sum(len(x) for _, x in pieces[:i]) for i in range(len(pieces))]


def padding(rows, tokens):
    sizes = [sum(r.length for r in s) for s in sequences(rows).values()]
    return sum(0 if n & (n - 1) == 0 else tokens - n for n in sizes) / sum(sizes)


def test_packed_documents(spark, sf, tokenizer):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = packing.pack(packing.documents(docs)).collect()
    want = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
    check_pieces(rows, want, 4096, 256, 4096)
    assert padding(rows, 4096) < 0.005
    got = {(r.doc_id, r.start): r for r in R.op11_packing(spark, sf).collect()}
    assert all(got[r.doc_id, r.start].ids_crc32 == zlib.crc32(r.ids) for r in rows) and len(got) == len(rows)


def test_packed_odd(spark, odd, tokenizer):
    rows = packing.pack(packing.documents(odd), tokens=256, segments=3, loss=200).collect()
    check_pieces(rows, [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd.collect()], 256, 3, 200)
    assert packing.pack(packing.documents(odd.limit(0))).count() == 0
    assert [(r.length, r.doc_tokens, r.loss) for r in packing.pack(spark.createDataFrame([(1, None, None), (2, [None], [None])], "doc_id long, texts array<string>, bears array<boolean>")).collect()] == [(1, 1, 0), (1, 1, 0)]


@pytest.mark.parametrize("cut", [True, False])
def test_packed_chats(spark, sf, tokenizer, cut):
    turns = table(spark, sf, "conversations")
    rows = packing.pack(packing.chats(turns), tokens=512, segments=4, loss=128, cut=cut).collect()
    by = collections.defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        by[r.conv_id].append((r.role, tokenizer.encode(r.text or "", add_special_tokens=False).ids))
    check_pieces(rows, [(k, [i for _, x in v for i in x] + [2]) for k, v in by.items()], 512, 4, 128)
    bears = {k: sum(len(x) for role, x in v if role == "assistant") + (v[-1][0] == "assistant") for k, v in by.items()}
    got = collections.Counter()
    for r in rows:
        got[r.doc_id] += r.loss
    assert {k: got[k] for k in bears} == bears
    if not cut:  # an example within the limits stays whole
        pieces = collections.Counter(r.doc_id for r in rows)
        assert all(pieces[k] == 1 for k, v in by.items() if sum(len(x) for _, x in v) < 512 and bears[k] <= 128)


def plain_packing(vectors, limits):
    """The heuristic said plainly: vectors of the sequences in order."""
    left, out = list(vectors), []
    while left:
        weight = [sum(v[d] / limits[d] for v in left) + 1e-9 for d in range(3)]
        room, own = list(limits), []
        while fits := [v for v in left if all(v[d] <= room[d] for d in range(3))]:
            best = max(fits, key=lambda v: (round(sum(v[d] / limits[d] * weight[d] * room[d] / limits[d] for d in range(3)), 9)))
            left.remove(best)
            own.append(best)
            room = [room[d] - best[d] for d in range(3)]
        out.append(own)
    return out


def test_dot_product_choice():
    rng = random.Random(4)
    limits = (100, 6, 60)
    examples = [(n := rng.randint(1, 90), min(n, rng.randint(0, 50))) for _ in range(300)]
    packer = packing.Packer(*limits, cut=False)
    for i, (n, loss) in enumerate(examples):
        assert not list(packer.add(i, np.zeros(n, np.uint32), np.arange(n) < loss))
    got = [[(len(p[2]), 1, int(p[3].sum())) for p in s] for s in packer.pack(True)]
    assert got == plain_packing([(n, 1, loss) for n, loss in examples], limits)


def test_forgetful_encoder(monkeypatch, tokenizer):
    import pyarrow as pa

    monkeypatch.setattr(packing, "WORDS", 3)
    code = packing.Encoder(packing.MODEL)
    for texts in (["a b c d", "", "  it's\tÅ"], ["a", "b b\x0bb"]):
        ids, ends = code.encode(pa.array(texts))
        got = [ids[s:e].tolist() for s, e in zip([0, *ends], ends)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def near(a, b):
    """One edit apart, said plainly."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    out, form = {}, {}
    for w in n:
        others = [x for x in n if x != w and abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = len(others)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], out[w], n.get(form[w]))
    return out


def told(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling(spark):
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcdeéèz") for _ in range(rng.randint(7, 10))) for _ in range(40)]
    docs = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = stems[min(int(rng.expovariate(0.15)), 39)]
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "ø" + w[k:], w[:k] + "q" + w[k + 1 :], w.upper()])
            words.append(w)
        docs.append((i, rng.choice([" ", "-", "1"]).join(words)))
    docs += [(None, None), (7, ""), (3, docs[3][1]), (None, docs[5][1])]
    # a chain of forms: each ten times as frequent as the one before
    docs += [(1000 + i, " ".join(["chainlinks"] * 2 + ["chainlinka"] * 24 + ["chainlikka"] * 260)) for i in range(1)]
    want = brute_words(docs)
    got = told(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == want
    assert any(v[0] and v[1] != v[0] for v in want.values()) and sum(v[3] for v in want.values()) > 50


def test_spelling_odd(spark, odd):
    got = told(spelling.variants(odd))
    assert got == brute_words([(r.doc_id, r.text) for r in odd.collect()])
    assert spelling.variants(odd.limit(0)).count() == 0


def test_parity_flips(spark):
    rng = random.Random(2)
    letters = "".join(spelling.band_letters())
    assert len(set(letters)) == 90
    rows = []
    for _ in range(200):
        w = "".join(rng.choice(letters) for _ in range(8))
        k, x = rng.randrange(8), rng.choice(letters)
        rows.append((w, rng.choice([w[:k] + w[k + 1 :], w[:k] + x + w[k:], w[:k] + x + w[k + 1 :]])))
    df = spark.createDataFrame(rows, "a string, b string")
    masks = df.select(*(spelling.parity(df[c], x).alias(f"{c}{i}") for c in "ab" for i, x in enumerate(spelling.band_letters()))).collect()
    for r in masks:
        flips = [(r[i] ^ r[i + 3]).bit_count() for i in range(3)]
        assert sum(flips) <= 2 and 0 in flips


def brute_codes(rows, parts=4):
    """(rows as told, digest), said plainly."""
    size = None
    kept = []
    for i, e, label in sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        size = size or len(e)
        if len(e) == size:
            kept.append((i, [math.floor(1024 * x) for x in e], label))
    w = size // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in kept[:256]] for p in range(parts)]
    assign = lambda v, p: min((far(cut(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(4):
        new = []
        for p in range(parts):
            of = collections.defaultdict(list)
            for _, v, _ in kept:
                of[assign(v, p)[1]].append(cut(v, p))
            new.append([[sum(x) // len(of[k]) for x in zip(*of[k])] if k in of else c for k, c in enumerate(books[p])])
        books = new
    out = []
    for i, v, label in kept:
        got = [assign(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), label))
    total = collections.Counter()
    for _, _, e, label in out:
        total[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, v string, code string, part string"


@pytest.mark.parametrize(("size", "n", "scale"), [(8, 400, 1.0), (4, 30, 0.01), (24, 300, 50.0), (8, 60, 1e30)])
def test_codes(spark, size, n, scale):
    rng = np.random.default_rng(size * n)
    centres = rng.normal(size=(12, size))
    rows = [(int(i), [float(x) for x in np.float32(scale * (centres[rng.integers(12)] + 0.1 * rng.normal(size=size)))], [0, 0, None, 2][i % 4]) for i in rng.permutation(n)]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [float("nan")] * size, 1), (n + 3, [1.0] * (size - 1) + [None], 0), (n + 4, [float("inf")] * size, 0), (n + 5, [0.0] * size, None), rows[0], (None, rows[1][1], 0), (n + 6, [1.0] * (size + 4), 0)]
    df = spark.createDataFrame([(i, e, label, "x", None, "x") for i, e, label in rows], VECTORS).repartition(5)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compressed(df).collect()), key=repr)
    want = brute_codes(rows)
    if scale > 1e20:  # errors beyond 64 bits are null
        got, want = [(r[0], r[1], r[4]) for r in got], [(r[0], r[1], r[4]) for r in want]
    assert got == want


def test_codes_empty(spark):
    df = spark.createDataFrame([(1, None, 1, "x", "x", "x")], VECTORS)
    for rows in (df, df.limit(0)):
        out = codes.compressed(rows)
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0


@pytest.mark.parametrize("sparse", [0, 10**9])
def test_bounds_lose_nothing(monkeypatch, sparse):
    """The filtered search finds what comparing all finds, ties to the lower entry, and leaves most entries out."""
    monkeypatch.setattr(codes, "SPARSE", sparse)
    rng = np.random.default_rng(1)
    entries = rng.integers(-300, 300, (200, 16)) * np.linspace(0.2, 3, 200)[:, None]
    entries = np.concatenate((entries, entries[::3])).astype(np.int64)
    x = np.concatenate((rng.integers(-900, 900, (500, 16)), entries[:50], entries[:50] + 1, np.zeros((2, 16), np.int64)))
    d = ((x[:, None] - entries[None]) ** 2).sum(-1)
    k, best = codes.Codebook(entries).nearest(x)
    assert (k == d.argmin(1)).all() and (best == d.min(1)).all()
