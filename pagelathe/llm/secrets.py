"""Secret scans: a keyword automaton, regular expressions anchored at its hits, checksum validation."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that ties of a start go by; the first three are the base ones.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]

# Keywords that a match starts with, by kind, and the patterns anchored there.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
PATTERNS = {
    "assign": re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]{8,}+)\.(eyJ[A-Za-z0-9_-]{8,}+)\.[A-Za-z0-9_-]{16,}+"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----\s[A-Za-z0-9+/=\s]{64,}+-----END (?:[A-Z]+ )?PRIVATE KEY-----"),
}
HEX = re.compile(r"[0-9a-f]{24,}+")
#: What a failed match rules out: a token whose first part begins within the same run fails by the same parts after it.
RUNS = {"jwt": re.compile(r"[A-Za-z0-9_-]*+")}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = {i: i + 32 for i in range(65, 91)}


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _base62(x: int) -> str:
    out = ""
    while x:
        x, d = divmod(x, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


def _valid(kind: str, m: re.Match) -> bool:
    """Lengths, and the checksum or structure that a kind carries within."""
    if kind == "assign":
        return len(m[1]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    if kind in ("github", "npm"):
        return _base62(zlib.crc32(m[1].encode())) == m[2]
    if kind == "jwt":
        try:
            head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
        except (ValueError, RecursionError):  # no text, no JSON, or nested deeper than any header is
            return False
        return isinstance(head, dict) and "alg" in head
    return True


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets of a text, by start, then kind; code points, end exclusive. A null text is empty; time grows with the length of the text alone, whatever it holds."""
    text = text or ""
    low = text.lower() if text.isascii() else text.translate(LOWER)
    hits: dict[str, set[int]] = {}
    for end, (kind, n) in _automaton().iter(low):
        hits.setdefault(kind, set()).add(end + 1 - n)
    out = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for kind, starts in hits.items():
        free = 0  # a match, valid or not, takes its text from later ones of its kind
        for s in sorted(starts):
            if s < free:
                continue
            if m := PATTERNS[kind].match(text, s):
                free = m.end()
                if _valid(kind, m):
                    out.append((kind, s, m.end()))
            elif kind in RUNS:
                free = RUNS[kind].match(text, s).end()
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, spans array<struct<kind, start, end>>.

    Null and empty texts have no spans; repeated rows come repeatedly; very long texts are scanned whole; an empty table
    gives an empty result; other columns play no part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in x["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and joined spans of what scan() returns."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scanned.select("doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    """The digest of base spans, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE).encode()).hexdigest()
