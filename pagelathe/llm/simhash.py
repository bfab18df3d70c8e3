"""SimHash near-duplicates: vertical bit planes, carry-save counters, early abandonment."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, pi

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.llm.common import cut
from pagelathe.llm.graph import components

U64 = np.uint64
FULL = U64(0xFFFFFFFFFFFFFFFF)
#: Rows of a block: larger groups are dealt out as pairs of blocks.
BLOCK = 4096


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of `text`, A-Z lowered, repeats included; of the whole sequence if it is shorter; none without words."""
    got = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not got:
        return np.empty(0, U64)
    flat, digest = b" ".join(got), xxhash.xxh64_intdigest
    if len(got) <= words:
        return np.array([digest(flat, 42)], U64)
    ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(got) - words + 1
    return np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), U64, n)


def majority(h: np.ndarray) -> int:
    """The 64 bits set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = np.ascontiguousarray(h[i : i + (1 << 15)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(U64)[0])


def mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of each hash (a public finaliser of three multiply-xorshift steps); k = 0 gives the hash itself."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        x = h + U64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n, parts): row b holds bit b of all of them, 64 to a word."""
    n = len(fp)
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    wide = np.zeros((len(packed), -(-n // 64) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(U64)


def _lanes(mask: np.ndarray) -> np.ndarray:
    """Booleans as words of 64 lanes."""
    out = np.zeros(-(-len(mask) // 64) * 8, np.uint8)
    packed = np.packbits(mask, bitorder="little")
    out[: len(packed)] = packed
    return out.view(U64)


class Counter:
    """Carry-save counters of differing bits, one per lane, that remember which passed the radius."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.digits = max(1, radius.bit_length())
        self.start = (1 << self.digits) - 1 - radius
        self.c = [np.full(shape, FULL if self.start >> i & 1 else U64(0)) for i in range(self.digits)]
        self.over = np.zeros(shape, U64)

    def add(self, x: np.ndarray) -> None:
        for i in range(self.digits):
            carry = self.c[i] & x
            self.c[i] ^= x
            x = carry
        self.over |= x

    def keep(self, at: np.ndarray) -> None:
        """Go on with these blocks (last axis) alone."""
        self.c = [c[..., at] for c in self.c]
        self.over = self.over[..., at]


def near_shift(p: np.ndarray, d: int, alive: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i, of those alive, whose fingerprint lies within the radius of that of lane i + d. p: bit planes."""
    q, r = divmod(d, 64)
    at = np.flatnonzero(alive)
    pad = np.concatenate([p[:, q:], np.zeros((len(p), q + 1), U64)], axis=1)
    count = Counter((len(at),), radius)
    live = alive[at]
    for b in range(len(p)):
        low = pad[b, at] >> U64(r)
        count.add(p[b, at] ^ (low | (pad[b, at + 1] << U64(64 - r)) if r else low))
        if b % 8 == 7:
            left = (live & ~count.over) != 0
            if not left.any():
                return np.empty(0, np.int64)
            if left.mean() < 0.5:
                at, live = at[left], live[left]
                count.keep(left)
    hit = np.zeros(len(alive), U64)
    hit[at] = live & ~count.over
    return np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))


def near_block(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of a, j of b) within the radius, some queries of a at a time against the planes of b."""
    p = planes(b)
    w = p.shape[1]
    live = _lanes(np.ones(len(b), bool))
    for s in range(0, len(a), 256):
        q = a[s : s + 256]
        bits = np.unpackbits(np.ascontiguousarray(q).view(np.uint8).reshape(len(q), -1), axis=1, bitorder="little").astype(bool)
        count, at = Counter((len(q), w), radius), np.arange(w)
        for k in range(p.shape[0]):
            count.add(p[k, at][None, :] ^ np.where(bits[:, k], FULL, U64(0))[:, None])
            if k % 16 == 15:
                left = ((live[at][None, :] & ~count.over) != 0).any(0)
                if not left.any():
                    break
                if left.mean() < 0.5:
                    at = at[left]
                    count.keep(left)
        else:
            hit = np.zeros((len(q), w), U64)
            hit[:, at] = live[at][None, :] & ~count.over
            i, j = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little"))
            yield i + s, j


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest index reachable so far) after the links (i, j)."""
    while len(i):
        m = np.minimum(label[i], label[j])
        for x in (label[i], label[j], i, j):
            np.minimum.at(label, x, m)
        while (label != (up := label[label])).any():
            label = up
        left = label[i] != label[j]
        i, j = i[left], j[left]
    return label


def _stars(label: np.ndarray, node: np.ndarray) -> pd.DataFrame:
    """The links of a spanning forest: each row to the first of its group."""
    at = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"a": node[at], "b": node[label[at]]})


def _labels(rows: pd.DataFrame, radius: int) -> np.ndarray:
    """For each of the rows (key, half, fp: bytes), sorted by key, the first row reachable within its key. Half 0 or 1: the rows of two different blocks, compared across; -1: all with all."""
    key, half = rows["key"].to_numpy(), rows["half"].to_numpy()
    fp = np.frombuffer(b"".join(rows["fp"]), U64).reshape(len(rows), -1)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    out = np.arange(len(rows))
    small = np.repeat((size > 1) & (size <= 48) & (half[edge[:-1]] < 0), size)
    if small.any():
        k, f, place = key[small], fp[small], np.flatnonzero(small)
        p, label, d = planes(f), np.arange(len(k)), 1
        while d < len(k) and (same := k[d:] == k[:-d]).any():
            hit = near_shift(p, d, _lanes(np.concatenate((same, np.zeros(d, bool)))), radius)
            label = join_labels(label, hit, hit + d)
            d += 1
        out[place] = place[label]
    for s, e in zip(edge[:-1][size > 1].tolist(), edge[1:][size > 1].tolist(), strict=True):
        if e - s <= 48 and half[s] < 0:
            continue
        label = np.arange(e - s)
        if half[s] < 0:
            for i, j in near_block(fp[s:e], fp[s:e], radius):
                label = join_labels(label, i, j)
        else:
            a, b = (np.flatnonzero(half[s:e] == x) for x in (0, 1))
            if len(a) and len(b):
                for i, j in near_block(fp[s:e][a], fp[s:e][b], radius):
                    label = join_labels(label, a[i], b[j])
        out[s:e] = s + label
    return out


def _dealt(keyed: DataFrame, block: int) -> DataFrame:
    """keyed (key long, fp binary, node long and others) with half, sorted by key in each partition. Keys of more than `block` rows are dealt out as pairs of blocks, so no task holds more than two blocks of a key, whatever its size."""
    hot = keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("parts"))
    rows = keyed.join(hot, "key", "left")
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts"))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = rows.withColumn("part", part).withColumn("other", other)
    dealt = dealt.select(
        F.when(F.col("other") < 0, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))).alias("key"),
        F.when((F.col("other") < 0) | (F.col("part") == F.col("other")), -1).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("half"),
        *(c for c in keyed.columns if c != "key"),
    )
    return dealt.repartition(F.col("key")).sortWithinPartitions("key")


def _whole_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by key, cut anew so that each key's rows come together."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch["key"].iloc[-1]
        start = int(np.argmax(batch["key"].to_numpy() == last))
        if start or (held and held[-1]["key"].iloc[-1] != last):
            yield pd.concat([*held, batch.iloc[:start]], ignore_index=True)
            held = [batch.iloc[start:]]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def link_keyed(keyed: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) between nodes whose fingerprints share a key and differ in at most `radius` bits.

    keyed: key long, fp binary (whole 64-bit words), node long. Hot keys are dealt out as pairs of blocks; links come
    out as spanning forests, never as all pairs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_keys(batches):
            yield _stars(_labels(rows, radius), rows["node"].to_numpy())

    return _dealt(keyed, block).mapInPandas(run, "a long, b long")


def _similar(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Spanning links, within each key of rows (key, node, shingles: bytes of distinct 64-bit hashes), of the pairs whose sets have at least the Jaccard similarity. Pairs that other links join already are not compared."""
    key, node = rows["key"].to_numpy(), rows["node"].to_numpy()
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    out = []
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if e - s < 2:
            continue
        sets = [np.frombuffer(x, U64) for x in rows["shingles"].iloc[s:e]]
        size = np.fromiter(map(len, sets), np.int64, e - s)
        vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.split(ids.astype(np.int32), np.cumsum(size)[:-1])
        mark, label = np.zeros(len(vocabulary), np.int64), np.arange(e - s)
        for i in range(e - s - 1):
            fits = np.minimum(size[i], size[i + 1 :]) >= similarity * np.maximum(size[i], size[i + 1 :]) - 1e-9
            at = i + 1 + np.flatnonzero(fits & (label[i + 1 :] != label[i]) & (size[i + 1 :] > 0))
            # some sets at a time, so that long texts are never gathered all at once
            for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(size[at]) >> 22)) + 1) if len(at) else ():
                mark[own[i]] = 1
                starts = np.concatenate(([0], np.cumsum(size[part])[:-1]))
                both = np.add.reduceat(mark[np.concatenate([own[j] for j in part.tolist()])], starts)
                mark[own[i]] = 0
                hit = part[both / (size[i] + size[part] - both) >= similarity]
                if len(hit):
                    joined = np.unique(np.append(label[hit], label[i]))
                    label[np.isin(label, joined)] = joined[0]
        out.append(_stars(label, node[s:e]))
    return pd.concat(out) if out else pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long): the 64-bit SimHash of each text's word shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fp = np.array([majority(shingle_hashes(t, words)) for t in x["text"]], U64).view(np.int64)
            yield pd.DataFrame({"k": x["k"], "fp": fp})

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text")).mapInPandas(run, "k long, fp long").withColumnRenamed("k", key)


def band_keys(radius: int, chosen: int = 2, bits: int = 64) -> list[F.Column]:
    """Key columns over `fp`: all choices of `chosen` of radius + chosen bands. Fingerprints within the radius agree on one of them at least."""
    n = radius + chosen
    at = [bits * i // n for i in range(n + 1)]
    out = []
    for c, pick in enumerate(combinations(range(n), chosen)):
        value, width = F.lit(c).cast("long"), 0
        for i in pick:
            w = at[i + 1] - at[i]
            value = F.shiftleft(value, w).bitwiseOR(F.shiftrightunsigned("fp", at[i]).bitwiseAND(F.lit((1 << w) - 1)))
            width += w
        out.append(value)
    return out


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, chosen: int = 2) -> DataFrame:
    """One row per document: doc_id, fp long, component_id long (smallest doc_id reachable over links of `radius` or fewer differing bits).

    Null and empty texts have fingerprint 0 and link like any other; rows that repeat a doc_id stay rows; rows without
    doc_id link like any other, and a group of such rows alone has a null component_id. Equal fingerprints count once;
    the others meet in blocks that share `chosen` of radius + `chosen` bands of bits, which no pair within the radius
    can miss, and are compared there bit-sliced. Very long texts are taken whole; an empty table gives an empty result;
    columns other than doc_id and text play no part.
    """
    marked = cut(fingerprints(docs, words))
    one = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    keyed = one.select(F.explode(F.array(*band_keys(radius, chosen))).alias("key"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("bits"), F.col("fp").alias("node")).withColumnRenamed("bits", "fp")
    groups = components(link_keyed(keyed, radius)).withColumnRenamed("node", "fp")
    named = one.join(groups, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(least, "component").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


#: 64-bit parts of the wider fingerprint, minima by which texts meet, and rows of a block whose shingle sets one task holds.
PARTS, MINIMA, SETS = 4, 8, 1024


def radius_of(similarity: float, bits: int = 64 * PARTS, margin: float = 6) -> int:
    """Differing bits within which sets of at least this Jaccard similarity lie, `margin` standard deviations above the mean of those at it. The margin is wide as sets of a few shingles lie further apart than the angle says."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return ceil(bits * p + margin * (bits * p * (1 - p)) ** 0.5 - 1)


def wide_fingerprint(h: np.ndarray) -> tuple[bytes, list[int]]:
    """The fingerprint of a set of distinct shingles, 64 * PARTS bits, and its minima under MINIMA hash functions."""
    fp = np.array([majority(mix(h, k)) for k in range(PARTS)], U64).tobytes()
    low = [int((mix(h, 100 + k)).min()) if len(h) else k for k in range(MINIMA)]
    return fp, np.array(low, U64).view(np.int64).tolist()


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, block: int = SETS) -> DataFrame:
    """(doc_id, component_id) of each distinct doc_id and shingle set: groups of texts whose sets of word shingles are similar.

    Texts meet in blocks by any of MINIMA least hashes, of which a pair at the similarity shares at least one with
    probability 1 - (1 - similarity)^MINIMA (0.999997 at 0.8). The bit-sliced comparison of wide fingerprints only
    leaves out pairs that are far apart (see radius_of); of the texts it leaves, the shingle sets are compared, and
    these alone make links. Texts without words are alike. Rows that share a doc_id are one document. Rows with a null
    doc_id group only with rows that have one.
    """

    def sets_of(texts: pd.Series) -> list[np.ndarray]:
        return [np.unique(shingle_hashes(t, words)) for t in texts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fp, low, same = [], [], []
            for h in (np.unique(shingle_hashes(t, words)) for t in x["text"]):
                f, k = wide_fingerprint(h)
                fp.append(f), low.append(k), same.append(xxhash.xxh128_digest(h.tobytes(), 42))
            yield pd.DataFrame({"doc_id": x["doc_id"], "same": same, "fp": fp, "low": low})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_keys(batches):
            label = _labels(rows, radius)
            at = np.flatnonzero(np.bincount(label, minlength=len(rows))[label] > 1)
            yield pd.DataFrame({"key": rows["key"].to_numpy()[at], "lead": rows["node"].to_numpy()[label[at]], "node": rows["node"].to_numpy()[at], "same": rows["same"].to_numpy()[at]})

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for s in range(0, len(x), 256):  # sets are larger than texts, so they leave in parts
                sets = sets_of(x["text"].iloc[s : s + 256])
                yield pd.DataFrame({"same": [xxhash.xxh128_digest(h.tobytes(), 42) for h in sets], "shingles": [h.tobytes() for h in sets]})

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_keys(batches):
            yield _similar(rows, similarity)

    radius = radius_of(similarity)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = cut(texts.mapInPandas(run, "doc_id long, same binary, fp binary, low array<long>"))
    one = marked.groupBy("same").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.min("low").alias("low"))
    keyed = one.where("node IS NOT NULL").select(F.posexplode("low").alias("k", "key"), "fp", "node", "same").select(F.xxhash64("k", "key").alias("key"), "fp", "node", "same")
    found = cut(_dealt(keyed, block).mapInPandas(near, "key long, lead long, node long, same binary"))
    wanted = texts.join(found.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = wanted.mapInPandas(shingles, "same binary, shingles binary").dropDuplicates(["same"])
    rows = found.select(F.xxhash64("key", "lead").alias("key"), "node", "same").join(sets, "same").select("key", "node", "shingles")
    groups = components(rows.repartition(F.col("key")).sortWithinPartitions("key").mapInPandas(check, "a long, b long"))
    named = one.select("same", "node").join(groups, "node", "left").select("same", F.coalesce("component", "node").alias("component_id"))
    return marked.select("doc_id", "same").distinct().join(named, "same", "left").select("doc_id", "component_id")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one document of each group of near_groups(): the one with the smallest doc_id. Rows that repeat a doc_id and text go but for one; rows with a null doc_id stay unless a row with one is near them. Null and empty texts are alike; other columns stay, whatever their names; an empty table gives an empty one."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("tie"))
    kept = near_groups(docs, words, similarity).where("doc_id = component_id OR (doc_id IS NULL AND component_id IS NULL)").select(F.col("doc_id").alias("kept")).distinct()
    rows = rows.join(kept, F.col("doc").eqNullSafe(F.col("kept")), "left_semi")
    w = Window.partitionBy("doc", "tie").orderBy("tie")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select(*(F.col("row")[c].alias(c) for c in docs.columns))
