"""Mixing sources to target weights: fixed-length blocks, multinomial draws by shard, index permutations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelathe.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block.
BLOCK_WORDS = 64
#: Parts that a source is split into for running sums, so that a source with most rows is no single group.
PARTS = 4096
U64 = np.uint64


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Targets that share `total` by weight; those above `most` times their size stop there, and what is over goes to the others by weight."""
    cap = [most * s for s in sizes]
    target, open_ = list(cap), set(range(len(sizes)))
    while open_:
        left, w = total - sum(c for i, c in enumerate(cap) if i not in open_), sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * left / w > cap[i]}
        if not over:
            for i in open_:
                target[i] = weights[i] * left / w
            break
        open_ -= over
    return target


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + U64(key)) * U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
        return x ^ (x >> U64(32))


class Permutation:
    """A keyed pseudorandom permutation of 0..n-1 that needs no table: four Feistel rounds over the next even number of bits, walked on until the value is in range."""

    def __init__(self, n: int, *key: int):
        self.n, self.half = n, U64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = U64((1 << int(self.half)) - 1)
        self.keys = [int(np.random.SeedSequence([*key, r]).generate_state(1, np.uint64)[0]) for r in range(4)]

    def _once(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in keys:
            a, b = b, a ^ (_scramble(b, k) & self.mask)
        return b << self.half | a  # the halves swap at the end, so the keys in reverse undo it

    def _walk(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        x = self._once(np.asarray(x, U64), keys)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys)

    def inverse(self, y: np.ndarray) -> np.ndarray:
        return self._walk(y, self.keys[::-1])


@dataclass
class Source:
    """A source's stream of words and the slots that the mix draws from it."""

    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    limit: int  # words of the last slot


def _source(k: int, name: str | None, size: int, target: float, block: int, seed: int) -> Source:
    """Slots that hold exactly the target's words: whole passes over the blocks, then permuted blocks, the last one cut short."""
    want = min(round(target), 2 * size) if size else 0
    blocks = -(-size // block)
    passes, rest = divmod(want, size) if size else (0, 0)
    if not rest:
        return Source(name, size, target, blocks, passes * blocks, block)
    short = block * blocks - size
    place = int(Permutation(blocks, seed, k, passes).inverse(np.array([blocks - 1]))[0])
    words = lambda r: r * block - short * (place < r)
    r = -(-rest // block)
    r += words(r) < rest
    own = block - short * (place == r - 1)
    return Source(name, size, target, blocks, passes * blocks + r, own - (words(r) - rest))


def draw_shards(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) counts: each shard's are a multinomial draw by the sources' share of the slots. Draws beyond a source's slots go, in order, to sources that lack some, so that all slots are drawn."""
    total = int(slots.sum())
    size = np.diff(np.linspace(0, total, shards + 1).astype(np.int64))
    p = slots / max(total, 1)
    c = np.stack([np.random.default_rng([seed, i]).multinomial(m, p) if total else np.zeros(len(slots), np.int64) for i, m in enumerate(size)])
    c = np.clip(slots - (np.cumsum(c, 0) - c), 0, c)
    free, lack, s = size - c.sum(1), slots - c.sum(0), 0
    for i in np.flatnonzero(free):
        while free[i]:
            while not lack[s]:
                s += 1
            n = min(free[i], lack[s])
            c[i, s] += n
            free[i] -= n
            lack[s] -= n
    return c


class Mix:
    """A mix of all rows of `docs` (doc_id, source, text, any others): see plan, placed, slots, rows."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2, block: int = BLOCK_WORDS, shard_slots: int = 65536, seed: int = 42):
        """weights: for the sources by code point, null last, over and over. share: of all sizes, what the targets add up to. most: of its size, a target's limit, 2 at most.

        Size is the number of words; null texts and texts without words have size 0 and give nothing. Repeated rows are
        rows of their own; ties of doc_id are ordered by text. Without sized rows the mix is empty. Sums by source and
        part of a source are all that reaches the driver; the shards' counts are at most four million numbers.
        """
        self.block, self.seed, self.docs = block, seed, docs
        self.spark = docs.sparkSession
        self.sized = cut(self._sized(docs).select("doc_id", "source", "part", "tie", "size"))
        sums = cut(self.sized.groupBy("source", "part").agg(F.sum("size").alias("n")))
        by = {r["source"]: r["n"] or 0 for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
        names = sorted((x for x in by if x is not None)) + [None] * (None in by)
        sizes = [by[x] for x in names]
        targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(sizes), most) if names else []
        self.plan = [_source(k, x, n, t, block, seed) for k, (x, n, t) in enumerate(zip(names, sizes, targets, strict=True))]
        self.sources = self.spark.createDataFrame(pd.DataFrame([(k, s.name, s.size, s.target) for k, s in enumerate(self.plan)], columns=["s", "name", "source_size", "target"]).astype({"s": "int64", "source_size": "int64", "target": "float64"}), "s long, name string, source_size long, target double")
        w = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        self.bases = sums.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
        slots = np.array([s.slots for s in self.plan], np.int64)
        shards = int(min(4096, max(1, 4_000_000 // max(len(slots), 1)), -(-int(slots.sum()) // shard_slots) or 1))
        counts = draw_shards(slots, shards, seed) if len(slots) else np.zeros((1, 0), np.int64)
        first = np.cumsum(counts, 0) - counts
        place = np.cumsum(counts, 1) - counts
        i, k = np.nonzero(counts)
        self.draws = pd.DataFrame({"shard": i, "s": k, "place": place[i, k], "first": first[i, k], "n": counts[i, k]}).astype("int64")

    @staticmethod
    def _sized(docs: DataFrame) -> DataFrame:
        """(doc_id, source, whole, size, part, tie); whole holds all columns, so none of theirs clashes with those made here."""
        text = F.col("text").cast("string")
        size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
        return docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), size.alias("size"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"), F.xxhash64(text).alias("tie"))

    def placed(self, docs: DataFrame | None = None) -> DataFrame:
        """Rows with s (source number), row (unique within s) and start (the first word's place in the source's stream). docs: rows as given at first, for whole (all their columns)."""
        sized = self.sized if docs is None else self._sized(docs)
        w = Window.partitionBy("source", "part").orderBy("doc_id", "tie")
        back = w.rowsBetween(Window.unboundedPreceding, -1)
        run = sized.withColumns({"row": F.row_number().over(w) * F.lit(PARTS).cast("long") + F.col("part"), "in_part": F.coalesce(F.sum("size").over(back), F.lit(0))})
        named = self.sources.select("s", F.col("name").alias("s_source"))
        run = run.join(F.broadcast(named) if len(self.plan) <= 100_000 else named, F.col("source").eqNullSafe(F.col("s_source")))
        run = run.join(self.bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part")), "left")
        return run.withColumn("start", F.col("base") + F.col("in_part")).drop("b_source", "b_part", "s_source", "base", "in_part", "tie", "part")

    def slots(self) -> DataFrame:
        """(shard, slot, s, pass, block, limit): each output slot's block, by its source's permutation for that pass; limit: words taken of it."""
        plan, block, seed = [(x.blocks, x.slots, x.limit) for x in self.plan], self.block, self.seed

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            made: dict[tuple[int, int], Permutation] = {}
            for x in batches:
                for shard, s, place, first, n in x[["shard", "s", "place", "first", "n"]].itertuples(index=False):
                    blocks, slots, limit = plan[s]
                    for at in range(0, n, 100_000):
                        k = np.arange(at, min(n, at + 100_000)) + first
                        passes, where = np.divmod(k, blocks)
                        to = np.empty(len(k), np.int64)
                        for p in np.unique(passes):
                            if (s, p) not in made:
                                made = {} if len(made) > 10_000 else made
                                made[s, p] = Permutation(blocks, seed, s, int(p))
                            to[passes == p] = made[s, p](where[passes == p])
                        yield pd.DataFrame({"shard": shard, "slot": place + k - first, "s": s, "pass": passes, "block": to, "limit": np.where(k == slots - 1, limit, block)})

        draws = self.spark.createDataFrame(self.draws, "shard long, s long, place long, first long, n long") if len(self.draws) else self.spark.createDataFrame([], "shard long, s long, place long, first long, n long")
        return draws.repartition(max(1, min(len(self.draws), 512)), "shard", "s").mapInPandas(run, "shard long, slot long, s long, pass long, block long, limit long")

    def rows(self, placed: DataFrame | None = None) -> DataFrame:
        """The mix: shard, slot, s, pass, block, doc_id, row, word_from, word_to (in the document, end exclusive)."""
        placed = self.placed() if placed is None else placed
        b, end = F.lit(self.block).cast("long"), F.col("start") + F.col("size")
        blocks = F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))).alias("block")
        pieces = placed.where("size > 0").select("doc_id", "s", "row", "start", "size", blocks)
        low = F.greatest(F.col("start"), F.col("block") * b)
        high = F.least(end, (F.col("block") + 1) * b, F.col("block") * b + F.col("limit"))
        # slots grow with the corpus, which their small inputs don't show to the planner: never broadcast them
        got = pieces.join(self.slots().hint("merge"), ["s", "block"]).withColumns({"word_from": low - F.col("start"), "word_to": high - F.col("start")}).where("word_to > word_from")
        return got.select("shard", "slot", "s", "pass", "block", "doc_id", "row", "word_from", "word_to")

    def taken(self) -> DataFrame:
        """One row per document row: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
        placed = self.placed()
        got = self.rows(placed).groupBy("s", "row").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
        return placed.join(got, ["s", "row"], "left").join(self.sources, "s").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def documents(self) -> DataFrame:
        """The mixed documents with the columns of `docs`: a row for each pass that takes words of a document. Where a pass takes all its words the text stays as it is, else it holds the taken words, a line for each run of blocks; n_chars follows the text, other columns stay, whatever their names. Rows without words give nothing; an empty table gives an empty one."""
        runs = self.rows().groupBy("s", "row", "pass").agg(F.sort_array(F.collect_list(F.struct("word_from", "word_to"))).alias("parts"), F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
        both = self.placed(self.docs).join(runs, ["s", "row"])
        words = F.regexp_extract_all(F.col("whole")["text"].cast("string"), F.lit(WORD), F.lit(0))
        cuts = F.transform("parts", lambda p: F.array_join(F.slice(words, (p["word_from"] + 1).cast("int"), (p["word_to"] - p["word_from"]).cast("int")), " "))
        both = both.select("whole", F.when(F.col("taken") < F.col("size"), F.array_join(cuts, "\n")).alias("part"))
        new = {"text": F.col("part"), "n_chars": F.char_length("part").cast("long")}
        return both.select(*(F.when(F.col("part").isNull(), F.col("whole")[c]).otherwise(new[c]).alias(c) if c in new else F.col("whole")[c].alias(c) for c in self.docs.columns))
