"""Embedding near-duplicates: cover trees, traversed in pairs, for exact threshold links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.llm.common import cut
from pagelathe.llm.graph import components
from pagelathe.llm.simhash import join_labels

#: Radii of the nested levels; above about the links' own radius a node's bound prunes next to nothing.
RADII = (0.5, 0.25, 0.125)
#: Vectors of a block at about; blocks meet in pairs, and no task holds more than two.
BLOCK = 8192
#: Centres of the top level over all vectors, at most, and the sample of vectors that they come from. Both bound what the driver holds.
CENTRES, SAMPLE = 1024, 4096
SLACK = 1e-9


def _net(x: np.ndarray, radius: float) -> np.ndarray:
    """For each row of unit vectors the index of its centre: a greedy net, in row order."""
    n, x = len(x), x.astype(np.float32)
    centre = np.full(n, -1)
    least = 1 - radius * radius / 2
    for s in range(0, n, 512):
        own = np.flatnonzero(centre[s : s + 512] < 0) + s
        if not len(own):
            continue
        with_own = x[own] @ x[own].T >= least
        chosen = []
        for k, i in enumerate(own):
            if centre[i] < 0:
                chosen.append(i)
                near = own[with_own[k] & (centre[own] < 0)]
                centre[near] = i
                centre[i] = i
        rest = np.flatnonzero(centre[s + 512 :] < 0) + s + 512
        if len(rest):
            sim = x[rest] @ x[chosen].T
            best = sim.argmax(1)
            hit = sim[np.arange(len(rest)), best] >= least
            centre[rest[hit]] = np.array(chosen)[best[hit]]
    return centre


def paths(x: np.ndarray, radii: tuple[float, ...] = RADII) -> np.ndarray:
    """(n, levels): each vector's centre at each radius, coarse to fine. Nested: a finer centre has one coarser centre."""
    out, at = [], np.arange(len(x))
    for radius in sorted(radii):
        ids, inv = np.unique(at, return_inverse=True)
        at = ids[_net(x[ids], radius)][inv]
        out.append(at)
    return np.stack(out[::-1], axis=1) if out else np.empty((len(x), 0), np.int64)


class Tree:
    """Rows sorted by path, so that each node is a range of rows. Levels end with the single rows."""

    def __init__(self, x: np.ndarray, path: np.ndarray, weight: np.ndarray, place: np.ndarray | None = None):
        """`place`: what the paths call each row, where only some of the rows that they were made for are here."""
        place = np.arange(len(x)) if place is None else place
        self.order = np.lexsort(path.T[::-1]) if path.shape[1] else np.arange(len(x))
        self.x, path = x[self.order], path[self.order]
        where = np.full(max(path.max(initial=-1), place.max(initial=-1)) + 1, -1)
        where[place[self.order]] = np.arange(len(x))
        self.sums = np.concatenate(([0], np.cumsum(weight[self.order])))
        self.start, self.end, self.centre, self.radius = [], [], [], []
        fresh = np.zeros(len(x), bool)
        fresh[:1] = True
        for k in range(path.shape[1] + 1):
            if k < path.shape[1]:
                fresh[1:] |= path[1:, k] != path[:-1, k]
                start = np.flatnonzero(fresh)
                centre = where[path[start, k]]
                centre = np.where(centre < 0, start, centre)
                end = np.append(start[1:], len(x))
                d = _dist(np.einsum("ij,ij->i", self.x, self.x[np.repeat(centre, end - start)]))
                radius = np.maximum.reduceat(d, start) if len(start) else d
            else:
                start = np.arange(len(x))
                end, centre, radius = start + 1, start, np.zeros(len(x))
            self.start.append(start)
            self.end.append(end)
            self.centre.append(centre)
            self.radius.append(radius)

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child of each node on the next level, and the end of its children."""
        below = self.start[level + 1]
        return np.searchsorted(below, self.start[level][node]), np.searchsorted(below, self.end[level][node])


def _dist(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


class Links:
    """What a traversal finds: for each row the weight linked to it, and labels of what is connected."""

    def __init__(self, n: int):
        self.diff = np.zeros(n + 1, np.int64)
        self.label = np.arange(n)

    def add(self, sa: np.ndarray, ea: np.ndarray, wa: np.ndarray, sb: np.ndarray, eb: np.ndarray, wb: np.ndarray) -> None:
        """All rows of the ranges a with all of the ranges b."""
        for s, e, w in ((sa, ea, wb), (sb, eb, wa)):
            np.add.at(self.diff, s, w)
            np.add.at(self.diff, e, -w)
        for s, e, to in ((sa, ea, sb), (sb, eb, sa)):
            size = e - s
            i = np.repeat(s - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            self.label = join_labels(self.label, i, np.repeat(to, size))


def dual(a: Tree, b: Tree | None, cosine: float) -> Links:
    """Links between rows of a and rows of b (numbered after those of a), or, without b, within a."""
    self_join, b = b is None, b or a
    off = 0 if self_join else len(a.x)
    found = Links(len(a.x) + (0 if self_join else len(b.x)))
    radius, last = float(np.sqrt(2 - 2 * cosine)), len(a.start) - 1

    def settle(level: int, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of the node pairs that lie wholly within the radius; back come those still open."""
        ra, rb = a.radius[level][i], b.radius[level][j]
        same = (i == j) & self_join
        d = np.where(same, 0, _dist(cos))
        if level == last:
            full, open_ = (cos >= cosine) & ~same, np.zeros(len(i), bool)
        else:
            full = (d + ra + rb <= radius - SLACK) & ~same
            open_ = (d - ra - rb <= radius + SLACK) & ~full
        k = np.flatnonzero(full)
        if len(k):
            sa, ea, sb, eb = a.start[level][i[k]], a.end[level][i[k]], b.start[level][j[k]], b.end[level][j[k]]
            found.add(sa, ea, a.sums[ea] - a.sums[sa], sb + off, eb + off, b.sums[eb] - b.sums[sb])
        tight = np.flatnonzero(same & open_ & (2 * ra <= radius - SLACK))
        if len(tight):
            s, e = a.start[level][i[tight]], a.end[level][i[tight]]
            w = a.sums[e] - a.sums[s]
            np.add.at(found.diff, s, w)
            np.add.at(found.diff, e, -w)
            rows = np.concatenate([np.arange(x, y) for x, y in zip(s, e, strict=True)])
            np.subtract.at(found.diff, rows, own := np.diff(a.sums)[rows])
            np.add.at(found.diff, rows + 1, own)
            found.label = join_labels(found.label, rows, np.repeat(s, e - s))
            open_[tight] = False
        return i[open_], j[open_]

    def descend(level: int, i: np.ndarray, j: np.ndarray) -> None:
        """Children of open node pairs, some at a time."""
        (fa, la), (fb, lb) = a.children(level, i), b.children(level, j)
        na, nb = la - fa, lb - fb
        ends = np.cumsum(na * nb)
        s = 0
        while s < len(i):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + 200_000, "right")))
            n = (na * nb)[s:e]
            pair = np.repeat(np.arange(s, e), n)
            k = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
            for t in range(0, len(k), 200_000):
                p, q = pair[t : t + 200_000], k[t : t + 200_000]
                ci, cj = fa[p] + q // nb[p], fb[p] + q % nb[p]
                if self_join:
                    keep = (i[p] != j[p]) | (ci <= cj)
                    ci, cj = ci[keep], cj[keep]
                cos = np.einsum("ij,ij->i", a.x[a.centre[level + 1][ci]], b.x[b.centre[level + 1][cj]])
                ci, cj = settle(level + 1, ci, cj, cos)
                if len(ci):
                    descend(level + 1, ci, cj)
            s = e

    ca, cb = a.x[a.centre[0]], b.x[b.centre[0]]
    # in single precision, with slack for it, which top nodes may touch; what is left is settled in double precision
    reach = np.minimum(radius + a.radius[0] + b.radius[0].max(initial=0), 2)
    least = (1 - reach * reach / 2 - 1e-5).astype(np.float32)
    fa, fb = ca.astype(np.float32), cb.astype(np.float32)
    for s in range(0, len(ca), 512):
        t = s if self_join else 0
        i, j = np.nonzero(fa[s : s + 512] @ fb[t:].T >= least[s : s + 512, None])
        i, j = i + s, j + t
        if self_join:
            i, j = i[keep := i <= j], j[keep]
        i, j = settle(0, i, j, np.einsum("ij,ij->i", ca[i], cb[j]))
        if len(i):
            descend(0, i, j)
    return found


def _unit(raw: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes of doubles; null where they can't link."""
    for x in batches:
        out = []
        for v in x["v"]:
            w = None if v is None else np.asarray(v, np.float64)
            out.append(w.tobytes() if w is not None and w.size and np.isfinite(w).all() and w.any() else None)
        yield pd.DataFrame({"vec_id": x["vec_id"], "v": out})


def _square(cosine: np.ndarray) -> np.ndarray:
    return np.maximum(0, 2 - 2 * cosine)


def top_level(rows: np.ndarray, most: int) -> np.ndarray:
    """At most `most` centres among the rows of a sample, in row order, none within the coarsest radius of another."""
    return rows[np.unique(_net(rows, max(RADII)))[:most]]


def reachable(x: np.ndarray, cell: np.ndarray, centres: np.ndarray, radii: np.ndarray, cosine: float) -> np.ndarray:
    """(rows, cells): whether a row of cell a may link with some row of cell b.

    A link spans at most sqrt(2 - 2 cosine). So the row must lie within that of b's covering radius, and within that of
    the plane between both centres, as all rows of b are no nearer to a's centre than to their own.
    """
    link = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    square = _square(x @ centres.T)
    own = square[np.arange(len(x)), cell]
    apart = np.sqrt(_square(centres @ centres.T))[cell]
    out = (np.sqrt(square) <= radii + link) & (square - own[:, None] <= 2 * apart * link + 1e-6)
    out[np.arange(len(x)), cell] = True
    return out


def deal(sized: DataFrame, counts: dict[int, int], cosine: float, block: int) -> DataFrame:
    """A row for each pair of blocks that a vector of (v, rep, weight, dim) takes part in: v, rep, weight, path, place, dim, low, high, half.

    Each vector belongs to the nearest centre of the top level; a centre's vectors are split into blocks by a hash. Each
    block has a cover tree. A vector goes to the blocks of its own centre and to those that reachable() does not rule out.
    """
    many = [d for d, n in counts.items() if n > block]
    picked = sized.where(F.col("dim").isin(many)).select("dim", "v", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("rep"), "rep")).alias("k")).where(F.col("k") <= SAMPLE)
    sample = picked.toPandas().sort_values(["dim", "k"]) if many else pd.DataFrame({"dim": [], "v": []})
    centres = {int(d): top_level(_unit(g["v"]), min(CENTRES, -(-counts[int(d)] // block))) for d, g in sample.groupby("dim")}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x = x.assign(cell=0, far=0.0)
            for d, at in x.groupby("dim").groups.items():
                if int(d) in centres:
                    cos = _unit(x.loc[at, "v"]) @ centres[int(d)].T
                    x.loc[at, "cell"], x.loc[at, "far"] = cos.argmax(1), np.sqrt(_square(cos.max(1)))
            yield x

    whole = sized.withColumns({"cell": F.lit(0).cast("long"), "far": F.lit(0.0)})
    placed = cut(sized.mapInPandas(assign, whole.schema)) if many else whole
    of = {}
    for r in placed.where(F.col("dim").isin(many)).groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect() if many else []:
        of.setdefault(r.dim, {})[r.cell] = (-(-2 * r.n // (3 * block)), r.far)
    # of each length: a centre's number of blocks, the first one's number, covering radius
    plan = {}
    for d, c in centres.items():
        n = np.array([of[d].get(k, (0, 0.0))[0] for k in range(len(c))], np.int64)
        plan[d] = c, n, np.concatenate(([0], np.cumsum(n)[:-1])), np.array([of[d].get(k, (0, 0.0))[1] for k in range(len(c))])
    split = F.lit(1)
    for d, (_, n, _, _) in plan.items():
        split = F.when(F.col("dim") == d, F.lit(n.tolist())[F.col("cell").cast("int")]).otherwise(split)

    def plant(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("rep", ignore_index=True)
        unit, d, cell, chunk = _unit(x["v"]), int(x["dim"].iloc[0]), int(x["cell"].iloc[0]), int(x["chunk"].iloc[0])
        own, to = 0, [[0]] * len(x)
        if d in plan:
            c, n, first, radii = plan[d]
            own, to = int(first[cell]) + chunk, []
            for s in range(0, len(x), 1024):
                for row in reachable(unit[s : s + 1024], np.full(len(unit[s : s + 1024]), cell), c, radii, cosine):
                    k = np.flatnonzero(row & (n > 0))
                    to.append(np.concatenate([np.arange(first[i], first[i] + n[i]) for i in k]))
        out = x[["v", "rep", "weight", "dim"]].assign(path=list(paths(unit).astype(np.int64)), place=np.arange(len(x)), block=own)
        return out.assign(other=to)

    trees = placed.withColumn("chunk", F.pmod(F.xxhash64("rep"), split)).groupBy("dim", "cell", "chunk").applyInPandas(plant, "v binary, rep long, weight long, dim int, path array<long>, place long, block long, other array<long>")
    return trees.withColumn("other", F.explode("other")).select(
        "v", "rep", "weight", "path", "place", "dim", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("half")
    )


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """One row per row of (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links join vectors of equal length whose cosine, in double precision, is at least `cosine`. Null, empty and zero
    vectors, those with null or non-finite components, and rows without vec_id link with nothing (their component is
    their own vec_id). Equal vectors are compared once and counted as often as they come. Blocks follow the
    top level's centres (see `deal`); each block has a cover tree, and each pair of blocks that the bounds leave is one
    task that walks both trees at once. Where all vectors lie about as far apart as random ones, no bound on distances
    rules much out, and the pairs of blocks grow with the square of the distinct vectors. The driver holds at most SAMPLE
    vectors of each length of which there is more than a block. An empty table gives no rows, repeated rows each give
    theirs, vectors that share a vec_id add up their links, other columns are not read.
    """
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).mapInPandas(_vectors, "vec_id long, v binary"))
    can = F.col("v").isNotNull() & F.col("vec_id").isNotNull()
    one = cut(rows.where(can).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("dim", F.octet_length("v")))
    counts = {r.dim: r.n for r in one.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > block).collect()}
    dealt = deal(one, counts, cosine, block)

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["half", "rep"], ignore_index=True)
        both = [g for _, g in x.groupby("half")]
        none = pd.DataFrame({"rep": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
        if len(both) == 1 and x["low"].iloc[0] != x["high"].iloc[0]:
            return none
        trees = [Tree(_unit(g["v"]), np.array(g["path"].tolist(), np.int64).reshape(len(g), -1), g["weight"].to_numpy(), g["place"].to_numpy()) for g in both]
        found = dual(trees[0], trees[1] if len(trees) > 1 else None, cosine)
        rep = np.concatenate([g["rep"].to_numpy()[t.order] for g, t in zip(both, trees, strict=True)])
        links = np.cumsum(found.diff)[:-1]
        at = np.flatnonzero(links > 0)
        return pd.DataFrame({"rep": rep[at], "links": links[at], "root": rep[found.label[at]]})

    found = cut(dealt.groupBy("dim", "low", "high").applyInPandas(compare, "rep long, links long, root long"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = one.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(F.col("v").alias("w"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named, can & (F.col("v") == F.col("w")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))
