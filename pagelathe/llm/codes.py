"""Vector code compression: product codes of integer vectors, nearest entries by segment-mean lower bounds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.common import cut

#: Parts of a vector, entries of a part's codebook, rounds of the fit, the factor before rounding down.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows compared at a time, components of a block of the finer level.
ROWS, BLOCK = 2048, 4
#: Pairs are computed one by one if at most one in so many is left.
SPARSE = 32
#: Sums are sent in two decimals, the lower one below this; the largest 32-bit float, beyond which components count as infinite.
LIMB, LARGEST = 10**27, 3.4028235e38
#: Labels whose sums are sent to all executors at most; more are joined by a shuffle.
LABELS = 100_000


def _limit(size: int) -> int:
    """The largest component of a vector of so many at which squared distances fit 64 bits."""
    return math.isqrt((1 << 60) // (size * size))


def _floors(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact: 64-bit integers where squared distances fit them, else Python's."""
    if np.abs(x).max(initial=0) * SCALE <= _limit(x.shape[-1]):
        return np.floor(x * SCALE).astype(np.int64)
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) * SCALE if abs(v) >= 2**52 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return out


class Codebook:
    """The entries of one part, with means and residual norms of their blocks at two levels."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        size = entries.shape[1]
        # whole part, then blocks of BLOCK components, the last one taking what is left
        self.levels = [np.array([0]), np.arange(0, max(1, size - size % BLOCK), BLOCK)]
        self.known = [self._summary(entries, at) for at in self.levels] if entries.dtype != object else []
        self.longest = float((entries * entries).sum(1).max())

    def _summary(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row: its blocks' sums over the root of their length, and the norms of what their means leave, side by side; and their squared norm.

        The squared distance of two such rows is that between the blocks' means and between the residual norms, which
        is never above the squared distance of the vectors.
        """
        n = np.diff(np.append(at, x.shape[1]))
        s = np.add.reduceat(x, at, axis=1)
        q = np.add.reduceat(x * x, at, axis=1)
        out = np.concatenate((s / np.sqrt(n), np.sqrt((n * q - s * s) / n)), axis=1)
        return out, (out * out).sum(1)

    def _bounds(self, level: int, x: np.ndarray) -> np.ndarray:
        """For each row and entry a number not above their squared distance, but for rounding."""
        (own, square), (known, squares) = self._summary(x, self.levels[level]), self.known[level]
        return square[:, None] + squares - 2 * (own @ known.T)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of the nearest entry, ties to the lower one, and the squared distance, exact.

        Entries are left out where their bound from the whole part, then that from its blocks, lies above the distance
        of an entry with a least bound, by more than the arithmetic may err; the others get their distance in integers:
        pair by pair where few are left, else by one product of matrices, if doubles hold all its integers.
        """
        if x.dtype == object or self.entries.dtype == object:
            d = ((x[:, None, :].astype(object) - self.entries[None].astype(object)) ** 2).sum(-1)
            k = np.array([min(range(d.shape[1]), key=row.__getitem__) for row in d], np.int64)
            return k, d[np.arange(len(d)), k]
        slack = 1 + 1e-9 * max(float((x * x).sum(1).max(initial=0)), self.longest)
        alive, best = np.ones((len(x), len(self.entries)), bool), np.full(len(x), np.iinfo(np.int64).max)
        for level in range(len(self.levels)):
            bound = self._bounds(level, x)
            best = np.minimum(best, ((x - self.entries[bound.argmin(1)]) ** 2).sum(1))
            alive &= bound <= (best + slack)[:, None]
        if np.count_nonzero(alive) * SPARSE > alive.size and 8 * float((x * x).sum(1).max()) < 2**53 and 8 * self.longest < 2**53:
            d = (x * x).sum(1)[:, None] + (self.entries**2).sum(1) - 2 * (x.astype(np.float64) @ self.entries.T.astype(np.float64))
            d[~alive] = np.inf
            k = d.argmin(1)
            return k, d[np.arange(len(d)), k].astype(np.int64)
        i, j = np.nonzero(alive)
        d = ((x[i] - self.entries[j]) ** 2).sum(1)
        np.minimum.at(best, i, d)
        hit = d == best[i]
        first = np.unique(i[hit], return_index=True)[1]  # entries come in order within a row
        return j[hit][first], best


def _parts(column: pa.Array, size: int) -> list[np.ndarray]:
    """The integer parts of a batch's vectors."""
    x = _floors(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))
    return np.split(x, PARTS, axis=1)


def kept(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: vectors without nulls, infinities and NaN, as doubles."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % PARTS == 0) & ~bad)


def _start(rows: DataFrame) -> list[np.ndarray] | None:
    """The first codebooks: the parts of the ENTRIES rows that come first by vec_id (null last), then by vector, of the first one's length."""
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return None
    size = len(first[0].v)
    got = rows.where(F.size("v") == size).select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    return np.split(_floors(np.array([r.v for r in got], np.float64)), PARTS, axis=1)


def _round(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry replaced by the mean, rounded down, of the parts nearest to it. Tasks send one row of sums for each entry they use; sums are decimals, so they don't overflow; back come at most PARTS x ENTRIES rows."""
    size = sum(b.shape[1] for b in books)
    width = size // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Codebook(b) for b in books]
        total = [np.zeros(b.shape, object) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                for p, x in enumerate(_parts(batch.column(0).slice(s, ROWS), size)):
                    k, _ = known[p].nearest(x)
                    part = np.zeros(total[p].shape, x.dtype)
                    np.add.at(part, k, x)
                    total[p] += part
                    count[p] += np.bincount(k, minlength=len(count[p]))
        got = [(p, e, int(count[p][e]), [str(v // LIMB) for v in total[p][e]], [str(v % LIMB) for v in total[p][e]]) for p in range(PARTS) for e in np.flatnonzero(count[p]).tolist()]
        for s in range(0, len(got), 256):
            columns = zip(*got[s : s + 256], strict=True)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "n", "high", "low"])

    sums = rows.select("v").mapInArrow(run, "part int, entry int, n long, high array<string>, low array<string>")
    out = [b.astype(object) for b in books]
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(c)[i].cast("decimal(38,0)")).alias(f"{c}{i}") for c in ("high", "low") for i in range(width))).collect():
        out[r.part][r.entry] = [(int(r[f"high{i}"]) * LIMB + int(r[f"low{i}"])) // r.n for i in range(width)]
    return [b.astype(np.int64) if max(map(abs, b.ravel().tolist())) <= _limit(size) else b for b in out]


def fit(rows: DataFrame) -> list[np.ndarray]:
    """Codebooks, one for each part, after ROUNDS rounds over all rows of kept(). Each is ENTRIES x length / PARTS integers, whatever the rows' number; none if there are no rows."""
    books = _start(rows)
    if books is None:
        return []
    rows = rows.where(F.size("v") == sum(b.shape[1] for b in books))
    for _ in range(ROUNDS):
        books = _round(rows, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of the decimal entries by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): the nearest entries' indexes, two hex digits each, and the squared distances' sum. An error beyond 64 bits is null."""
    size = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Codebook(b) for b in books]
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                some = batch.slice(s, ROWS)
                code, error = np.zeros((some.num_rows, PARTS), np.uint8), np.zeros(some.num_rows, object)
                for p, x in enumerate(_parts(some.column("v"), size)):
                    code[:, p], d = known[p].nearest(x)
                    error += d
                hexes = code.tobytes().hex()
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array([hexes[i : i + 2 * PARTS] for i in range(0, len(hexes), 2 * PARTS)], pa.string()), pa.array([int(v) if v < 1 << 63 else None for v in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.where(F.size("v") == size).mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compressed(table: DataFrame) -> DataFrame:
    """One row (vec_id, code, error, label_error, codebooks_sha256) for each vector of the rows (vec_id, embedding, label) that takes part.

    Vectors that are null or empty or hold null, infinite or NaN components, or such beyond 32-bit floats, are left out, and so are those whose length
    isn't that of the first kept one by vec_id, or no multiple of PARTS. Components beyond 64-bit arithmetic are
    computed with whole integers of any size. Fewer than ENTRIES vectors make fewer entries; empty tables give no rows;
    repeated rows and rows without vec_id count like others; other columns are not looked at.

    label_error is summed by label, nulls together, before it is joined, so a common label gathers no rows.
    """
    rows = kept(table)
    books = fit(rows)
    if not books:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    codes = cut(encode(rows, books))
    errors = cut(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    return codes.join(F.broadcast(errors) if errors.count() <= LABELS else errors, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
