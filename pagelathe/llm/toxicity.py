"""Toxicity: non-negative positive-unlabelled learning of a sparse linear classifier in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.common import cut

WORDS = re.compile(r"[^\W\d_]+")
#: Bounds of what the fit sees: confirmed positives, unlabelled rows, rows for the calibration of each label. One in CALIBRATED documents is for the calibration, the others are for the fit.
POSITIVES, UNLABELLED, CALIBRATION, CALIBRATED = 6000, 12000, 3000, 5
#: Standard deviations by which a feature must stand out.
LEAST = 4.5


def words_of(text: str | None) -> np.ndarray:
    """64-bit hashes of the distinct words of a text, letters alone, lower case, and of their stems: the first four and five letters of longer words."""
    words = set(WORDS.findall((text or "").lower()))
    stems = {w[:4] for w in words if len(w) > 4} | {w[:5] for w in words if len(w) > 5}
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, 0) for w in words] + [digest(w, 1) for w in stems], np.uint64).view(np.int64)


@dataclass
class Model:
    """Weights of words (sorted hashes), a bias, and a calibration (scale, shift) of the log-odds."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def find(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) of all known words."""
        doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
        flat = np.concatenate(words) if words else np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, flat), max(len(self.vocabulary) - 1, 0))
        ok = self.vocabulary[at] == flat if len(self.vocabulary) else np.zeros(len(flat), bool)
        return doc[ok], at[ok]

    def logits(self, words: list[np.ndarray]) -> np.ndarray:
        """Uncalibrated log-odds."""
        doc, at = self.find(words)
        return self.bias + np.bincount(doc, self.weights[at], len(words))

    def scores(self, words: list[np.ndarray]) -> np.ndarray:
        """Calibrated probabilities."""
        return _sigmoid(self.scale * self.logits(words) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def stands_out(positives: F.Column, unlabelled: F.Column, n_positive: int, n_unlabelled: int) -> F.Column:
    """Standard deviations by which a word comes in more positives than its share of unlabelled texts explains."""
    share = (unlabelled + 0.5) / (n_unlabelled + 1)
    return (positives - n_positive * share) / F.sqrt(n_positive * share * (1 - F.least(share, F.lit(0.999))) + 0.25)


@dataclass
class Rows:
    """Texts as (text, feature) number pairs."""

    text: np.ndarray
    feature: np.ndarray
    n: int

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Weights of each text's features, summed."""
        return bias + np.bincount(self.text, weights[self.feature], self.n)


def fit(vocabulary: np.ndarray, positive: Rows, unlabelled: Rows, prior: float, rounds: int = 150, l2: float = 1e-4, rate: float = 0.15) -> Model:
    """Minimise the class-prior-corrected risk prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) by full-batch Adam.

    Where the second part, which estimates the risk on negatives, falls below 0, the step goes up its own gradient, as
    non-negative PU learning has it.
    """
    model = Model(vocabulary, np.zeros(len(vocabulary)), float(np.log(prior / (1 - prior))))
    if not positive.n or not unlabelled.n:
        return model
    k = len(model.vocabulary)
    theta, m, v = np.append(model.weights, model.bias), np.zeros(k + 1), np.zeros(k + 1)

    def gradient(rows: Rows, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(rows.feature, g[rows.text], k), g.sum())

    for t in range(1, rounds + 1):
        zp, zu = positive.logits(theta, theta[k]), unlabelled.logits(theta, theta[k])
        up = gradient(positive, -_sigmoid(-zp) * prior / positive.n)  # log loss of positives as positives
        down = gradient(unlabelled, _sigmoid(zu) / unlabelled.n) - gradient(positive, _sigmoid(zp) * prior / positive.n)
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = up + down if negative_risk >= 0 else -down
        g[:k] += l2 * theta[:k]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate / (1 + t / 50)
        theta = theta - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    model.weights, model.bias = theta[:k], float(theta[k])
    return model


def calibrate(model: Model, logits: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """Scale and shift of the log-odds by weighted logistic regression on labelled rows (Newton steps)."""
    z = np.clip(logits, -20, 20)
    x = np.stack([z, np.ones_like(z)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (weight * (p - label)) + 1e-3 * (w - [1, 0]))
    if np.isfinite(w).all() and w[0] > 0:
        model.scale, model.shift = float(w[0]), float(w[1])
    return model


def held_out(column: str = "doc_id") -> F.Column:
    """Rows whose labels play no part in the fit."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows that are not held out, and unlabelled text of the same part of the documents.

    Each row is taken by a hash of its doc_id with a chance that makes the expected numbers POSITIVES, UNLABELLED and
    CALIBRATION at most, so what is fitted is bounded however many rows there are; no document is both fitted and
    calibrated on. Features are the words of at least three chosen positives that stand out by LEAST standard
    deviations; they are counted by Spark, and only those of the chosen rows come to the driver, which the rows' number
    bounds. The prior is the share of toxic rows among the
    labelled ones. Rows with null text or label, and labels of unknown rows, play no part; with no positive rows the
    model has its prior alone.
    """
    learn = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    one, zero = counts.get(1, 0), counts.get(0, 0)
    rows = docs.where(~held_out() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    total = rows.count()
    draw = lambda salt, most, n: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, most / max(n, 1))))
    apart = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(CALIBRATED)) == 0
    positive = (F.col("toxic") == 1) & ~apart & draw(1, POSITIVES, one)
    checked = apart & (((F.col("toxic") == 1) & draw(3, CALIBRATION * CALIBRATED, one)) | ((F.col("toxic") == 0) & draw(4, CALIBRATION * CALIBRATED, zero)))
    kinds = F.array_compact(F.array(F.when(positive, 1), F.when(~apart & draw(2, UNLABELLED, total), 2), F.when(checked, 4 - F.col("toxic"))))
    chosen = learn.where(positive | checked)
    # the chosen ids are POSITIVES + 2 * CALIBRATION at about, so they go to the texts, which then need no shuffle
    sample = cut(rows.join(F.broadcast(chosen), "doc_id", "left").select("text", F.explode(kinds).alias("kind")))
    n = {r["kind"]: r["n"] for r in sample.groupBy("kind").agg(F.count("*").alias("n")).collect()}

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for kind, part in x.groupby("kind"):
                ids, k = np.unique(np.concatenate(list(map(words_of, part["text"]))), return_counts=True)
                yield pd.DataFrame({"kind": kind, "word": ids, "n": k})

    by = sample.where("kind <= 2").mapInPandas(tally, "kind int, word long, n long").groupBy("word").agg(F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("kind") == 2, F.col("n")).otherwise(0)).alias("u"))
    far = stands_out(F.col("p"), F.col("u"), n.get(1, 0), n.get(2, 0))
    best = by.where("p >= 3").where(far >= LEAST).select("word").orderBy("word")
    vocabulary = np.sort(np.array([r["word"] for r in best.collect()], np.int64))

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [np.searchsorted(vocabulary, (w := words_of(t))[np.isin(w, vocabulary)]).astype(np.int32) for t in x["text"]]
            yield pd.DataFrame({"kind": x["kind"], "features": found})

    got = sample.mapInPandas(known, "kind int, features array<int>").toArrow()

    def rows_of(kind: int) -> Rows:
        own = pc.filter(got["features"], pc.equal(got["kind"], kind)).combine_chunks()
        return Rows(np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy())), own.flatten().to_numpy(), len(own))

    prior = min(0.9, max(1e-4, one / max(one + zero, 1)))
    model = fit(vocabulary, rows_of(1), rows_of(2), prior)
    toxic, clean = rows_of(3), rows_of(4)
    if toxic.n and clean.n:
        logits = np.concatenate([r.logits(model.weights, model.bias) for r in (toxic, clean)])
        y = np.repeat([1.0, 0.0], [toxic.n, clean.n])
        w = np.repeat([one / toxic.n, zero / clean.n], [toxic.n, clean.n])
        calibrate(model, logits, y, w / w.mean())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of `docs` and score (0 to 1). Null and empty texts get the score of no words; repeated rows stay; a column named score is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:  # the words of some texts are held at a time
            yield pd.Series(np.concatenate([np.empty(0), *(shared.value.scores(list(map(words_of, t.iloc[i : i + 500]))) for i in range(0, len(t), 500))]))

    return docs.withColumn("score", scored(F.col("text").cast("string")))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted (score at least 0.7). A null doc_id is not held out; null and empty texts get the score of no words; repeated rows come repeatedly; very long texts are scored whole; an empty table gives an empty result; other columns play no part."""
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
