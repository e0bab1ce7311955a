"""Quality classifier: Bradley-Terry pairwise ranking on document features.

A document's strength is linear in a few surface features. The weights maximise the likelihood that of a random
pair of labelled documents the good one wins: logistic loss on the difference of the two feature vectors. The
scores are then cut at a quantile of the labelled scores, and moved so that the cut lies at `threshold`.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import labelled_sample

#: Bounds of the fit: labelled documents of each class, their length in characters, preference pairs.
PER_CLASS, MAX_CHARS, PAIRS = 4000, 200_000, 100_000
THRESHOLD = 0.3
#: ASCII signs that prose rarely holds, against those that it often does.
ODD = np.array([chr(c) in "#$%&*+/<=>@[\\]^_`{|}~" for c in range(256)])
STOPS = np.array([chr(c) in ".,;:?'\"()-" for c in range(256)])
N_FEATURES = 17


def features(text: str | None) -> np.ndarray:
    """The features of one whole text; all are 0 for a null or empty one."""
    out = np.zeros(N_FEATURES)
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return out
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, n = len(raw), len(words)
    times = Counter(words)
    upper, lower, high = count[65:91].sum(), count[97:123].sum(), count[128:].sum()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[:] = (
        np.log1p(n),
        np.log1p(min(size / n, 100)),
        upper / max(1, upper + lower + high / 2),
        count[ODD].sum() / n,
        count[ord("!")] / n,
        count[ord("|")] / n,
        count[48:58].sum() / size,
        count[STOPS].sum() / n,
        high / size,
        len(times) / n,
        np.log(len(times) + 1) / np.log(n + 1),
        max(times.values()) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        (count[ord(".")] + count[ord("?")]) / n,
        count[ODD].sum() > 0.2 * n,
    )
    return out


@dataclass
class RankModel:
    """Weights of the standardised features, and the strength at which documents are cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    threshold: float = THRESHOLD

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, rising with strength; at the cut it is the threshold."""
        z = self.strength(x) - self.cut + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_pairs(x: np.ndarray, y: np.ndarray, prior: float, threshold: float = THRESHOLD, pairs: int = PAIRS, seed: int = 7) -> RankModel:
    """Fit by Newton's method on `pairs` preference pairs; with one class only, every strength is 0.

    `prior` is the share of low quality among all labels. The cut is the quantile of the strengths, near that
    share, which tells the classes apart best, each class weighed as often as it occurs.
    """
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    model = RankModel(mean, scale, np.zeros(x.shape[1] if len(x) else N_FEATURES), 0.0, threshold)
    if not len(good) or not len(bad):
        model.cut = -1.0 if len(good) or not len(bad) else 1.0
        return model
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / scale, -6, 6)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, ridge = np.zeros(d.shape[1]), 1e-3 * np.eye(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge, d.T @ p / pairs - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    s = model.strength(x)
    weight = np.where(y == 1, (1 - prior) / len(good), prior / len(bad))
    order = np.argsort(s, kind="stable")
    below = np.cumsum(weight[order])
    wrong = np.cumsum(np.where(y[order] == 1, weight[order], 0)) + prior - np.cumsum(np.where(y[order] == 0, weight[order], 0))
    near = np.flatnonzero((below > 0.3 * prior) & (below < min(1.0, 2 * prior + 0.05)))
    at = near[np.argmin(wrong[near])] if len(near) else int(np.searchsorted(below, prior))
    at = min(at, len(s) - 2)
    model.cut = float((s[order[at]] + s[order[at + 1]]) / 2)
    return model


@F.arrow_udf(ArrayType(DoubleType()))
def _features(text: pa.Array) -> pa.Array:
    return pa.array([features(t).tolist() for t in text.to_pylist()], pa.list_(pa.float64()))


def fit(docs: DataFrame, labels: DataFrame, fold: Column, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, threshold: float = THRESHOLD) -> RankModel:
    """Learn from at most `per_class` labelled documents of each class for which `fold` holds, none longer than `max_chars`.

    Null texts are never learnt from; rows that repeat an id count each. Without labels of a class, or without any, all
    scores are the same.
    """
    share = labels.where(F.col("quality").isin(0, 1) & fold).agg(F.avg(1 - F.col("quality"))).first()[0]
    rows = labelled_sample(docs, labels, "quality", fold, per_class, max_chars).select(_features("text").alias("x"), "y").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, N_FEATURES)
    return fit_pairs(x, rows["y"].to_numpy(dtype=int), float(share or 0.0), threshold)


def with_score(docs: DataFrame, model: RankModel, text_col: str = "text") -> DataFrame:
    """`docs` with columns score (double, 0 to 1) and predicted (int, 1 if the score reaches the threshold).

    A null text counts as empty; it has a score too. Columns of those two names are replaced. Repeated rows get
    the same score, very long texts are scored whole; an empty table stays empty.
    """

    @F.arrow_udf(DoubleType())
    def score(text: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in text.to_pylist()]).reshape(-1, N_FEATURES)
        return pa.array(model.score(x))

    out = docs.withColumn("score", score(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))
