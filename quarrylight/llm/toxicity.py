"""Toxicity: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams, so a misspelling that training never saw shares most vectors
with the word it is made from. Training and scoring look at short windows of words, since an insult fills a few
words of a long text: a document scores as its worst window. Windows of toxic documents are labelled in two
rounds (multiple-instance learning): first all as toxic, then only those that the first round finds worst.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import labelled_sample

#: Bounds of the fit: labelled documents of each class, their length in characters, and that of all of them together.
PER_CLASS, MAX_CHARS, TOTAL_CHARS = 2000, 60_000, 24_000_000
THRESHOLD = 0.7
BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 4, 5, 6)
#: Words in a window, and from one window to the next.
WINDOW, STRIDE = 16, 8
#: Windows of each class that an epoch trains on at most, and the clean ones among them that look worst.
EPOCH_WINDOWS, HARD_WINDOWS = 50_000, 5_000
#: Words that a worker remembers before it starts anew.
CACHE = 300_000
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The words in lower case; of a word that is repeated at once, the first, so that it can't fill a window."""
    return [w for w, _ in groupby((text or "").lower().split())]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all character n-grams of the words, marked at both ends, and the index of each one's word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [f"<{w}>" for w in words]
    size = np.array([len(w) for w in marked])
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(chars))  # characters from here to the word's end
    ids, owners = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(chars), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            m = max(0, len(chars) - n + 1)
            h[:m] = h[:m] * _P + chars[n - 1 : n - 1 + m] + np.uint64(n)
            if n in GRAMS:
                ok = left >= n
                x = h[ok]
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                ids.append((x >> np.uint64(40)).astype(np.int64) % BUCKETS)
                owners.append(owner[ok])
    return np.concatenate(ids), np.concatenate(owners)


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of every window over n words; the last window ends with the text."""
    first = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    return first, np.minimum(first + WINDOW, n)


@dataclass
class ToxicModel:
    """What is left of the embeddings for two classes: of each bucket, how much it speaks for the toxic one."""

    gain: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = THRESHOLD

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, the sum over its subwords and their number."""
        ids, owner = subwords(words)
        return np.bincount(owner, self.gain[ids], len(words)), np.bincount(owner, minlength=len(words)).astype(float)

    def worst(self, total: np.ndarray, number: np.ndarray) -> float:
        """The logit of the worst window, from the sums and numbers of a text's words."""
        if not len(total):
            return self.bias
        first, end = windows(len(total))
        t, n = np.concatenate([[0.0], np.cumsum(total)]), np.concatenate([[0.0], np.cumsum(number)])
        return float(np.max((t[end] - t[first]) / np.maximum(1, n[end] - n[first])) + self.bias)

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -40, 40)))


class _Net:
    """Subword vectors, mean, linear softmax over two classes; AdaGrad with one rate for each row."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.e = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
        self.w, self.b = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
        self.ge, self.gw = np.full(BUCKETS, 1e-8, np.float32), 1e-8
        self.place = np.zeros(BUCKETS, np.int64)

    def step(self, ids: np.ndarray, owner: np.ndarray, word: np.ndarray, inst: np.ndarray, n_words: int, y: np.ndarray, rate: float) -> None:
        """One batch. ids, owner: subwords of the batch's distinct words; word, inst: occurrences in instances."""
        v = np.stack([np.bincount(owner, self.e[ids, k], n_words) for k in range(DIM)], 1)
        bag = np.bincount(owner, minlength=n_words)
        n = np.maximum(1, np.bincount(inst, bag[word], len(y)))[:, None]
        h = np.stack([np.bincount(inst, v[word, k], len(y)) for k in range(DIM)], 1) / n
        z = h @ self.w + self.b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = p.copy()
        dz[np.arange(len(y)), y] -= 1
        dh = (dz @ self.w.T) / n
        dw, db = h.T @ dz / len(y), dz.mean(0)
        dv = np.stack([np.bincount(word, dh[inst, k], n_words) for k in range(DIM)], 1)
        rows = np.flatnonzero(np.bincount(ids, minlength=BUCKETS))
        self.place[rows] = np.arange(len(rows))
        at = self.place[ids]
        de = np.stack([np.bincount(at, dv[owner, k], len(rows)) for k in range(DIM)], 1)
        self.ge[rows] += (de**2).mean(1)
        self.e[rows] -= (rate * de / np.sqrt(self.ge[rows])[:, None]).astype(np.float32)
        self.gw += float((dw**2).mean())
        self.w -= (rate * dw / np.sqrt(self.gw)).astype(np.float32)
        self.b -= (rate * db).astype(np.float32)

    def model(self) -> ToxicModel:
        return ToxicModel((self.e @ (self.w[:, 1] - self.w[:, 0])).astype(np.float32), float(self.b[1] - self.b[0]))


def fit_texts(texts: list[str | None], y: np.ndarray, prior: float, threshold: float = THRESHOLD, epochs: int = 2, seed: int = 11) -> ToxicModel:
    """Train on texts and labels; with one class only, every text gets the same score.

    `prior` is the share of toxic labels; a fifth of the texts is kept to calibrate the scores.
    """
    if not (y == 0).any() or not (y == 1).any():
        return ToxicModel(np.zeros(BUCKETS, np.float32), 0.0, 1.0, 4.0 if (y == 1).any() else -4.0, threshold)
    rng = np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
    names = list(vocabulary)
    some_ids, some_sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for lo in range(0, len(names), 20_000):  # the n-grams in blocks of words: the driver's memory is small
        part, owner = subwords(names[lo : lo + 20_000])
        some_ids.append(part[np.argsort(owner, kind="stable")].astype(np.int32))
        some_sizes.append(np.bincount(owner, minlength=len(names[lo : lo + 20_000])))
    ids, begin = np.concatenate(some_ids), np.concatenate([[0], np.cumsum(np.concatenate(some_sizes))])
    flat = np.fromiter((vocabulary[w] for d in docs for w in d), np.int64)
    start = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    doc, first, end = [], [], []
    for i, d in enumerate(docs):
        if d:
            a, b = windows(len(d))
            doc.append(np.full(len(a), i))
            first.append(a + start[i])
            end.append(b + start[i])
    if not doc:
        return ToxicModel(np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))), threshold)
    doc, first, end = map(np.concatenate, (doc, first, end))
    held = rng.random(len(docs)) < 0.2
    net = _Net(seed)

    def train(chosen: np.ndarray, rate: float) -> None:
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 1000)):
            size = end[part] - first[part]
            inst = np.repeat(np.arange(len(part)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[part], size)
            rows, word = np.unique(flat[at], return_inverse=True)
            many = begin[rows + 1] - begin[rows]
            own = np.repeat(np.arange(len(rows)), many)
            sub = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[rows], many)
            net.step(ids[sub], own, word, inst, len(rows), y[doc[part]].astype(int), rate)

    def logits(model: ToxicModel) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(model.gain[ids], dtype=np.float64)])
        total = sums[begin[1:]] - sums[begin[:-1]]
        t, n = np.concatenate([[0.0], np.cumsum(total[flat])]), np.concatenate([[0], np.cumsum(np.diff(begin)[flat])])
        return (t[end] - t[first]) / np.maximum(1, n[end] - n[first]) + model.bias

    toxic = (y == 1)[doc]
    clean, bad = np.flatnonzero(~toxic & ~held[doc]), np.flatnonzero(toxic & ~held[doc])
    some = lambda of: rng.permutation(of)[:EPOCH_WINDOWS]
    for _ in range(epochs):
        train(np.concatenate([some(clean), some(bad)]), 0.2)
    for _ in range(2 * epochs):
        z = logits(net.model())
        top = np.full(len(docs), -np.inf)
        np.maximum.at(top, doc, z)
        worst = bad[z[bad] >= top[doc[bad]] - 0.5]
        hard = clean[np.argsort(-z[clean], kind="stable")[:HARD_WINDOWS]]
        train(np.concatenate([some(clean), hard, worst]), 0.2)
    model = net.model()
    top = np.full(len(docs), model.bias)
    seen = np.full(len(docs), -np.inf)
    np.maximum.at(seen, doc, logits(model))
    top = np.where(np.isfinite(seen), seen, top)
    use = held if (y[held] == 1).any() and (y[held] == 0).any() else ~held
    weight = np.where(y[use] == 1, prior / max(1, (y[use] == 1).sum()), (1 - prior) / max(1, (y[use] == 0).sum()))
    model.slope, model.shift = _calibrated(top[use], y[use].astype(float), weight / weight.sum())
    model.threshold = threshold
    return model


def _calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the held texts, with a weak pull towards slope 1."""
    x, w = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    pull = np.diag([1e-4, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ ((y - p) * weight) - pull @ (w - np.array([1.0, 0.0]))
        step = np.linalg.solve((x * (p * (1 - p) * weight)[:, None]).T @ x + pull, g)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, fold: Column, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, threshold: float = THRESHOLD, total_chars: int = TOTAL_CHARS) -> ToxicModel:
    """Learn from at most `per_class` labelled documents of each class for which `fold` holds.

    Longer ones than `max_chars` characters aren't learnt from, and neither are those beyond `total_chars` characters in
    all, half of them for each class: the driver holds no more. Of all their windows an epoch trains on EPOCH_WINDOWS
    of each class at most, drawn at random, and on the HARD_WINDOWS clean ones that look worst. These bounds are of the
    fit alone: every window of every whole text is scored. Null and empty texts, repeated rows and an empty table do no
    harm; without labels of a class, scores follow the share of the other.
    """
    share = labels.where(F.col("toxic").isin(0, 1) & fold).agg(F.avg("toxic")).first()[0]
    rows = labelled_sample(docs, labels, "toxic", fold, per_class, max_chars, total_chars).toPandas()
    rows = rows.sort_values(["text", "y"], kind="stable", na_position="first")
    return fit_texts(rows["text"].tolist(), rows["y"].to_numpy(dtype=int), float(share or 0.0), threshold)



class _Scorer:
    """Scores texts one batch at a time; remembers words, at most CACHE and a batch of them."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.total, self.number = np.zeros(0), np.zeros(0)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for lo in range(0, len(texts), 256):
            docs = [words_of(t) for t in texts[lo : lo + 256]]
            if len(self.at) > CACHE:
                self.forget()
            new = list(set().union(*docs) - self.at.keys())
            total, number = self.model.of_words(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.total, self.number = np.concatenate([self.total, total]), np.concatenate([self.number, number])
            for k, d in enumerate(docs):
                i = np.fromiter(map(self.at.__getitem__, d), np.int64, len(d))
                out[lo + k] = self.model.worst(self.total[i], self.number[i])
        return self.model.score(out)


def with_score(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """`docs` with columns score (double, 0 to 1) and predicted (int, 1 if the score reaches the threshold).

    A null text counts as empty; it has a score too. Columns of those two names are replaced. Repeated rows get the
    same score, very long texts are scored whole; an empty table stays empty. The model that is sent out is one number per bucket, 1 MB.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _Scorer(sent.value)
        for text in batches:
            yield pa.array(scorer(text.to_pylist()))

    out = docs.withColumn("score", score(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))
