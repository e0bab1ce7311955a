"""Language identification by hyperdimensional profiles.

Every letter has a random vector of `DIM` signs, the same in every process. The vector of three letters in a row is the
product of theirs, the first permuted twice and the second once (a permutation turns the vector by a place); what stands
between words counts as one letter. A text's vector is the sum over its three-letter stretches, a language's prototype
the sum over its texts, of which the mean direction of all prototypes is taken off. The prototype with the greatest
cosine names the language. Stretches are counted first, by text or by language, and their vectors are made by the task
that needs them, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM, SEED = 1024, 20_000
#: Characters and texts that are counted at once (one text at least), stretches whose vectors are made at once, counts
#: that a task holds while it learns.
CHARS, TEXTS, BLOCK, HELD = 1 << 19, 512, 2048, 2_000_000
#: More languages than this are an error: the prototypes are broadcast.
MOST_LANGUAGES = 10_000
UNKNOWN = "und"


class Letters:
    """The letters that a process has met, numbered from 1, with their vectors; 0 stands between words."""

    def __init__(self, dim: int):
        self.dim, self.codes = dim, [0]
        self.number = np.full(0x110000, -1, np.int32)
        self.vectors = self._vector(0)[None]

    def _vector(self, code: int) -> np.ndarray:
        return np.random.default_rng([SEED, code]).choice(np.array([-1, 1], np.int8), self.dim)

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """Code points as numbers: capitals as small letters, 0 for what is no letter."""
        out = self.number[codes]
        if out.min(initial=0) < 0:
            for code in np.unique(codes[out < 0]).tolist():
                c = chr(code)
                self.number[code] = self._of(ord(c.lower()[0])) if c.isalpha() else 0
            out = self.number[codes]
        return out

    def _of(self, code: int) -> int:
        """The number of a small letter."""
        if self.number[code] < 0:
            self.number[code] = len(self.codes)
            self.codes.append(code)
            self.vectors = np.concatenate([self.vectors, self._vector(code)[None]])
        return int(self.number[code])

    def bound(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        """The vectors of stretches of three letters."""
        v = self.vectors
        return np.roll(v, 2, 1)[first] * np.roll(v, 1, 1)[second] * v[third]


_letters: dict[int, Letters] = {}


def letters_of(dim: int) -> Letters:
    if dim not in _letters:
        _letters[dim] = Letters(dim)
    return _letters[dim]


def stretches(texts: list[str], letters: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(three numbers of letters as rows, text, count): the different stretches of every text, by stretch."""
    raw = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "replace"), "<u4")
    end = np.cumsum([len(t) + 1 for t in texts])
    seen = letters.numbers(raw)
    keep = np.flatnonzero((seen > 0) | np.r_[True, seen[:-1] > 0])
    run = seen[keep].astype(np.int64)
    middle = np.flatnonzero(run[1:-1] > 0) + 1
    k = len(letters.codes)
    stretch = (run[middle - 1] * k + run[middle]) * k + run[middle + 1]
    text = np.searchsorted(end, keep[middle], "right")
    if k**3 <= 1 << 22:  # few letters: counting is faster than sorting
        there = np.bincount(stretch, minlength=k**3)
        names = np.flatnonzero(there)
        of = np.cumsum(there > 0)[stretch] - 1
    else:
        names, of = np.unique(stretch, return_inverse=True)
    pair = of * len(texts) + text
    if len(names) * len(texts) <= 1 << 23:
        count = np.bincount(pair, minlength=len(names) * len(texts))
        pair = np.flatnonzero(count)
        count = count[pair]
    else:
        pair, count = np.unique(pair, return_counts=True)
    of, text = np.divmod(pair, max(1, len(texts)))
    return np.stack([names // (k * k), names // k % k, names % k])[:, of], text, count


def bundled(three: np.ndarray, row: np.ndarray, count: np.ndarray, rows: int, letters: Letters, kind=np.float32) -> np.ndarray:
    """The sum of the stretches' vectors for each row; `three` is sorted by stretch. Sums below 2**24 are exact."""
    out = np.zeros((rows, letters.dim), kind)
    new = np.flatnonzero(np.r_[True, (three[:, 1:] != three[:, :-1]).any(0)]) if len(row) else np.empty(0, np.int64)
    for lo in range(0, len(new), BLOCK):
        some = new[lo : lo + BLOCK]
        part = slice(some[0], new[lo + BLOCK] if lo + BLOCK < len(new) else len(row))
        times = np.zeros((len(some), rows), kind)
        times[np.searchsorted(some, np.arange(part.start, part.stop), "right") - 1, row[part]] = count[part]
        out += times.T @ letters.bound(*three[:, some]).astype(kind)
    return out


def _parts(texts: list[str]) -> Iterator[slice]:
    """Slices of at most `TEXTS` texts and `CHARS` characters, unless one has more."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        if k > at and (k - at == TEXTS or held + len(t) > CHARS):
            yield slice(at, k)
            at, held = k, 0
        held += len(t)
    if texts:
        yield slice(at, len(texts))


def _counter(dim: int):
    """Stretches by language of a task's texts (lang, text), as (lang, three code points in one number, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letters_of(dim)
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                times = np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(times)], ["lang", "stretch", "times"])
            held.clear()

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _parts(texts):
                three, text, count = stretches(texts[part], letters)
                code = np.array(letters.codes, np.int64)[three]
                key = code[0] << 42 | code[1] << 21 | code[2]
                mine = np.array(langs[part])
                for lang in set(langs[part]):
                    own = (mine == lang)[text]
                    held.setdefault(lang, []).append((key[own], count[own]))
                    size += int(own.sum())
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    return run


def _bundler(dim: int):
    """(lang, place, value) of the prototypes' parts from a task's (lang, stretch, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, parts = letters_of(dim), {}
        for batch in batches:
            langs, at = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            by = np.argsort(batch.column(1).to_numpy(), kind="stable")
            key = batch.column(1).to_numpy()[by]
            three = letters.numbers(np.stack([key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF])).astype(np.int64)
            sums = bundled(three, at[by], batch.column(2).to_numpy()[by], len(langs), letters, np.float64)
            for lang, row in zip(langs.tolist(), sums):
                parts[lang] = parts.get(lang, 0) + row
        for lang, row in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim)), pa.array(row)], ["lang", "place", "value"])

    return run


@dataclass
class Profiles:
    """The languages, in order, and their prototypes as rows of length 1."""

    languages: list[str]
    prototypes: np.ndarray

    @staticmethod
    def of(languages: list[str], sums: np.ndarray) -> "Profiles":
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
        rows = unit(sums)
        return Profiles(languages, unit(rows - rows.mean(0)) if len(rows) > 1 else rows)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dim: int = DIM) -> Profiles:
    """Prototypes of the languages of all rows of `docs` that have a text and a language; no row is left out.

    Counts of stretches are added up before the shuffle and again after it, so a language of most rows costs no task
    more than its share; the driver gets `dim` numbers for each language. Repeated rows count each; without rows there
    are no prototypes. More than `MOST_LANGUAGES` languages are an error.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_counter(dim), "lang string, stretch long, times long").groupBy("lang", "stretch").agg(F.sum("times").alias("times"))
    sums = counts.mapInArrow(_bundler(dim), "lang string, place long, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    whole = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("v"))
    found = whole.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    found.sort(key=lambda r: r.lang)
    return Profiles.of([r.lang for r in found], np.array([r.v for r in found], dtype=float).reshape(-1, dim))


def _predictor(given, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, profiles = letters_of(dim), given.value
        to = profiles.prototypes.T
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in _parts(texts):
                some = texts[part]
                three, text, count = stretches(some, letters)
                own = bundled(three, text, count, len(some), letters).astype(np.float64)
                size = np.linalg.norm(own, axis=1)
                known = np.bincount(text, minlength=len(some)) > 0
                if len(profiles.languages):
                    cosine = own @ to / np.maximum(size, 1e-12)[:, None]
                    best = cosine.argmax(1)
                    names = [profiles.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                    score = np.where(known, np.clip(cosine.max(1), 0, 1), 0.0)
                else:
                    names, score = [UNKNOWN] * len(some), np.zeros(len(some))
                cols = [batch.column(0).slice(part.start, len(some)), pa.array(names, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: the language of every whole text, with its cosine (0 at least).

    A text that is null or has no letter is `und` with score 0, and so is every text without prototypes; equal cosines
    go to the language that is first by name. A null id is kept, repeated rows are each predicted, an empty table gives
    none; other columns are not read. A very long text is counted whole, in memory in proportion to it. No shuffle.
    """
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dim = profiles.prototypes.shape[1] if len(profiles.languages) else DIM
    given = docs.sparkSession.sparkContext.broadcast(profiles)
    return pairs.mapInArrow(_predictor(given, dim), "doc_id long, lang_pred string, score double")
