"""Periodic runs of words by a suffix tree of each text.

The suffixes of all texts of a batch are sorted by prefix doubling, every text with words of its own, so no branch
leads from one text to another. Sorted suffixes and their common prefixes give the inner nodes of the suffix tree as
intervals. A node of depth D lists its leaves, but for those of its largest child; each leaf p looks for p+D and p-D
among the node's leaves in other children. A hit is a branching tandem repeat: two equal stretches of D words, the
word after the second differing from the one after the first. Rotating it to the left as long as the words agree gives
its maximal run; repeats of the same run with a multiple of its period are merged into it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the texts whose suffixes are sorted together, unless one text has more.
WORDS = 250_000
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _ranges(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) for all values of the ranges that begin at `low`."""
    of = np.repeat(np.arange(len(low)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]


@dataclass
class SuffixTree:
    """Sorted suffixes, their places, and common prefixes with the one before; `key` ends every text uniquely."""

    order: np.ndarray
    place: np.ndarray
    common: np.ndarray

    @staticmethod
    def of(key: np.ndarray) -> "SuffixTree":
        n = len(key)
        order = np.argsort(key, kind="stable")
        fresh = np.r_[True, key[order[1:]] != key[order[:-1]]]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        ranks, level = [rank], np.full(n, -1, np.int8)  # the doubling in which a suffix parted from the one before
        active = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
        while len(active):
            k = len(ranks) - 1
            at = order[active]
            group, after = rank[at].astype(np.int64), rank[at + (1 << k)]
            by = np.argsort(group * n + after, kind="stable")
            at, after = at[by], after[by]
            order[active] = at
            old = np.r_[True, group[1:] != group[:-1]]  # groups keep their places
            fresh = old | np.r_[True, after[1:] != after[:-1]]
            level[active[fresh & ~old]] = k
            rank = rank.copy()
            rank[at] = active[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            ranks.append(rank)
            active = active[~(fresh & np.r_[fresh[1:], True])]
        common = np.where(level >= 0, np.left_shift(1, np.maximum(level, 0).astype(np.int32)), 0).astype(np.int32)
        deep = np.flatnonzero(level > 0)
        a, b, far, least = order[deep - 1], order[deep], common[deep], level[deep]
        for k in range(int(level.max(initial=0)) - 1, -1, -1):
            far = far + (((least > k) & (ranks[k][a + far] == ranks[k][b + far])).astype(np.int32) << k)
        common[deep] = far
        return SuffixTree(order, rank, common)

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, before, after): for each place i with a common prefix the next places on both sides whose own is no longer."""
        c, n = self.common, len(self.common)
        at = np.flatnonzero(c)
        zero = np.flatnonzero(np.r_[c == 0, True])
        low, steps = [c], int(np.diff(zero, prepend=-1).max(initial=1)).bit_length()
        for k in range(steps - 1):
            low.append(np.minimum(low[-1], np.r_[low[-1][1 << k :], np.zeros(min(1 << k, n), c.dtype)]))
        before, after, mine = at.copy(), at + 1, c[at]
        for k in range(len(low) - 1, -1, -1):
            w = 1 << k
            ok = (after < n) & (low[k][np.minimum(after, n - 1)] > mine)
            after += w * ok
            ok = (before >= w) & (low[k][np.maximum(before - w, 0)] > mine)
            before -= w * ok
        return at, before - 1, np.minimum(after, n)

    def branching_repeats(self, least_leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """(end, period) of the branching tandem repeats at nodes with at least `least_leaves` leaves."""
        c, n = self.common, len(self.common)
        at, before, after = self.bounds()
        none = np.empty(0, np.int64)
        if not len(at):
            return none, none
        # places with equal prefixes between the same bounds are one node; its first place stands for it
        first = c[before] < c[at]
        node = np.arange(n)
        node[at[~first]] = before[~first]
        while (node[node] != node).any():
            node = node[node]
        c_after = np.r_[c, 0][after]
        last = c_after < c[at]
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        left[at[first]] = before[first]
        right[node[at[last]]] = after[last] - 1
        # children: from every place to the next bound, and for the first place the one before it
        of = np.r_[node[at], at[first]]
        low, high = np.r_[at, before[first]], np.r_[after, at[first]] - 1
        wide = right[of] - left[of] + 1 >= least_leaves
        of, low, high = of[wide], low[wide], high[wide]
        by = np.lexsort((high - low, of))
        of, low, high = of[by], low[by], high[by]
        small = np.r_[of[1:] == of[:-1], False][: len(of)]  # the largest child of each node comes last and is left out
        of, low, high = of[small], low[small], high[small]
        ends, periods = [none], [none]
        cuts = np.searchsorted(np.cumsum(high - low + 1), np.arange(0, int((high - low + 1).sum()) + 1, 4 * WORDS))
        for lo, hi in zip(cuts, [*cuts[1:], len(of)]):
            child, leaf = _ranges(low[lo:hi], high[lo:hi] - low[lo:hi] + 1)
            child += lo
            p, depth = self.order[leaf].astype(np.int64), c[of[child]].astype(np.int64)
            for begin, other in ((p, p + depth), (p - depth, p - depth)):
                there = self.place[np.clip(other, 0, n - 1)]
                hit = (other >= 0) & (other < n) & (there >= left[of[child]]) & (there <= right[of[child]])
                hit &= (there < low[child]) | (there > high[child])
                ends.append(begin[hit] + 2 * depth[hit])
                periods.append(depth[hit])
        found = np.unique(np.stack([np.concatenate(ends), np.concatenate(periods)]), axis=1)
        return found[0], found[1]


def _rotated(key: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Where the runs of repeats begin: each goes left while the word before equals the one a period on."""
    begin, open_, step = end - 2 * period, np.arange(len(end)), 16
    while len(open_):
        size = np.minimum(step, begin[open_])
        of, back = _ranges(np.ones(len(open_), np.int64), size)
        p = begin[open_][of] - back
        agree = key[p] == key[p + period[open_][of]]
        run = np.where(agree, size[of], back - 1)
        far = size.copy()
        np.minimum.at(far, of, run)
        begin[open_] -= far
        open_ = open_[(far == size) & (size > 0)]
        step *= 2
    return begin


def maximal_runs(key: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of all texts in `key`, by start and period.

    key: a number for each word, equal within a text where the words are, different between texts, and one of its own
    at each text's end. A run holds `min_exponent` periods and `min_length` words at least.
    """
    none = np.empty(0, np.int64)
    if not len(key):
        return none, none, none
    # the last two words of a run of e periods stand e times with the period between: its node has e leaves
    end, period = SuffixTree.of(key).branching_repeats(max(2, min_exponent))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(end):
        first = np.r_[True, end[1:] != end[:-1]]  # sorted by end and period: the least period of an end is primitive
        e, q = end[first], period[first]
        s = _rotated(key, e, q)
        found.append((s, e - s, q))
        of = np.cumsum(first) - 1
        rest = ~first & ~((period % q[of] == 0) & (2 * period <= (e - s)[of]))
        end, period = end[rest], period[rest]
    start, length, period = (np.concatenate(x) for x in zip(*found)) if found else (none, none, none)
    keep = np.flatnonzero((length >= min_length) & (length >= min_exponent * period))
    keep = keep[np.lexsort((period[keep], start[keep]))]
    return start[keep], length[keep], period[keep]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts between ASCII white space, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts if texts.type == pa.string() else texts.cast(pa.string()), ""))
    words, size = parts.flatten(), np.diff(parts.offsets.to_numpy())
    full = pc.greater(pc.binary_length(words), 0)
    if pc.all(full).as_py() in (True, None):
        return words, size
    held = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    to = np.r_[0, np.cumsum(size)]
    return words.filter(full), np.diff(held[to])


def _in_one(texts: pa.Array, min_length: int, min_exponent: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Runs and collapsed text of each text, and its number of words."""
    words, size = words_of(texts)
    n_docs, first = len(size), np.cumsum(size) - size
    coded = words.dictionary_encode()
    doc = np.repeat(np.arange(n_docs), size)
    begin = first + np.arange(n_docs)  # a text's place among words and ends
    key = np.empty(len(words) + n_docs, np.int64)
    key[begin + size] = len(coded.dictionary) * n_docs + np.arange(n_docs)
    key[np.arange(len(words)) + doc] = doc * len(coded.dictionary) + coded.indices.to_numpy()
    start, length, period = maximal_runs(key, min_length, min_exponent)
    of = np.searchsorted(begin, start, "right") - 1
    count = np.bincount(of, minlength=n_docs)
    values = pa.StructArray.from_arrays([pa.array(start - begin[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), values).cast(RUN)
    kept = np.ones(len(words), bool)
    if len(start):
        turn = np.zeros(len(words) + 1, np.int64)
        np.add.at(turn, start - of + period, 1)
        np.add.at(turn, start - of + length, -1)
        kept = np.cumsum(turn)[:-1] == 0
        words = words.filter(pa.array(kept))
    left = np.r_[0, np.cumsum(np.bincount(doc[kept], minlength=n_docs))].astype(np.int32)
    return runs, pc.binary_join(pa.ListArray.from_arrays(pa.array(left), words), " "), size


def _finder(min_length: int, min_exponent: int):
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a word takes two bytes at least, with the space after it
            room = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 6 + 1)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(room, (room[at - 1] if at else 0) + WORDS, "right")))
                part = batch.slice(at, to - at)
                runs, collapsed, size = _in_one(part.column(1), min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), runs, collapsed], names)
                at = to

    return run


def find_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period) and collapsed of every whole text.

    Words lie between ASCII white space and are numbered from 0. A run is a stretch of words with smallest period q, of
    at least `min_exponent` periods and `min_length` words, that no neighbouring word extends with that period;
    `collapsed` holds the words, joined by one space, without those that a run contains after its first q words.

    A null text counts as empty: no words, no runs, an empty collapsed text. A null id is kept, repeated rows are each
    searched, an empty table gives none; other columns are not read. No shuffle: a text is searched whole in the task
    that reads it, whatever its length, in memory in proportion to it; a text that repeats one word throughout costs no
    more than n log n.
    """
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return pairs.mapInArrow(_finder(min_length, min_exponent), schema)
