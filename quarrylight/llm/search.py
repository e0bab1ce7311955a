"""Ranked lexical search by a hierarchical max tree over document ranges.

The documents are indexed in segments: what one task reads is cut into runs of `SEGMENT` documents, and a segment holds
its postings (term, document, count) for the terms that are asked for. When the corpus's counts are known, every
posting gets its share of a score, and each term of a segment a tree: its leaves are ranges of `LEAF` documents, each
holding the largest share there, and a node holds the largest of its `FAN` children. The sum of the nodes of an item's
terms bounds every score below. A search opens the node with the highest bound first, scores the documents of the
leaves that it comes to, and ends when no bound reaches the k-th score; nodes whose bound equals it are opened too,
for ties go to the smaller id. A task searches its segments one after the other, with what it has found as the limit.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path
from .runs import words_of

#: Documents of a segment and of a leaf, children of a node, and bytes of text of a segment, unless one text has more.
SEGMENT, LEAF, FAN, SEGMENT_BYTES = 4096, 16, 4, 32 << 20
#: Characters of the items that are searched in one pass over the documents, on average at most; with their terms they
#: are what a pass broadcasts.
PASS_CHARS = 1_000_000
#: A term is a maximal run of ASCII letters and digits and of all other characters beyond ASCII; A-Z count as a-z.
_AS_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
SEGMENTS = "n_docs long, n_terms long, doc_ids binary, null_ids binary, doc_terms binary, term binary, doc binary, tf binary"


def _as_terms(texts: pa.Array) -> pa.Array:
    """Texts whose terms are parted by spaces."""
    if texts.type != pa.string():
        texts = texts.cast(pa.string())
    valid, offsets, data = texts.buffers()
    data = pa.py_buffer((data.to_pybytes() if data else b"").translate(_AS_TERMS))
    return pa.StringArray.from_buffers(len(texts), offsets, data, valid, texts.null_count, texts.offset)


def terms_of(text: str | None) -> list[str]:
    """The terms of one text, in order, with repeats."""
    return [t.decode() for t in (text or "").encode("utf-8", "replace").translate(_AS_TERMS).split()]


def _indexer(vocabulary):
    """Segments of the documents (id, text), with postings of the vocabulary's terms."""
    names = [x.split()[0] for x in SEGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.string())
        for batch in batches:
            ids, texts = batch.column(0), _as_terms(batch.column(1))
            room = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ids):
                to = int(np.searchsorted(room, (room[at - 1] if at else 0) + SEGMENT_BYTES, "right"))
                to = min(max(to, at + 1), at + SEGMENT)
                words, size = words_of(texts.slice(at, to - at))
                coded = words.dictionary_encode()
                of = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                term, doc = of[coded.indices.to_numpy()], np.repeat(np.arange(to - at), size)
                asked = term >= 0
                key, tf = np.unique(term[asked] * (to - at) + doc[asked], return_counts=True)
                part = ids.slice(at, to - at)
                columns = [
                    pc.fill_null(part, 0).to_numpy(zero_copy_only=False).astype("<i8"), part.is_null().to_numpy(zero_copy_only=False).astype("u1"),
                    size.astype("<i8"), (key // (to - at)).astype("<i4"), (key % (to - at)).astype("<i4"), tf.astype("<i4"),
                ]
                values = [pa.array([int((size > 0).sum())]), pa.array([int(size.sum())]), *(pa.array([c.tobytes()], pa.binary()) for c in columns)]
                yield pa.RecordBatch.from_arrays(values, names)
                at = to

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents that hold it) of a task's segments."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column(0):
            mine = np.bincount(np.frombuffer(raw.as_py(), "<i4"))
            if len(mine) > len(total):
                total, mine = mine.astype(np.int64), total
            total[: len(mine)] += mine
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])


@dataclass
class MaxTree:
    """The trees of all terms of a segment, level by level from the leaves, and the postings by leaf."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]
    doc_ids: list[int | None]
    leaf_first: np.ndarray
    term: np.ndarray
    doc: np.ndarray
    share: np.ndarray

    @staticmethod
    def of(segment: dict, weight: np.ndarray, n_docs: int, n_terms: int) -> "MaxTree":
        """From a segment's row and each term's weight; terms are numbered from 0 and postings sorted by them."""
        column = lambda name, kind: np.frombuffer(segment[name], kind)
        ids, null = column("doc_ids", "<i8"), column("null_ids", "u1")
        term, doc, tf = (column(c, "<i4").astype(np.int64) for c in ("term", "doc", "tf"))
        m = 10 + 90 * column("doc_terms", "<i8") * n_docs // max(1, n_terms)
        share = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        levels, node, of, best = [], doc // LEAF, term, share
        n = -(-len(ids) // LEAF)
        while True:
            first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (node[1:] != node[:-1])]) if len(of) else np.empty(0, np.int64)
            of, node, best = of[first], node[first], np.maximum.reduceat(best, first) if len(first) else best
            levels.append((np.searchsorted(of, np.arange(len(weight) + 1)), node, best, n))
            if n <= 1:
                break
            node, n = node // FAN, -(-n // FAN)
        by = np.argsort(doc // LEAF, kind="stable")
        leaf_first = np.searchsorted((doc // LEAF)[by], np.arange(levels[0][3] + 1))
        return MaxTree(levels, [None if x else i for i, x in zip(ids.tolist(), null)], leaf_first, term[by], doc[by], share[by])

    def nodes(self, level: int, terms: np.ndarray) -> np.ndarray:
        """The nodes of a level: a row for each term."""
        first, node, best, n = self.levels[level]
        out = np.zeros((len(terms), n), np.int64)
        size = first[terms + 1] - first[terms]
        row = np.repeat(np.arange(len(terms)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[terms][row]
        out[row, node[at]] = best[at]
        return out

    def search(self, terms: np.ndarray, wanted: np.ndarray, found: list[tuple[int, int]], k: int) -> None:
        """Put the segment's documents into `found`, a heap of the best (score, minus the id); `wanted` marks the terms."""
        top, held = len(self.levels) - 1, {}

        def bounds(level: int, low: int, high: int) -> list[int]:
            if level not in held:
                held[level] = self.nodes(level, terms)
            return held[level][:, low:high].sum(0).tolist()

        queue = [(-b, top, j) for j, b in enumerate(bounds(top, 0, 1)) if b > 0]
        while queue:
            bound, level, j = heapq.heappop(queue)
            if len(found) == k and -bound < found[0][0]:
                break
            if level:
                below = self.levels[level - 1][3]
                for i, b in enumerate(bounds(level - 1, FAN * j, min(FAN * j + FAN, below)), FAN * j):
                    if b > 0 and not (len(found) == k and b < found[0][0]):
                        heapq.heappush(queue, (-b, level - 1, i))
                continue
            part = slice(self.leaf_first[j], self.leaf_first[j + 1])
            mine = wanted[self.term[part]]
            score = np.zeros(LEAF, np.int64)
            np.add.at(score, self.doc[part][mine] - j * LEAF, self.share[part][mine])
            for i in np.flatnonzero(score >= max(1, found[0][0] if len(found) == k else 1)).tolist():
                doc_id = self.doc_ids[j * LEAF + i]
                one = (int(score[i]), -(1 << 63) if doc_id is None else -doc_id)
                if len(found) < k:
                    heapq.heappush(found, one)
                elif one > found[0]:
                    heapq.heapreplace(found, one)


def _searcher(given, k: int):
    """The k best documents of a task's segments for every item, as (item, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, n_docs, n_terms = given.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        wanted = np.zeros(len(weight), bool)
        for batch in batches:
            for row in range(batch.num_rows):
                tree = MaxTree.of(batch.slice(row, 1).to_pylist()[0], weight, n_docs, n_terms)
                for terms, found in zip(items, best):
                    wanted[terms] = True
                    tree.search(terms, wanted, found, k)
                    wanted[terms] = False
        rows = [(n, None if i == -(1 << 63) else -i, s) for n, found in enumerate(best) for s, i in found]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, kinds)], ["item", "doc_id", "score"])

    return run


def _one_pass(docs: DataFrame, items: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    asked = [sorted(set(terms_of(text))) for _, text in items]
    vocabulary = sorted(set().union(*asked))
    number = {t: n for n, t in enumerate(vocabulary)}
    context = spark.sparkContext
    path = new_path(spark, "segments")
    docs.mapInArrow(_indexer(context.broadcast(vocabulary)), SEGMENTS).write.parquet(path)
    segments = spark.read.schema(SEGMENTS).parquet(path)
    n_docs, n_terms = segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weight = np.zeros(len(vocabulary), np.int64)
    counts = segments.select("term").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for term, df in counts.collect():  # one row for each term of the pass's items at most
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    given = context.broadcast(([np.array([number[t] for t in terms], np.int64) for terms in asked], weight, n_docs, n_terms))
    hits = segments.mapInArrow(_searcher(given, k), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", pass_chars: int = PASS_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` documents with the highest score above 0 for every item, all if fewer.

    All documents and whole texts are searched. With N documents that have terms, L terms in all of them, df documents
    with a term, tf occurrences in a document of n terms: the term's weight w is floor(1000 ln((2N+2)/(2df+1))), the
    document's m is 10 + 90nN div L, and its score sums w * ((10^9 tf) div (1000 tf + 8m)) over the item's different
    terms. Equal scores go by ascending id, a null id last.

    A null or empty text has no terms: such a document is no hit and such an item has no rows. Documents that repeat an
    id are each ranked; rows of `items` that repeat id and text are one item, other texts of an id are items of their
    own. Empty tables give no rows; other columns are not read.

    The items are dealt into passes of about `pass_chars` characters by a hash, and each pass reads the documents once:
    the terms and items of a pass are all that is collected or broadcast. A pass writes its segments to the shared
    folder; a task returns `k` rows for an item at most.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(F.length("text") > 0).distinct()
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    passes = chars // pass_chars + 1
    out = None
    for n in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n).collect()
        if part:
            found = _one_pass(docs, part, k)
            out = found if out is None else out.unionByName(found)
    return _none(spark) if out is None else out


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
