"""MinHash near-dedup with odd sketches.

Documents are sets of distinct word shingles; equal sets are one from here on. MinHash samples are cut into bands,
and sets that agree on a band fall into one bucket. One-permutation MinHash samples, of small sets all elements, are
folded into a parity bitmap (an odd sketch): in how many bits two bitmaps differ tells the similarity, most
precisely where it is high, so most candidates are dropped without their sets. The rest are confirmed on the full
sets.

No bucket gives all its pairs. First each bucket is a star around its busiest set; what the confirmed stars connect
needs no further look. Buckets that still hold several components are looked at: pairs across components that the
sketches let through come out, each from the first bucket it shares. Sets that aren't very large go along, so that of
their pairs only links come out, and of these only such as join what others have not joined: no more than there are
components.

A crowded bucket, as a passage makes that very many different documents share, is looked at in another way: its sets'
elements are ordered from the rarest to the most frequent, and sets as similar as asked for share one of their first
elements, of as many as their sizes leave room to differ in. So sets only meet over rare elements, and those that have
the passage alone in common don't. Sets meet by two classes of like size, those of one with those of the other; where
very many do, they are cut into pieces, each of one side against each of the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components

WORDS, PERCENT = 5, 75
#: Bands and rows: sets of similarity 0.75 share no band with probability 5e-6.
BANDS, ROWS = 32, 4
#: Bins of the one-permutation samples, bits of an odd sketch, and by how many deviations a pair may miss its limit.
BINS, BITS, DEVIATIONS = 1024, 2048, 5.0
#: Sets of a bucket beyond which it is crowded, the step of sizes from a class to the next where elements are ordered, and
#: the sets of a piece.
CROWD, STEP, PIECE = 512, 1.03, 512
#: Elements of the sets that go along with their entries, so that links are confirmed where the pieces meet.
CARRIED = 2048

_K = BANDS * ROWS
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EACH = _rng.integers(1, 1 << 63, _K, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; words are lower-cased in ASCII only."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total += _mixed(h[k : len(h) - n + 1 + k] * _PLACE[k])
        return np.unique(_mixed(total))


def signature(s: np.ndarray) -> tuple[list[int], list[int], int]:
    """Band keys, odd sketch and number of samples in it, of a non-empty sorted set."""
    with np.errstate(over="ignore"):
        low = np.full(_K, ~np.uint64(0))
        for at in range(0, len(s), 2048):
            low = np.minimum(low, (s[at : at + 2048, None] * _MULTIPLY).min(0))
        sample = _mixed(low ^ _EACH)
        bands = _mixed(sample.reshape(BANDS, ROWS) * _MULTIPLY[:ROWS]).sum(1) + np.arange(BANDS, dtype=np.uint64)
        bins = s // np.uint64(2**64 // BINS)
        least = s[np.concatenate([[True], bins[1:] != bins[:-1]])]  # the set is sorted: the first of a bin is its minimum
        bits = np.bincount((_mixed(least * _MULTIPLY[0]) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return _mixed(bands).view(np.int64).tolist(), np.packbits(bits.astype(np.uint8)).view(np.int64).tolist(), len(least)


def most_different(na, nb, sa, sb, lib=np):
    """In how many bits the sketches of two sets may differ; `lib` is numpy, or Spark's functions for columns.

    na, nb: sizes, sa, sb: samples. At the similarity asked for, the union has (na + nb) / 1.75 elements, of which a
    number known but for chance are samples of either set, and three quarters of those are expected in both. What the
    samples of the union, their draw and the bits add to the variance is independent, so it is added up.
    """
    j = PERCENT / 100
    union = (na + nb) / (1 + j)
    empty = lib.exp(-union / BINS)
    seen = BINS * (1 - empty)
    filled = BINS * empty * (1 - (1 + union / BINS) * empty)  # the variance of the number of bins with a sample
    shared = j * (1 - j) * seen * (1 - seen / (union + 1)) + j**2 * filled
    apart = sa + sb - 2 * (j * seen - 1)
    apart = lib.maximum(apart, 0 * na) if lib is np else lib.greatest(apart, lib.lit(0.0))
    slope = lib.exp(-2 * apart / BITS)
    deviation = apart * (2 / BITS) ** 0.5
    cap = 0 * na + BITS**0.5 / 2
    deviation = lib.minimum(deviation, cap) if lib is np else lib.least(deviation, cap)
    return BITS / 2 * (1 - slope) + DEVIATIONS * lib.sqrt(deviation**2 + 4 * slope**2 * shared) + 1


def _key(s: np.ndarray) -> bytes | None:
    from hashlib import blake2b

    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            n, keys, bands, sketches, samples = [], [], [], [], []
            for text in part.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                keys.append(_key(s))
                b, o, k = signature(s) if len(s) else (None, None, None)
                bands.append(b)
                sketches.append(o)
                samples.append(k)
            cols = [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(samples, pa.int64())], ["id", "h", "n", "key", "bands", "sketch", "samples"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets (id, s) of rows (id, key, text) whose text has that key."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            made = ((i, key, shingles(t)) for i, key, t in zip(*(c.to_pylist() for c in part.columns)))
            ids, sets = [], []
            for i, key, s in made:
                if _key(s) == key:
                    ids.append(i)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of `_sets` as bytes."""
    for part in _sets(batches):
        sets = [s.values.to_numpy().tobytes() for s in part.column(1)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "s"])


def _differ(a: Column, b: Column) -> Column:
    """Bits in which two odd sketches differ."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, BITS // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _enough(small: Column, large: Column) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    return 100 * small >= PERCENT * large


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) that sizes and odd sketches let through, with the sizes of both sets."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"o{c}"), F.col("samples").alias(f"s{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where(_enough(F.least("na", "nb"), F.greatest("na", "nb")) & (_differ(F.col("oa"), F.col("ob")) <= most_different(*(F.col(c) for c in ("na", "nb", "sa", "sb")), lib=F)))
    return near.select("a", "b", "na", "nb")


def _texts(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, key, text) of sets (id, key, first, h)."""
    return docs.withColumnRenamed("id", "first").join(needed, ["first", "h"]).select("id", "key", "text")


def _confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among near pairs (a, b, na, nb), on the full sets, made again from the texts of the sets left.

    Each set is made from a document that has it, the one of the smallest id.
    """
    near = written(pairs, "near")
    needed = near.select(F.col("a").alias("id")).distinct().union(near.select("b").distinct()).distinct()
    needed = sets.select("id", "key", "first", "h").join(needed, "id", "left_semi")
    full = written(_texts(needed, docs).mapInArrow(_sets, "id long, s array<long>").dropDuplicates(["id"]), "sets")
    both = near.join(full.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    return written(both.where(100 * shared >= PERCENT * (F.col("na") + F.col("nb") - shared)).select("a", "b"), "confirmed")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, and their sizes) across components that sizes and sketches let through, from rows sorted by bucket and pieces.

    Pairs whose sets came along are compared on these, too, and left out if those before them join their components.
    """

    def joining(one, two, ca, cb, na, nb, i, j) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs i, j, the links that join components which those before them didn't, and all without their sets."""
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while c in up:
                up[c] = up.get(up[c], up[c])
                c = up[c]
            return c

        kept = []
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            if one[x] is not None and two[y] is not None:
                c, d = root(int(ca[x])), root(int(cb[y]))
                if c == d:
                    continue
                shared = len(np.intersect1d(np.frombuffer(one[x], np.uint64), np.frombuffer(two[y], np.uint64), True))
                if 100 * shared < PERCENT * (int(na[x]) + int(nb[y]) - shared):
                    continue
                up[max(c, d)] = min(c, d)
            kept.append(k)
        return i[kept], j[kept]

    def pairs(one: list[tuple], two: list[tuple], same: bool) -> pa.RecordBatch:
        (ia, ca, na, sa, ba, oa, ha), (ib, cb, nb, sb, bb, ob, hb) = ([np.array(c) for c in zip(*rows)] for rows in ([r[:7] for r in one], [r[:7] for r in two]))
        at = []
        for k in range(len(ia)):
            fits = (cb != ca[k]) & (PERCENT * np.maximum(nb, na[k]) <= 100 * np.minimum(nb, na[k])) & ~(hb | ha[k])
            fits &= (ib > ia[k]) if same else True
            j = np.flatnonzero(fits)
            differ = np.bitwise_count(oa[k].view(np.uint64) ^ ob[j].view(np.uint64)).sum(1)
            j = j[differ <= most_different(na[k] + 0.0 * nb[j], nb[j] + 0.0, sa[k], sb[j])]
            at.append(np.stack([np.full(len(j), k), j]))
        i, j = np.concatenate(at, 1)
        own = (ba[i] == bb[j]).argmax(1) == band  # each pair in the first bucket that it shares
        i, j = joining([r[7] for r in one], [r[7] for r in two], ca, cb, na, nb, i[own], j[own])
        one_first = ia[i] < ib[j]
        ordered = [np.where(one_first, x, y) for x, y in ((ia[i], ib[j]), (ib[j], ia[i]), (na[i], nb[j]), (nb[j], na[i]))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ordered], ["a", "b", "na", "nb"])

    group, sides, band = None, ([], []), -1
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["bucket"], r["p"], r["q"])
            if key != group:
                if sides[0] and (sides[1] or group[1] == group[2]):
                    yield pairs(sides[0], sides[1] or sides[0], not sides[1])
                group, sides = key, ([], [])
                band = r["bands"].index(r["bucket"])
            row = (r["id"], r["component"], r["n"], r["samples"], r["bands"], r["sketch"], r["id"] == r["hub"], r["s"])
            sides[r["piece"] != r["p"]].append(row)
    if sides[0] and (sides[1] or group[1] == group[2]):
        yield pairs(sides[0], sides[1] or sides[0], not sides[1])


def _labelled(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Bucket entries with the component of each id."""
    known = groups.select("id", "component")
    return entries.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _mixed_buckets(entries: DataFrame) -> DataFrame:
    """Of entries (bucket, id, component), those of buckets with several components, with the bucket's size."""
    open_ = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return entries.join(open_.select("bucket", "size"), "bucket")


def _by_rare_elements(crowded: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Entries (bucket, id, component) of sets (id, component) such that similar ones share a bucket, which is a rare element.

    Elements are ordered by the number of sets that hold them, then by themselves. Two sets of n and m elements that
    are similar enough share at least a = 0.75 / 1.75 (n + m), so one of the first n - a + 1 of one and of the first
    m - a + 1 of the other is common. How many that are is told by the sizes' classes: a bucket is two classes and an
    element. What only one set holds comes first in the order and makes no bucket.
    """
    own = crowded.join(sets.select("id", "n", "key", "first", "h"), "id")
    full = written(_texts(own, docs).mapInArrow(_sets, "id long, s array<long>").dropDuplicates(["id"]), "crowd")
    each = full.select("id", F.explode("s").alias("e"))
    shared = each.join(each.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "e")
    ordered = shared.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("c")).join(own.select("id", "n", "component"), "id")

    step, few = float(np.log(STEP)), 1e-9
    least = lambda k: F.floor(F.exp(k * step) * (1 - few))  # noqa: E731  the least size of a class, or less
    mine = F.floor(F.log("n") / step).cast("int")
    reach = int(np.ceil(np.log(100 / PERCENT) / step)) + 1
    other = F.explode(F.sequence(F.col("class") - reach, F.col("class") + reach))
    met = ordered.withColumn("class", mine).select("*", other.alias("other"))
    low = F.greatest(least(F.col("other")), F.ceil(F.col("n") * (PERCENT / 100) - few))
    met = met.withColumn("low", low).where((PERCENT * F.col("low") <= 100 * F.col("n") + 1) & (least(F.col("other") + 1) * (1 + few) + 2 >= F.col("low")))
    common = F.ceil((F.col("n") + F.col("low")) * (PERCENT / (100 + PERCENT)) - few)
    room = F.col("n") - common + 1 - (F.col("n") - F.size("c"))
    first = F.slice("c", F.lit(1), F.greatest(F.least(room, F.size("c").cast("long")), F.lit(0)).cast("int"))
    x, y = F.least("class", "other"), F.greatest("class", "other")
    rows = met.select("id", "component", x.alias("x"), y.alias("y"), (F.col("class") > F.col("other")).cast("int").alias("side"), F.explode(first).alias("at"))
    return rows.select(F.xxhash64("x", "y", "at.e").alias("bucket"), "id", "component", "side", (F.col("x") == F.col("y")).alias("alike"))


def _sides(rare: DataFrame) -> DataFrame:
    """Entries of `_by_rare_elements` that can meet others, with their piece and the first and last piece that they meet.

    The pieces of the side of smaller sets come first; in a bucket of one class the sets meet among themselves.
    """
    size = rare.groupBy("bucket").agg(
        F.count_if(F.col("side") == 0).alias("small"), F.count_if(F.col("side") == 1).alias("large"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    live = size.where("lo < hi")
    n = lambda c: F.greatest(F.ceil(F.col(c) / PIECE), F.lit(1)).cast("int")
    rows = rare.join(live.select("bucket", "small", "large", n("small").alias("a"), n("large").alias("b")), "bucket")
    rows = rows.where(F.when(F.col("alike"), F.col("small") > 1).otherwise((F.col("small") > 0) & (F.col("large") > 0)))
    dealt = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    first = F.col("side") == 0
    return rows.select(
        "bucket", "id", "component", F.when(first, dealt("a")).otherwise(F.col("a") + dealt("b")).alias("piece"),
        F.when(first & ~F.col("alike"), F.col("a")).otherwise(0).alias("first"), F.when(first & ~F.col("alike"), F.col("a") + F.col("b") - 1).otherwise(F.col("a") - 1).alias("last"),
    )


def link_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `documents`: doc_id, n_shingles, component_id, kept.

    Documents link if their sets of distinct shingles share at least 75 % of their union. A text of fewer words than
    a shingle has is one shingle; a null or empty text, or one without words, has none and links with nothing, as does
    a row with a null id. Equal sets link. `component_id` is the smallest id reachable. Every row counts by its own
    text, so rows that repeat an id with different texts may be in different components. Very long texts are read
    whole. Other columns are not read; an empty table gives none.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    rows = written(docs.mapInArrow(_signed, "id long, h long, n long, key binary, bands array<long>, sketch array<long>, samples long"), "signatures")
    able = rows.where("key is not null and id is not null")
    firsts = able.groupBy("key").agg(F.min(F.struct("id", "h")).alias("least")).select("key", "least.*")
    sets = able.select("key", "id", "h", "n", "bands", "sketch", "samples").join(firsts, ["key", "id", "h"], "left_semi").dropDuplicates(["key"])
    # a set has a number of its own, `id` from here on: two sets may have their smallest document id in common
    sets = written(sets.withColumnRenamed("id", "first").withColumn("id", F.monotonically_increasing_id()), "distinct-sets")

    entries = sets.select("id", F.explode("bands").alias("bucket"))
    live = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    entries = written(entries.join(live, "bucket"), "entries")
    busy = entries.groupBy("id").agg(F.sum("size").alias("busy"))
    ranked = entries.join(busy, "id")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct(F.col("busy"), (-F.col("id")).alias("minus"))).alias("top")).select("bucket", (-F.col("top.minus")).alias("hub"))
    starred = written(entries.join(hubs, "bucket"), "stars")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = starred.where("id <> hub").select(*pair("id", "hub")).distinct()
    links = _confirmed(_near(stars, sets), sets, docs)
    groups = components(links)

    left = _mixed_buckets(_labelled(starred.select("bucket", "id", "hub"), groups))
    left = written(left, "left")
    whole = left.where(F.col("size") <= CROWD).select("bucket", "id", "hub", "component", *(F.lit(0).alias(c) for c in ("piece", "first", "last")), F.lit(False).alias("rare"))
    crowded = left.where(F.col("size") > CROWD).select("id", "component").distinct()
    if not crowded.isEmpty():
        rare = _sides(written(_by_rare_elements(crowded, sets, docs), "rare")).withColumn("rare", F.lit(True))
        whole = written(whole.unionByName(rare.withColumn("hub", F.lit(None).cast("long"))), "left-rare")
    carried = whole.select("id").distinct().join(sets.where(F.col("n") <= CARRIED).select("id", "key", "first", "h"), "id")
    carried = written(_texts(carried, docs).mapInArrow(_carried, "id long, s binary").dropDuplicates(["id"]), "carried")
    left = whole.join(sets.select("id", "n", "samples", "bands", "sketch"), "id").join(carried, "id", "left")
    left = left.withColumn("bands", F.when(F.col("rare"), F.array("bucket")).otherwise(F.col("bands")))  # a rare element's is its own first bucket
    meets = F.transform(F.sequence("first", "last"), lambda k: F.struct(F.least(k, "piece").alias("p"), F.greatest(k, "piece").alias("q")))
    dealt = left.select("bucket", "id", "hub", "component", "piece", "n", "samples", "bands", "sketch", "s", F.explode(meets).alias("m")).select("*", "m.*").drop("m")
    order = ["bucket", "p", "q"]
    across = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_across, "a long, b long, na long, nb long").distinct()
    more = _confirmed(across, sets, docs)
    if not more.isEmpty():
        groups = components(links.unionByName(more))

    named = sets.select("key", "id", "first").join(groups, "id", "left").select("key", "first", F.coalesce("component", "id").alias("component"))
    named = written(named, "components")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("key", "component_id")
    linked = able.select("id", "n", "key").join(named, "key").select("id", "n", "component_id")
    alone = rows.where("key is null or id is null").select("id", "n", F.col("id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `link_documents` keeps, with all their columns; rows with a null id stay."""
    mark = "kept"
    while mark in docs.columns:
        mark += "_"
    kept = link_documents(docs, id_col, text_col).where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias(mark)).distinct()
    key = F.col(id_col).cast("long")
    return docs.where(key.isNotNull()).join(kept, key == F.col(mark), "left_semi").unionByName(docs.where(key.isNull()))
