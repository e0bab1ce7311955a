"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance 2 - 2c. Vectors are rotated and split into blocks of few
dimensions; each block gets the share of the squared distance that its dimensions have of all. Two vectors within
the distance are within the share in one block at least, so the union of the range joins of all blocks loses no
pair. A range join lays a grid over a block's first dimensions, over the more of them the more vectors share a label:
each vector lives in one cell and visits those cells of greater number that its ball touches, so of two vectors one
comes to the other; where they meet the block distance, then the exact cosine decide. A pair counts in the first block
that brings it together, so nothing is counted twice and no pair is ever written: a cell gives sums for its vectors and
a spanning forest of its links. Identical vectors of a label are one vector with a multiplicity and a number of its
own; ids come back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import _forest, components

#: Dimensions of a block, and the grid's cell width in radii of a block's ball.
BLOCK, WIDTH = 16, 2.0
#: A grid has one dimension, and one more for each time that its vectors are FEW times MORE as many; at most DEEPEST.
FEW, MORE, DEEPEST = 100, 4, 10
#: Vectors that the rotation is fitted on at most. It is orthogonal whatever they are, so results don't depend on them.
SAMPLE = 4096
#: Residents and visitors of a cell that meet in one group; more, such as very many vectors that are nearly the same, are
#: dealt into pieces, every piece meeting every other.
RESIDENTS, VISITORS = 256, 512
#: Added to squared budgets against rounding; the exact cosine decides afterwards.
SLACK = 1e-9


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, lot, vec: the vector as bytes (32-bit floats where they hold it exactly, else 64-bit ones after an
    empty byte), null where it can't link."""
    for batch in batches:
        vecs = []
        for v in batch.column(3).to_pylist():
            x = None if not v or None in v else np.array(v, np.float64) + 0.0
            vecs.append(None if x is None or not np.isfinite(x).all() or not x.any() else packed(x))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(vecs, pa.binary())], ["vec_id", "label", "lot", "vec"])


def packed(x: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small.tobytes() if (small.astype(np.float64) == x).all() else b"\0" + x.tobytes()


def dimensions(vec: bytes) -> int:
    return len(vec) // 8 if len(vec) % 4 else len(vec) // 4


def unpacked(vecs: list[bytes], dim: int) -> np.ndarray:
    """Vectors of `dim` dimensions as rows of 64-bit floats."""
    out = np.empty((len(vecs), dim))
    small = [k for k, v in enumerate(vecs) if len(v) % 4 == 0]
    large = [k for k, v in enumerate(vecs) if len(v) % 4]
    if small:
        out[small] = np.frombuffer(b"".join(vecs[k] for k in small), np.float32).reshape(-1, dim)
    if large:
        out[large] = np.frombuffer(b"".join(vecs[k][1:] for k in large), np.float64).reshape(-1, dim)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Plan:
    """The rotation of each dimension, its blocks and budgets."""

    def __init__(self, sample: list[bytes], cosine: float):
        self.cosine, self.few, self.rotations = cosine, FEW, {}
        by: dict[int, list[bytes]] = {}
        for v in sample:
            by.setdefault(dimensions(v), []).append(v)
        for dim, vs in by.items():
            x = _unit(unpacked(vs, dim))
            _, axes = np.linalg.eigh(np.cov(x.T) if len(x) > 1 and dim > 1 else np.eye(dim))
            self.rotations[dim] = self._dealt(axes[:, ::-1])

    @staticmethod
    def _dealt(axes: np.ndarray) -> np.ndarray:
        """The axes, widest first, dealt to the blocks in turn, so that each block's grid lies on wide ones."""
        dim = axes.shape[1]
        m = -(-dim // BLOCK)
        return axes[:, np.concatenate([np.arange(b, dim, m) for b in range(m)])]

    def rotation(self, dim: int) -> np.ndarray:
        return self.rotations[dim] if dim in self.rotations else self._dealt(np.eye(dim))

    def blocks(self, dim: int) -> list[tuple[int, int, float]]:
        """(first, end, squared budget) of each block."""
        m = -(-dim // BLOCK)
        sizes = [len(range(b, dim, m)) for b in range(m)]
        ends = np.cumsum(sizes).tolist()
        return [(e - s, e, (2 - 2 * self.cosine) * s / dim + SLACK) for s, e in zip(sizes, ends)]


def depth(population: np.ndarray, few: int = FEW) -> np.ndarray:
    """Dimensions of the grids for so many vectors."""
    times = np.log(np.maximum(population, 1) / few) / np.log(MORE)
    return np.clip(1 + np.round(times), 1, DEEPEST).astype(np.int64)


def _touched(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all cells that the balls around rows touch; y: coordinates in cell widths, a ball's radius is 1 / WIDTH."""
    home = np.floor(y).astype(np.int64)
    row, gap, cells = np.arange(len(y)), np.zeros(len(y)), np.zeros((len(y), 0), np.int64)
    reach = int(np.ceil(1 / WIDTH))
    for k in range(y.shape[1]):
        parts = []
        for step in range(-reach, reach + 1):
            cell = home[row, k] + step
            far = np.maximum(np.maximum(cell - y[row, k], y[row, k] - cell - 1), 0)
            now = gap + (far * WIDTH) ** 2
            ok = now <= 1
            parts.append((row[ok], now[ok], np.column_stack([cells[ok], cell[ok]])))
        row, gap, cells = (np.concatenate(x) for x in zip(*parts))
    return row, cells


def _cells(plan: Plan, with_vec: bool):
    """Rows (cell, visits, lot, dim, block, id, mult, vec) of vectors: in each block one as resident of its cell, and one
    for each other cell that its ball touches and that has a greater number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, mult, lot, population = (batch.column(k).to_numpy() for k in range(4))
            vecs = batch.column(4).to_pylist()
            dims = np.array([dimensions(v) for v in vecs], np.int64)
            deep = depth(population, plan.few)
            for dim, g in sorted(set(zip(dims.tolist(), deep.tolist()))):
                at = np.flatnonzero((dims == dim) & (deep == g))
                x = _unit(unpacked([vecs[i] for i in at], dim)) @ plan.rotation(dim)
                for b, (first, end, budget) in enumerate(plan.blocks(dim)):
                    y = x[:, first : min(end, first + g)] / (WIDTH * (np.sqrt(budget) + 1e-6))
                    home = _named(b, np.floor(y).astype(np.int64))
                    row, cells = _touched(y)
                    name = _named(b, cells)
                    up = name > home[row]
                    who, cell = at[np.concatenate([np.arange(len(at)), row[up]])], np.concatenate([home, name[up]])
                    visits = np.arange(len(who)) >= len(at)
                    cols = [pa.array(c) for c in (cell, visits, lot[who], np.full(len(who), dim, np.int32), np.full(len(who), b, np.int32), ids[who], mult[who])]
                    names = ["cell", "visits", "lot", "dim", "block", "id", "mult"]
                    if with_vec:
                        cols.append(pa.array([vecs[i] for i in who], pa.binary()))
                        names.append("vec")
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _named(block: int, cells: np.ndarray) -> np.ndarray:
    """One number for each cell; cells that share a number only make more pairs to look at."""
    with np.errstate(over="ignore"):
        h = np.full(len(cells), block + 1, np.uint64)
        for k in range(cells.shape[1]):
            h = (h ^ cells[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


CELLS = "cell long, visits boolean, lot long, dim int, block int, id long, mult long"
#: What a row is in its group: a resident, a visitor, or a resident that visits the pieces of its own cell.
RESIDENT, VISITOR, AT_HOME = 0, 1, 2


def _meet(plan: Plan):
    """From rows sorted by group, the links of each: (id, other, n): n links of id if other is null, else a link."""

    def links(rows: list[tuple[int, int, int, bytes]], dim: int, block: int, split: bool) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
        kind, ids, mult = (np.array([r[k] for r in rows]) for k in range(3))
        res = np.flatnonzero(kind == RESIDENT)
        vis = np.flatnonzero(kind != RESIDENT) if split else np.arange(len(rows))  # in a whole cell residents meet each other, too
        if not len(res) or not len(vis):
            return []
        spans = plan.blocks(dim)
        first, end, budget = spans[block]
        raw = unpacked([r[3] for r in rows], dim)
        x = _unit(raw) @ plan.rotation(dim)
        a, b = x[vis, first:end], x[res, first:end]
        near = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T <= budget + SLACK
        i, j = np.nonzero(near & ((kind[vis] == VISITOR)[:, None] | (ids[vis][:, None] < ids[res][None])))
        i, j = vis[i], res[j]
        ok = np.zeros(len(i), bool)
        for lo in range(0, len(i), 20_000):
            p, q = i[lo : lo + 20_000], j[lo : lo + 20_000]
            apart = np.add.reduceat((x[p] - x[q]) ** 2, [s for s, _, _ in spans], axis=1)
            hit = apart <= np.array([w for _, _, w in spans])
            mine = hit[:, block] & ~hit[:, :block].any(1)
            dot = (raw[p] * raw[q]).sum(1) / np.sqrt((raw[p] ** 2).sum(1) * (raw[q] ** 2).sum(1))
            ok[lo : lo + 20_000] = mine & (dot >= plan.cosine)
        i, j = i[ok], j[ok]
        if not len(i):
            return []
        n = np.bincount(i, mult[j], len(ids)) + np.bincount(j, mult[i], len(ids))
        return [(ids[n > 0], None, n[n > 0]), (*_forest(ids[i], ids[j]), None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                for ids, other, n in links(rows, group[2], group[3], group[6]):
                    empty = lambda: pa.nulls(len(ids), pa.int64())
                    cols = [pa.array(ids, pa.int64()), empty() if other is None else pa.array(other, pa.int64()), empty() if n is None else pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "other", "n"])

        for batch in batches:
            c = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for row in zip(*c):
                if group != row[:7]:
                    yield from closed()
                    group, rows = row[:7], []
                rows.append(row[7:])
        yield from closed()

    return run


def link_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null, they have as many dimensions, and their cosine in double
    precision is `cosine` or more. Labels may be of any type but a map. Vectors that are null, empty or zero, or hold a
    null or non-finite component, and rows with a null id link with nothing and stay. `n_links` counts the other rows
    linked to directly, rows of the same id included, each row by its own vector. `component_id` is the smallest id
    reachable from the row's vector. Other columns are not read; an empty table gives none.
    """
    label = F.col(label_col)
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), F.xxhash64(label).alias("lot"), F.col(vec_col).cast("array<double>").alias("v"))
    usable = named.mapInArrow(_usable, "vec_id long, label string, lot long, vec binary")
    able = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    key = F.when(able, F.unhex(F.sha2(F.concat(F.sha2(F.col("label").cast("binary"), 256).cast("binary"), F.col("vec")), 256)))
    rows = written(usable.select("vec_id", "lot", F.when(able, F.col("vec")).alias("vec"), key.alias("key")), "vectors")
    sets = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("mult"), F.first("lot").alias("lot"), F.first("vec").alias("vec"))
    # an id may have several vectors, so the sets are numbered by themselves; what is written keeps its numbers
    distinct = written(sets.withColumn("id", F.monotonically_increasing_id()), "distinct")
    sample = distinct.select("vec", F.xxhash64("key").alias("h")).orderBy("h", "vec").limit(SAMPLE).collect()
    plan = Plan([r["vec"] for r in sample], cosine)

    lots = distinct.groupBy("lot").agg(F.count(F.lit(1)).alias("population"))
    source = distinct.join(lots, "lot").select("id", "mult", "lot", "population", "vec")
    cell = ["cell", "lot", "dim", "block"]
    count = source.mapInArrow(_cells(plan, False), CELLS).groupBy(*cell).agg(F.count_if(~F.col("visits")).alias("r"), F.count_if("visits").alias("v"))
    # Cells in which nobody can meet go; the number of pieces of the others is the only thing that is joined.
    whole = (F.col("r") <= RESIDENTS) & (F.col("v") <= VISITORS)
    pieces = lambda n, most: F.when(whole, 1).otherwise(F.ceil(n / most).cast("int"))
    live = count.where("r > 0 and r + v > 1").select(*cell, (~whole).alias("split"), pieces(F.col("r"), RESIDENTS).alias("rs"), pieces(F.col("r") + F.col("v"), VISITORS).alias("vs"))
    entries = source.mapInArrow(_cells(plan, True), CELLS + ", vec binary").join(live, cell)
    piece = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # (kind, residents' piece, visitors' piece) of a row: once in a whole cell, else once for each piece of the others
    all_of = lambda kind, ns, make: F.transform(every(ns), lambda k: F.struct(F.lit(kind).alias("kind"), *make(k)))
    lives = all_of(RESIDENT, "vs", lambda k: (piece("rs").alias("rp"), k.alias("vp")))
    comes = lambda kind: all_of(kind, "rs", lambda k: (k.alias("rp"), piece("vs").alias("vp")))
    entries = entries.withColumn("e", F.explode(F.when(F.col("visits"), comes(VISITOR)).when(F.col("split"), F.concat(lives, comes(AT_HOME))).otherwise(lives)))
    order = [*cell, "rp", "vp"]
    met = entries.select(*cell, "e.rp", "e.vp", "split", "e.kind", "id", "mult", "vec").repartition(*order).sortWithinPartitions(*order)
    found = written(met.mapInArrow(_meet(plan), "id long, other long, n long"), "links")

    sums = found.where("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    linked = distinct.select("key", "id", "vec_id", "mult").join(sums, "id", "left").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    linked = written(linked.select("key", "component", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "linked")
    least = linked.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = written(linked.join(least, "component").select("key", "n_links", "component_id"), "known")
    out = rows.where("key is not null").select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = out.unionByName(alone)
    return both.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
