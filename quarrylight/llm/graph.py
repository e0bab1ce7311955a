"""Connected components of a link table, in rounds of hooking and pointer jumping.

Nothing is collected: links stay distributed, and each round contracts them. Before the first round every task
reduces its own links to a spanning forest, which flattens most stars and chains at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links that a task holds at most while it reduces them.
HELD = 500_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star (member, smallest id) for each component of the links a-b."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = np.arange(len(names))
    u, v = at[: len(a)], at[len(a) :]
    while True:
        m = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, low[u], m)
        np.minimum.at(new, low[v], m)
        while (new[new] != new).any():
            new = new[new]
        new = new[low]
        if (new == low).all():
            break
        low = new
    own = low != np.arange(len(names))
    return names[own], names[low[own]]


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]))
        size += held[-1].shape[1]
        if size > HELD:
            held = [np.stack(_forest(*np.concatenate(held, 1)))]
            size = held[0].shape[1]
            if size > HELD / 2:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["a", "b"])
                held, size = [], 0
    if held:
        a, b = _forest(*np.concatenate(held, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): for every id of the links (a, b: long), the smallest id it reaches. Ids without links are absent.

    A round points every root at its smallest neighbour of lower id, flattens the chains by pointer jumping, and
    relabels the links. Tables of a round are written to the shared folder. Every link ends as loop, so repeated links
    and loops do no harm. If links are left after `most_rounds`, that is an error: nothing is returned half merged.
    """
    links = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = written(links.mapInArrow(_reduced, "a long, b long").where("a <> b"), "links")
    label: DataFrame | None = None
    for _ in range(most_rounds):
        high, low = F.greatest("a", "b"), F.least("a", "b")
        # of roots that point to a lower one; a root that only has higher neighbours stays
        parent = written(edges.groupBy(high.alias("id")).agg(F.min(low).alias("up")), "parents")
        if parent.isEmpty():
            break
        while True:
            hop = parent.alias("p").join(parent.alias("q"), F.col("p.up") == F.col("q.id"), "left").select("p.id", F.coalesce("q.up", "p.up").alias("up"), F.col("q.up").isNotNull().alias("moved"))
            hop = written(hop, "hops")
            if hop.where("moved").isEmpty():
                break
            parent = hop.select("id", "up")
        if label is None:
            label = parent.select("id", F.col("up").alias("component"))
        else:
            # ids that pointed at a root follow it; the root itself is new
            moved = label.join(parent.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
            label = moved.unionByName(parent.select("id", F.col("up").alias("component")))
        label = written(label, "labels")
        up = lambda c: parent.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up"))
        edges = edges.join(up("a"), "a", "left").join(up("b"), "b", "left")
        edges = edges.select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b")).where("a <> b")
        edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    else:
        if not edges.isEmpty():
            raise RuntimeError(f"links are left after {most_rounds} rounds")
    if label is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    roots = label.select(F.col("component").alias("id"), "component").distinct()
    return label.unionByName(roots)
