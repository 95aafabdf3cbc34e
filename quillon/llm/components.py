"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Shelf


# Links that one task joins directly; more take the rounds. Rows of a forest that a task holds before it passes them on.
LOCAL_LINKS = 500_000
HELD = 2_000_000


def _star(a, b):
    """Edges that join every node to the smallest of its component, without those nodes themselves."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def _forest(edges: DataFrame) -> DataFrame:
    """Replace the edges of each task by stars of the components they make: no more rows than came in."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            held = _star(*(np.concatenate([h, batch.column(c).to_numpy()]) for c, h in enumerate(held)))
            if len(held[0]) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=["a", "b"])
                held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def components(links: DataFrame, shelf: Shelf, most_rounds: int = 60, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the component's smallest node.

    A round sends every node's larger neighbours, then its smaller ones, to its smallest neighbour; it takes O(log^2)
    rounds, whatever the ids' order. Minima are combined before the shuffle, and the joins that hand them back are
    plain joins that adaptive execution splits when a node has a large share of the links. Each round is stored and
    the round before it deleted. Before all rounds every task reduces its links to stars; where no more than
    ``local_links`` are left, one more such step in one task gives the same answer without rounds.
    """
    edges = shelf.put(_forest(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")), "edges")
    if edges.count() <= local_links:
        return _labels(shelf.put(_forest(edges.coalesce(1)), "stars"))
    for _ in range(most_rounds):
        before = edges
        both = before.select(F.col("a").alias("u"), F.col("b").alias("v")).union(before.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = shelf.put(both.join(low, both["u"] == low["w"]).filter("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # In large every row points from a larger node a to a smaller one b.
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("w"), "m")
        joined = large.join(least, large["a"] == least["w"])
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges = shelf.put(_forest(small), "edges")
        done = _same(before, edges)
        shelf.drop(before, large)
        if done:
            return _labels(edges)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether the edges are stars (each larger node once, no centre a leaf) and did not change."""
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    fx, fy = (t.distinct().agg(F.count("*"), mark).first() for t in (x, y))
    return tuple(fx) == tuple(fy)
