"""Connected components by repeated contraction, with aggregates and joins only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut

#: Edges that a task contracts at once, before the first round.
CHUNK = 1 << 20


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the smallest node of the component of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[up]


def stars(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b; a <= b) with the same components: those that a task has at once are replaced by their components' stars."""

    def run(batches):
        def star(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(some)
            nodes, roots = _roots(t.column("a").to_numpy(), t.column("b").to_numpy())
            alone = np.ones(len(nodes), bool)
            alone[np.searchsorted(nodes, roots[roots != nodes])] = False
            keep = alone | (roots != nodes)
            return pa.RecordBatch.from_arrays([pa.array(roots[keep]), pa.array(nodes[keep])], ["a", "b"])

        some, n = [], 0
        for batch in batches:
            some.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield star(some)
                some, n = [], 0
        if some:
            yield star(some)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (a node of its component) for the nodes of edges (a long, b long).

    Each round hooks every node to its smallest neighbour, follows the pointers one step more and contracts the graph.
    Ids in no order (hashes) make short pointer chains and few rounds; what each task contracts by itself beforehand saves
    some of them.  Minima are taken before the shuffle, so a node with very many neighbours costs no more than others; edges
    may repeat or point either way.  A node with an edge to itself only is its own root.  The rounds' pointers are followed
    once, at the end.  No table is broadcast: the driver would build each one and pass it on, round after round.
    """
    all_edges = cut(stars(edges).distinct())
    left, pointers = all_edges.filter("a <> b"), []
    while not left.isEmpty():
        hooked = left.union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        parent = cut(hooked.join(hooked.toDF("p", "q").hint("merge"), "p").select("a", F.col("q").alias("p")))
        moved = left.join(parent.toDF("a", "pa").hint("merge"), "a").join(parent.toDF("b", "pb").hint("merge"), "b").filter("pa <> pb")
        left = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        pointers.append(parent)
    labels = all_edges.select(F.col("a").alias("node")).union(all_edges.select("b")).distinct().withColumn("root", F.col("node"))
    for parent in pointers:
        labels = labels.join(parent.toDF("root", "to").hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return cut(labels)
