"""Connected components of a graph of links, without ever holding the graph in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import stored

#: Links that one task may hold (16 bytes each) to end the work at once.
TASK_LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and for each the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    u, v = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(parent[u], parent[v])
        before = parent.copy()
        np.minimum.at(parent, parent[u], low)
        np.minimum.at(parent, parent[v], low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        if (before == parent).all():
            return nodes, nodes[parent]


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step: neighbours are hung onto each node's smallest neighbour."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); component is the smallest node reachable.

    Alternating large and small stars shrink the graph until it is a star for each
    component; each round is written to the shared folder, so lost executors cost one
    round at most. A graph of at most ``task_links`` links, of a size that is counted
    first, is finished by one task instead. Null ends, loops and repeated links are
    ignored. No links, no rows.
    """
    links = stored(links.filter("a != b").distinct(), "links")
    while (n := links.count()) > task_links:
        shrunk = stored(_star(_star(links, True), False), "links")
        if shrunk.count() == n and shrunk.exceptAll(links).isEmpty():
            root = shrunk.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return root.union(shrunk.select("b", "b").distinct())
        links = shrunk

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)) for x in batches if x.num_rows]
        if held:
            node, least = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["node", "component"])

    return links.coalesce(1).mapInArrow(finish, "node long, component long")
