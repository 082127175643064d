"""Connected components of links too many for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable over links (a, b), for every node that has a link.

    Alternates two steps until nothing changes: every node hands its larger neighbours to the smallest node it knows,
    then its smaller ones. Each step is a map-side combined minimum and a join that adaptive execution may split, and
    the links never get more; a round's result is a table in the shared folder, so a lost executor costs one round.
    Links of a node to itself or with nulls are ignored; repeated links count once; no links give no rows.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        handed = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(handed.union(least).distinct(), "links")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link a node with the same components: each node that is not the smallest of its component, and that."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root]
        if np.array_equal(before, root):
            break
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]
