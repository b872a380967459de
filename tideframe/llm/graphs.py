"""Connected components of a link table, as rounds of joins and small aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tideframe.session import STAGED, drop_folder, staged


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of links a-b, without the smallest ones:
    at most one link per node that connects what all the links connect."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` that isn't the smallest of its component; root is.

    Large-star and small-star rounds: each node's greater neighbours move to its smallest one, then
    its smaller neighbours do.  Nodes come out of plain aggregates, so a hub with a third of all
    links is summed before the shuffle, and its join is one AQE can split.  A round is written to the
    shared folder; the number of rounds grows with the logarithm of the longest chain."""
    def star(edges: DataFrame, large: bool) -> DataFrame:
        """edges: u > v, distinct."""
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u")
        if large:
            out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = staged(links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        last = STAGED[-1]
        edges = staged(star(star(edges, True), False))
        STAGED.remove(last)
        drop_folder(*last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
