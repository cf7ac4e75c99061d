"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash

#: Edges (4 MB) that the driver labels by itself; more take rounds of joins.
SMALL = 1 << 18


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the edges (a, b), sorted, and the smallest end that each reaches.

    In a round each component joins the least neighbour that is smaller than itself; only those without one stay, half at most.
    """
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ix[: len(a)], ix[len(a) :]
    label = np.arange(len(nodes))
    while len(cross := np.flatnonzero(label[x] != label[y])):
        x, y = x[cross], y[cross]
        p, q = label[x], label[y]
        up = np.arange(len(nodes))
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    return nodes, nodes[label]


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges(a long, b long)``: (node, component).

    Up to ``SMALL`` edges, repeated ones included, come to the driver: rounds of joins over so few cost their stages alone. More take
    alternating large-star and small-star steps over DataFrames until no edge changes: O(log n) rounds in
    practice. Each round is grouped minima (combined map-side) and an equi-join that adaptive execution can split at
    hub nodes; each round is written to the shared folder. Self-loops and repeated edges are allowed; nulls are
    dropped; an empty table gives an empty result. What a round wrote goes when the next has been written.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    e = stash(e, "edges")
    if e.count() <= SMALL:
        few = e.toArrow()
        discard(e)
        nodes, least = labelled(*(few.column(c).to_numpy() for c in ("u", "v")))
        made = pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(least, pa.int64())})
        return edges.sparkSession.createDataFrame(made, "node long, component long")
    e, repeated = stash(e.distinct(), "edges"), e
    discard(repeated)
    while True:
        # Large star: every larger neighbour of u points to the smallest of u and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, F.col("u") == F.col("lu")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        large = stash(large, "large")
        # Small star: u and its smaller neighbours point to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), "m")
        joined = large.join(low, F.col("u") == F.col("lu"))
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(low.select(F.col("lu").alias("u"), F.col("m").alias("v")))
        )
        new = stash(small.distinct(), "small")
        discard(e, large)
        # A star forest: no node is both an end and a centre.
        is_star = new.join(new.select(F.col("u").alias("x")).distinct(), F.col("v") == F.col("x"), "left_semi").isEmpty()
        degree_one = is_star and new.groupBy("u").count().where("count > 1").isEmpty()
        if degree_one:
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        e = new
