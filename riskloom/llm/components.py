"""Connected components by alternating star contractions, as joins and partial minima."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); the root is the smallest node.

    Each round hangs a node's larger neighbours, then its smaller ones, on the smallest
    of them, until only stars are left. The rounds needed grow with the logarithm of the
    number of nodes. Each round is written, so a lost executor costs one round at most.
    """
    now = materialize(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialize(small.select("e.*").filter("u <> v").distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) that connect what a block's links connect.

    ``links[i, j]`` says that node ``left[i]`` and ``right[j]`` are linked. At most one
    edge per node comes out, however many links there are.
    """
    rows, cols = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    part, a, b = links[np.ix_(rows, cols)], left[rows].copy(), right[cols].copy()
    big = np.iinfo(np.int64).max
    while True:
        before = a.copy(), b.copy()
        for i in range(0, len(a), 256):
            a[i:i + 256] = np.minimum(a[i:i + 256], np.where(part[i:i + 256], b, big).min(1, initial=big))
        for i in range(0, len(a), 256):
            b = np.minimum(b, np.where(part[i:i + 256], a[i:i + 256, None], big).min(0, initial=big))
        if np.array_equal(before[0], a) and np.array_equal(before[1], b):
            break
    nodes, roots = np.concatenate((left[rows], right[cols])), np.concatenate((a, b))
    keep = nodes != roots
    return nodes[keep], roots[keep]


def pair_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) that connect what the pairs (a, b) connect."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[label])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]
