"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.sources.scratch import Scratch

ONE_TASK = 1_000_000  # edges, about 100 MB, that one task may join; more go through rounds of joins


def hung(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's part, with edges u-v between nodes 0, 1, ... added to what label says of them."""
    while True:  # hang the larger root under the smaller, then shorten all paths
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while (shorter := label[label] != label).any():
            label = np.where(shorter, label[label], label)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of one partition by stars around the smallest node of each part."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    label = hung(np.arange(len(nodes)), at[: len(u)], at[len(u) :])
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    for i in range(0, len(leaf), 100_000):
        x = leaf[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[label[x]])], names=["u", "v"])


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (two long columns); component is the smallest node.

    Up to ONE_TASK edges are joined by one task. Beyond, each partition shrinks its own edges to stars, then
    rounds of large-star and small-star joins run until nothing changes; every round is a written table,
    so neither lineage nor memory grows. Loops and repeated edges are ignored.
    """
    a, b = edges.columns[:2]
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    few = scratch.table(e, "edges")
    n = few.count()
    e = scratch.table((few.coalesce(1) if n <= ONE_TASK else few.distinct()).mapInArrow(_stars, "u long, v long"), "stars")

    def result(t: DataFrame) -> DataFrame:
        nodes = t.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return nodes.union(t.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

    if n <= ONE_TASK:
        return result(e)

    def state(t: DataFrame):
        return t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    known = state(e)
    for _ in range(rounds if known[0] else 0):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = large.mapInArrow(_stars, "u long, v long")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        e = scratch.table(small, "stars")
        now = state(e)
        if now == known:
            break
        known = now
    return result(e)
