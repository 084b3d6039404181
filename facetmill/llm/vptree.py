"""Approximate nearest neighbours by vantage-point trees, one a shard.

Vectors are dealt by a hash of their id into shards, so no value, however common, makes a shard large. A shard
has SHARD_ROWS vectors or, of larger tables, a SHARD_SHARE of them up to SHARD_MOST, for every query goes to
every shard and their number should grow slower than the table. The task of a shard builds its tree and runs all queries through it in
blocks: a node measures the distance d of its vantage point to all queries that reach it; the half
on the query's own side of the radius is searched first, the other only if
factor * |d - radius| <= t, with t the distance of the k-th best so far. Factor 1 restores exact
search; a greater factor prunes more. Leaves are scanned by a matrix product with a margin for its
rounding, and what passes is measured again exactly. The shards' k best are merged per query.

Edge cases: rows without an id, and vectors that are null, empty, zero or hold null or non-finite
parts, take no part; vectors of other lengths are not compared; equal ids count as one row, of the
least vector; ties go to the smaller id; fewer candidates than k give all of them; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetmill.sources.memory import tidy
from facetmill.sources.scratch import Scratch, arrow_rows

SHARD_ROWS = 16_384
SHARD_MOST = 131_072
SHARD_SHARE = 64
LEAF = 256
FACTOR = 2.0
QUERY_BLOCK = 1024


class Tree:
    """A vantage-point tree over rows x dims (float64) with ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, seed: int = 27):
        self.ids, self.x, self.norm, self.scanned = ids, x, (x * x).sum(axis=1), 0
        rng = np.random.default_rng(seed)

        def grow(rows: np.ndarray):
            if len(rows) <= leaf:
                return rows
            v = rows[rng.integers(len(rows))]
            d = np.sqrt(((x[rows] - x[v]) ** 2).sum(axis=1))
            radius = float(np.median(d))
            inside = d <= radius
            if inside.all():  # many equal distances: halve in order, both at any radius
                inside = d < radius
                if not inside.any():
                    half = len(rows) // 2
                    return v, radius, radius, radius, grow(rows[:half]), grow(rows[half:])
            return v, float(d[inside].max()), float(d[~inside].min()), radius, grow(rows[inside]), grow(rows[~inside])

        self.root = grow(np.arange(len(ids)))

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances), each queries x k, by distance, then id; missing ones have distance inf."""
        n = len(q)
        ids, dist = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.inf)
        qn = (q * q).sum(axis=1)

        def scan(rows: np.ndarray, at: np.ndarray) -> None:
            self.scanned += len(rows) * len(at)
            rough = qn[at, None] + self.norm[rows] - 2 * (q[at] @ self.x[rows].T)
            slack = 1e-9 * (qn[at, None] + self.norm[rows]) + 1e-12
            fit = (rough <= (dist[at, -1] ** 2)[:, None] + slack) & (self.ids[rows][None] != own[at, None])
            a, b = np.nonzero(fit)
            if not len(a):
                return
            d = np.sqrt(((q[at[a]] - self.x[rows[b]]) ** 2).sum(axis=1))
            new = np.full(fit.shape, np.inf)
            new[a, b] = d
            hit = np.flatnonzero(fit.any(axis=1))
            all_d = np.concatenate([dist[at[hit]], new[hit]], axis=1)
            all_i = np.concatenate([ids[at[hit]], np.broadcast_to(self.ids[rows], (len(hit), len(rows)))], axis=1)
            order = np.lexsort((all_i, all_d), axis=1)[:, :k]
            dist[at[hit]], ids[at[hit]] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                scan(node, at)
                return
            v, low, high, radius, inner, outer = node
            d = np.sqrt(((q[at] - self.x[v]) ** 2).sum(axis=1))
            first = d <= radius
            for side, near, far, bound in ((first, inner, outer, high - d), (~first, outer, inner, d - low)):
                mine = at[side]
                visit(near, mine)
                visit(far, mine[factor * bound[side] <= dist[mine, -1] * (1 + 1e-12)])

        visit(self.root, np.arange(n))
        ids[np.isinf(dist)] = np.iinfo(np.int64).max
        return ids, dist


def usable(v: str) -> Column:
    """Whether a vector column holds finite numbers, not all of them 0."""
    c = F.col(v)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


def _shard_search(k: int, factor: float):
    """Rows of a shard (query false) come before the queries (query true); each partition holds whole shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, trees = None, {}, None

        def matrix(b: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            v = b.column(3)
            width = np.diff(v.offsets.to_numpy())
            ids, flat = b.column(2).to_numpy(), v.flatten().to_numpy().astype(np.float64)
            start = np.concatenate(([0], np.cumsum(width)))[:-1]
            return {int(w): (ids[at := np.flatnonzero(width == w)], flat[start[at][:, None] + np.arange(w)]) for w in np.unique(width)}

        def build() -> dict[int, Tree]:
            out = {}
            for w, parts in held.items():
                ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                order = np.lexsort((*x.T[::-1], ids))
                ids, x = ids[order], x[order]
                keep = np.concatenate(([True], ids[1:] != ids[:-1]))
                out[w] = Tree(ids[keep], x[keep])
            return out

        for batch in batches:
            shards, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            edges = [0, *cut.tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if shards[lo] != shard:
                    shard, held, trees = shards[lo], {}, None
                got = matrix(batch.slice(lo, hi - lo))
                if not asks[lo]:
                    for w, part in got.items():
                        held.setdefault(w, []).append(part)
                    continue
                trees = build() if trees is None else trees
                for w, (ids, x) in got.items():
                    if w not in trees:
                        continue
                    for i in range(0, len(ids), QUERY_BLOCK):
                        q = ids[i : i + QUERY_BLOCK]
                        found, d = trees[w].search(x[i : i + QUERY_BLOCK], q, k, factor)
                        a, b = np.nonzero(np.isfinite(d))
                        yield pa.RecordBatch.from_arrays([pa.array(q[a]), pa.array(found[a, b]), pa.array(d[a, b])], names=["query_id", "vec_id", "score"])

    return run


def nearest(spark: SparkSession, rows: DataFrame, asks: DataFrame, k: int = 10, factor: float = FACTOR, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each of asks its k nearest of rows but its own id; both hold vec_id and embedding."""
    with Scratch(spark, "vptree") as scratch, arrow_rows(spark, 4096):
        good = [t.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("long"), "embedding") for t in (rows, asks)]
        if any(t.schema["embedding"].dataType.simpleString() != "array<float>" for t in good):  # floats travel as they are
            good = [t.withColumn("embedding", F.col("embedding").cast("array<double>")) for t in good]
        n = good[0].count()
        shards = max(1, -(-n // (shard_rows or max(SHARD_ROWS, min(SHARD_MOST, n // SHARD_SHARE)))))
        kept = good[0].select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("ask"), "vec_id", "embedding")
        asked = good[1].groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("ask"), "vec_id", "embedding")
        dealt = kept.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "ask")
        found = dealt.mapInArrow(tidy(_shard_search(k, factor)), "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return scratch.keep(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(spark, rows, rows.where(F.col("vec_id") % 100 == 0))
