"""Recall and work of the tree on vectors that let it prune, over several shards."""

import numpy as np
import pytest

from facetmill.llm import vptree


def low_rank(n, dims, seed=2):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dims)) @ rng.normal(size=(dims, 24)) + rng.normal(0, 0.02, (n, 24))


@pytest.mark.parametrize("dims", [3, 6, 12])
def test_pruned_search(spark, dims):
    x = low_rank(6000, dims).astype(np.float32)
    asks = range(0, 6000, 40)
    d = {q: np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1)) for q in asks}
    want = {(q, int(i)) for q in asks for i in [i for i in np.lexsort((np.arange(6000), d[q])) if i != q][:10]}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = vptree.nearest(spark, df, df.where("vec_id % 40 = 0"), shard_rows=2000).collect()
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    assert all(r.score == d[r.query_id][r.vec_id] for r in got)


@pytest.mark.parametrize("dims,share", [(3, 0.3), (6, 0.6)])
def test_rows_scanned(dims, share):
    x = low_rank(6000, dims)
    tree, asks = vptree.Tree(np.arange(6000), x), np.arange(0, 6000, 40)
    tree.search(x[asks], asks, 10, vptree.FACTOR)
    pruned = tree.scanned / (len(asks) * len(x))
    tree.scanned = 0
    ids, dist = tree.search(x[asks], asks, 10, 1.0)
    assert pruned <= share and tree.scanned / (len(asks) * len(x)) > pruned
    for a, i, d in zip(asks, ids, dist, strict=True):
        every = np.sqrt(((x - x[a]) ** 2).sum(1))
        every[a] = np.inf
        assert np.allclose(np.sort(every)[:10], d) and a not in i


def test_equal_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [0.0, 1.0], 3), (3, [0.5, 0.5], 4), (3, [0.4, 0.5], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in vptree.nearest(spark, df, df.where("vec_id = 1")).collect())
    assert got == [(1, 1, 3), (1, 2, 2)]
