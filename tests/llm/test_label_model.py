"""The label model and the regression against plain loops, and held-out accuracy."""

import math

import numpy as np
import pytest

from facetmill.llm import toxicity


def plain_em(votes, gold, rounds):
    """EM of independent voters, one number at a time."""
    n, v = len(votes), len(votes[0])
    q = [0.9 if g else 0.1 for g in gold]
    for _ in range(rounds):
        w = [[1 - x for x in q], q]
        prior = [(sum(w[y]) + 1) / (n + 2) for y in (0, 1)]
        right = [(sum(x for x, g in zip(w[y], gold, strict=True) if g == y) + 9) / (sum(w[y]) + 10) for y in (0, 1)]
        fired = [[sum(w[y][i] * votes[i][j] for i in range(n)) for j in range(v)] for y in (0, 1)]
        alone = [[(fired[y][j] + 0.05) / (sum(w[y]) + 1) for j in range(v)] for y in (0, 1)]
        rate = [[min(max((fired[y][j] + alone[y][j]) / (sum(w[y]) + 1), 1e-6), 1 - 1e-6) for j in range(v)] for y in (0, 1)]
        for i in range(n):
            p = []
            for y in (0, 1):
                x = prior[y] * (right[y] if gold[i] == y else 1 - right[y])
                for j in range(v):
                    x *= rate[y][j] if votes[i][j] else 1 - rate[y][j]
                p.append(x)
            q[i] = p[1] / (p[0] + p[1])
    return q


def test_posterior_equals_plain_em():
    rng = np.random.default_rng(5)
    y = rng.random(300) < 0.3
    votes = np.stack([np.where(y, rng.random(300) < a, rng.random(300) < b) for a, b in ((0.8, 0.1), (0.5, 0.05), (0.3, 0.3))], axis=1).astype(np.uint8)
    gold = np.where(rng.random(300) < 0.85, y, ~y).astype(int)
    got = toxicity.label_model(votes, gold, np.zeros((3, 3)), 0, rounds=6)
    assert got == pytest.approx(plain_em(votes.tolist(), gold.tolist(), 6), abs=1e-9)


def test_blocks_and_weights_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    votes = (rng.random((90, 7)) < 0.3).astype(np.uint8)
    gold, times = (rng.random(90) < 0.3).astype(int), rng.integers(1, 4, 90)
    joint = (votes.T.astype(float) @ votes) * 3
    whole = toxicity.label_model(np.repeat(votes, times, axis=0), np.repeat(gold, times), joint, 500)
    at = np.cumsum(times) - 1
    fit = toxicity.logistic(np.repeat(votes, times, axis=0), whole, np.ones(len(whole)))
    monkeypatch.setattr(toxicity, "ROW_BLOCK", 13)
    few = toxicity.label_model(votes, gold, joint, 500, weight=times.astype(float))
    assert few == pytest.approx(whole[at], abs=1e-9)
    assert toxicity.logistic(votes, few, times.astype(float)) == pytest.approx(fit, abs=1e-6)


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(7)
    votes = (rng.random((200, 4)) < 0.4).astype(np.uint8)
    target, weight = rng.random(200), rng.random(200) + 0.5
    w = toxicity.logistic(votes, target, weight)

    def loss(w):
        z = toxicity._features(votes.astype(float)) @ w
        return sum(k * (math.log1p(math.exp(a)) - t * a) for k, a, t in zip(weight, z, target, strict=True)) + 0.5 * (w[:-1] ** 2).sum() + 0.5e-6 * w[-1] ** 2

    for i in range(len(w)):
        for d in (-1e-3, 1e-3):
            assert loss(w) <= loss(w + d * np.eye(len(w))[i])


def test_held_out_accuracy_at_size(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op3_toxicity(spark, d).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n.get((1, 1), 0) >= 0.8 * (n.get((1, 1), 0) + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.005 * n[0, 0]


def test_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "calm words " * 60_000, 0.5, 1), (2, None, None, 2), (2, "", 0.1, 3)], "doc_id long, text string, score double, _score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    kept = toxicity.keep_clean(spark, docs, none)
    assert kept.columns == docs.columns and sorted(r._score for r in kept.collect()) == [1, 2, 3]
