"""Url models of any size, and scores by a join."""

import random

import pytest

from facetmill.llm import urls


def pages(spark, n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9))
    hosts = [word() for _ in range(n // 6)]
    urls_ = [f"https://{rng.choice(hosts)}.{rng.choice(('org/', 'com/fr/', 'com/de/', 'net/'))}{word()}" for _ in range(n)]
    return spark.createDataFrame([*enumerate(urls_), (n, None), (n + 1, "no scheme"), (n + 2, urls_[0])], "page_id long, url string").repartition(4)


def test_models_keep_every_context(spark):
    df = pages(spark, 9000).where("url IS NOT NULL").selectExpr("url", "true AS accepted")
    after = urls.train(df)[True].after
    assert sum(len(v) - 2 for v in after.values()) > 60_000
    assert all(sum(n for c, n in v.items() if c not in ("n", "kinds")) == v["n"] and len(v) - 2 == v["kinds"] for v in after.values())


def test_joined_scores(spark, monkeypatch):
    df = pages(spark, 300)
    want = {r.page_id: r for r in urls.judged(df).collect()}
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 10)
    got = {r.page_id: r for r in urls.judged(df).collect()}
    assert got.keys() == want.keys() and any(r.score for r in want.values())
    for k, r in want.items():
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (r.host, r.path, r.rule, r.verdict)
        assert got[k].score == (None if r.score is None else pytest.approx(r.score, abs=1e-9))
