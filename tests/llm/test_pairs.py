"""Nearest neighbours, near copies, repeated passages and image copies against brute force."""

import random
import re

import numpy as np
import pytest

from facetmill.llm import jaccard, media, suffixes, vptree
from facetmill.llm.wordhash import shingle_set, text_words

import pyarrow as pa

DOCS = "doc_id long, text string, _key string, n long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["W%d" % i for i in range(60)] + ["é", "漢", "a.b"]
    texts = []
    for i in range(n):
        k = rng.random()
        if texts and k < 0.5:
            w = (rng.choice(texts) or "").split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "\t "]).join(w))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 30, 60, 90]))))
    return [(i, t, "x", i) for i, t in enumerate(texts)] + [(n, None, "x", 0), (n + 1, "", "x", 0), (n + 2, " \t\n", "x", 0), (n + 3, "Lone", "x", 0), (n + 4, "lone ", "x", 0)]


def links(docs, k, percent):
    sets = {}
    for i, t, *_ in docs:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    component = {i: i for i in sets}

    def root(x):
        while component[x] != x:
            x = component[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                component[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("seed,k,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_jaccard(spark, seed, k, percent):
    docs = corpus(seed, 150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark, spark.createDataFrame(docs, DOCS), k, percent).collect()}
    assert got == links(docs, k, percent)


def test_jaccard_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    docs = corpus(5, 120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark, spark.createDataFrame(docs, DOCS), 4, 85).collect()}
    assert got == links(docs, 4, 85)


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(3, text), (1, text + " more"), (2, "other words entirely here now"), (2, "other words entirely here now"), (None, ""), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in jaccard.one_of_each(spark, docs).collect())
    assert got == [(False, 1), (False, 2), (False, 9), (True, 0)]
    assert jaccard.jaccard_components(spark, docs.limit(0)).count() == 0


def test_word_hashes_cut_anywhere():
    text = "Ab cd\u00e9\x0bX " * 200_000 + "tail" * 400_000
    got = [len(w) for w in text_words(pa.array([text, None, "", "a A"]))]
    assert got == [600_001, 0, 0, 2]
    a, b = list(text_words(pa.array(["Hello World", "hello\nworld"])))
    assert (a == b).all() and len(shingle_set(a, 5)) == 1


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(57)]
    texts = []
    for i in range(40):
        own = [f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 120))]
        at = rng.randint(0, len(own))
        cut = rng.choice([0, 5, 7, 8, 30])
        texts.append(" ".join(own[:at] + (passage[: 57 - cut] if i % 3 else []) + own[at:]))
    docs = [(i, t, "k", 0) for i, t in enumerate([*texts, None, "", "oi " * 300, "oi " * 200, texts[1]])]
    got = {r.doc_id: r for r in suffixes.repeats(spark, spark.createDataFrame(docs, DOCS)).collect()}
    own = {}
    for i, t, *_ in docs:
        w = words(t)
        for j in range(len(w) - 49):
            own.setdefault(tuple(w[j : j + 50]), set()).add(i)
    for i, t, *_ in docs:
        w = words(t)
        for field, test in (("repeated", lambda s: len(s) > 1), ("extra", lambda s, i=i: len(s) > 1 and min(s) != i)):
            want, have = [False] * len(w), [False] * len(w)
            for j in range(len(w) - 49):
                if test(own[tuple(w[j : j + 50])]):
                    want[j : j + 50] = [True] * 50
            for x in filter(None, got[i][field].split(",")):
                a, b = map(int, x.split("-"))
                have[a:b] = [True] * (b - a)
            assert have == want, (i, field)


def nearest(rows, asks, k):
    ok = {i: v for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = set()
    for q in asks:
        if q in ok:
            d = sorted((float(np.sqrt(((np.array(v) - np.array(ok[q])) ** 2).sum())), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out |= {(q, r + 1, i, round(x, 12)) for r, (x, i) in enumerate(d[:k])}
    return out


def test_exact_search_by_factor_one(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(700)]
    rows += [(i, [1.0] * 8) for i in range(700, 1000)]  # a common vector: ties go to smaller ids
    rows += [(1001, None), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [None] * 8), (1005, [1.0, 2.0]), (None, [1.0] * 8), (1006, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in vptree.nearest(spark, df, df.where("vec_id % 50 = 0"), 10, factor=1.0, shard_rows=300).collect()}
    assert got == nearest(rows, range(0, 1001, 50), 10)
    assert vptree.nearest(spark, df.limit(0), df.limit(0)).count() == 0


def test_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = nearest([(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()], [r.vec_id for r in df.where("vec_id % 100 = 0").collect()], 10)
    got = {(r.query_id, r.vec_id) for r in vptree.op1_nearest(spark, sf).collect()}
    assert len(got & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)


def test_image_copies(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(8):
        a = media.resize(rng.uniform(0, 255, (1, 14, 14)), 96, 96)[0]
        for k, x in enumerate((a, a[8:88, 4:90], np.clip(a * 0.8 + 20, 0, 255), np.rot90(a), a + rng.normal(0, 4, a.shape), a)):
            rows.append((i * 10 + k, x.shape[1], x.shape[0], bytearray(np.clip(np.rint(x), 0, 255).astype(np.uint8).tobytes())))
    rows += [(990, 3, 3, None), (991, 2, 2, bytearray(b"xyz")), (992, 32, 32, bytearray(1024)), (993, 32, 32, bytearray(1024))]
    got = {r.media_id: r.class_id for r in media.copies(spark, spark.createDataFrame(rows, "media_id long, width int, height int, pixels binary")).collect()}
    assert all(got[i] == i // 10 * 10 for i in got if i < 990)
    assert got[990] == 990 and got[991] == 991 and got[993] == 992
