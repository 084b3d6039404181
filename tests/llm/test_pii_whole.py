"""Telling terms over whole texts, against plain counts."""

import math
import random
import re
from collections import Counter

from facetmill.llm import pii


def corpus():
    rng = random.Random(3)
    noise = lambda n: " ".join(f"word{rng.randrange(40)}" for _ in range(n))
    texts = [f"{noise(8)} ann@mail.example.org {noise(12)} Quibbler {noise(3)}" for _ in range(9)]  # ten words apart
    texts += [f"{noise(9)} Quibbler {noise(9)}", *[noise(20) for _ in range(300)]]
    return texts + [texts[0], None, ""]


def shares(texts):
    n, n_term, n_entity = Counter(), Counter(), Counter()
    texts = {t for t in texts if t}
    for t in texts:
        entities, terms = set(re.findall(r"\S+@\S+", t)), {w.lower() for w in re.findall(r"\w+", re.sub(r"\S+@\S+", "", t))}
        n_term.update(terms), n_entity.update(entities)
        n.update((e, w) for e in entities for w in terms)
    share = lambda e, w: math.log(n[e, w] * len(texts) / n_term[w] / n_entity[e]) / math.log(len(texts) / n_entity[e])
    return {w: s for (e, w), k in n.items() if k >= pii.SUPPORT and (s := share(e, w)) >= pii.DISCLOSURE}


def test_telling_terms_anywhere(spark, monkeypatch):
    texts = corpus()
    want = shares(texts)
    assert set(want) == {"quibbler"} and want["quibbler"] < 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (pii.BROADCAST_ROWS, 0):
        monkeypatch.setattr(pii, "BROADCAST_ROWS", rows)
        got = {r.doc_id: r for r in pii.with_spans(spark, docs, clean=True).select("doc_id", "_pii.*").collect()}
        for i, t in enumerate(texts):
            assert ("term:" in got[i].spans) == ("Quibbler" in (t or "")), i
        assert got[9].clean == texts[9].replace("Quibbler", "[TERM]")  # a text without the entity
