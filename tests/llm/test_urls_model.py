"""The character models against a plain one, and what they add up to."""

import math
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetmill.llm import urls


def plain_counts(texts):
    after = defaultdict(Counter)
    for t in texts:
        s = urls.START + t + urls.END
        for i in range(1, len(s)):
            for k in range(min(urls.ORDER, i) + 1):
                after[s[i - k : i]][s[i]] += 1
    return {c: n for c, n in after.items() if sum(n.values()) >= urls.CONTEXT_LEAST}


def probability(after, context, char):
    """Witten-Bell interpolation, from the shortest context to the longest kept without a gap."""
    p = 1 / urls.ALPHABET
    for k in range(len(context) + 1):
        n = after.get(context[len(context) - k :])
        if n is None:
            break
        p = (n[char] + len(n) * p) / (sum(n.values()) + len(n))
    return p


def plain_log(after, text):
    s = urls.START + text + urls.END
    return sum(math.log(probability(after, s[max(0, i - urls.ORDER) : i], s[i])) for i in range(1, len(s)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="n=kidsa/.é", max_size=25), min_size=1, max_size=30))
def test_mass_is_one_after_every_context(texts):
    """Of the plain model, which the next test holds the operator's against."""
    after = plain_counts(texts)
    seen = {x for t in texts for x in t} | {urls.END}
    for context in {"", "n", "k", "=", "nn", *after}:
        context = context[-urls.ORDER :]
        mass = sum(probability(after, context, c) for c in seen) + (urls.ALPHABET - len(seen)) * probability(after, context, "\u4e00")
        assert mass == pytest.approx(1, abs=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="nkab/.", max_size=20), min_size=3, max_size=20), st.text(alphabet="nkabz=é", max_size=12))
def test_log_equals_the_plain_model(texts, text):
    after = plain_counts(texts)
    model = urls.Markov({c: {"n": sum(n.values()), "kinds": len(n)} | {"=" + x: k for x, k in n.items()} for c, n in after.items()})
    assert model.log(text) == pytest.approx(plain_log(after, text), abs=1e-9)


def plain_threshold(scored):
    yes, no = ([math.floor(s / urls.BIN) for a, s in scored if a == x] for x in (True, False))
    if not yes or not no:
        return 0.0
    best = (-1.0, 0.0, 0)
    for c in {0, *yes, *no, *(b + 1 for b in yes + no)}:
        hit = (sum(b >= c for b in yes) / len(yes) + sum(b < c for b in no) / len(no)) / 2
        best = max(best, (round(hit, 9), -abs(c), c))
    return best[2] * urls.BIN


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_verdicts_equal_the_plain_model(spark, size):
    pages = spark.read.parquet(f"/root/testdata/{size}/pages.parquet").select("page_id", "url")
    got = urls.judged(pages).collect()
    url = {r.page_id: r.url for r in pages.collect()}
    text = {r.page_id: r.host + url[r.page_id].split("://", 1)[1][len(r.host) :] for r in got if "://" in (url[r.page_id] or "")}
    apart = {r.t: r.apart for r in spark.createDataFrame([(t,) for t in set(text.values())], "t string").select("t", (F.pmod(F.xxhash64("t"), F.lit(5)) == 0).alias("apart")).collect()}
    examples = [(r.verdict == "allow", text[r.page_id]) for r in got if r.rule is not None]
    models = {x: plain_counts([t for a, t in examples if a == x and not apart[t]]) for x in (True, False)}
    ratio = lambda t: (plain_log(models[True], t) - plain_log(models[False], t)) / (len(t) + 1) if all(models.values()) else 0.0
    cut = plain_threshold([(a, ratio(t)) for a, t in examples if apart[t]])
    judged = 0
    for r in got:
        if r.rule is None and r.page_id in text:
            s = ratio(text[r.page_id])
            assert r.score == pytest.approx(s, abs=1e-9)
            if abs(s - cut) > 1e-9:
                judged += 1
                assert r.verdict == ("allow" if s >= cut else "block")
    assert judged


def test_empty_table_and_repeated_rows(spark):
    rows = [(1, "http://a.net/x", 3, "r"), (1, "http://a.net/x", 3, "r"), (2, None, 3, "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, score int, rule string")
    got = urls.judged(df).collect()
    assert len(got) == 3 and len({(r.page_id, r.verdict, r.host) for r in got}) == 2
    assert urls.judged(df.limit(0)).count() == 0
