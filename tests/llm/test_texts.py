"""Toxicity, URLs, mixing, shards, tokens, personal data and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetmill.llm import mixing, pii, sentencepiece, shards, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "no id here", "en", "s", 1)]


def test_toxicity_on_held_out_rows(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.op3_toxicity(spark, sf)
    assert rows.count() == 200
    got = rows.join(labels, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert not any(r.predicted for r in got if r.toxic == 0)
    assert sum(r.predicted for r in got if r.toxic == 1) >= 0.4 * sum(r.toxic for r in got)  # a few rows of three languages


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you stupid worthless clown", "en", "s", 1), (2, "a calm text", "en", "s", 1), (2, "a calm text", "en", "s", 1), *EMPTY], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = toxicity.keep_clean(spark, docs, none)
    assert kept.columns == docs.columns and kept.count() == 5 and kept.where("doc_id = 1").count() == 0
    assert toxicity.keep_clean(spark, docs.limit(0), none).count() == 0


def test_label_model_and_correlations():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    good = [np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.02) for _ in range(3)]
    copy = [rng.random(4000) < 0.3] * 4  # one uninformed voter four times
    votes = np.stack([*good, *copy], axis=1).astype(np.float32)
    gold = np.where(rng.random(4000) < 0.9, y, ~y).astype(int)
    q = toxicity.label_model(votes, gold, (votes.T @ votes).astype(float), 4000)
    assert ((q > 0.5) == y).mean() > 0.93


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls(spark, sf):
    extra = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.ORG/es/1", "http://example.org/en/1x?q#f", "x://com/fr/", "x://acom/fr/", "x://a.com?/fr/", "x://org", "http://é.org/ü", "a://b://c.org/x", "x://" + "a" * 5000 + ".net/"]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    pages = pages.union(spark.createDataFrame([(1000 + i, u) for i, u in enumerate(extra)], "page_id long, url string"))
    url = {r.page_id: r.url for r in pages.collect()}
    for r in urls.judged(pages).collect():
        host, path = host_path(url[r.page_id])
        fit = [(len(h + p), h + p, said) for said, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == max(fit)[1:] if fit else r.rule is None and r.verdict in ("allow", "block")


def test_markov_is_a_distribution_and_tells_sites_apart(spark):
    rows = [(f"good{i % 7}.net/news/{i}", True) for i in range(200)] + [(f"casino{i % 7}.net/win/{i}", False) for i in range(200)]
    models = urls.train(spark.createDataFrame(rows, "url string, accepted boolean"))
    after = models[True].after["/ne"]
    assert after["n"] == sum(v for k, v in after.items() if k not in ("n", "kinds"))
    assert urls.ratio(models, "good9.net/news/5") > 0 > urls.ratio(models, "casino9.net/win/5") and urls.ratio(models, None) == 0


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 40)), "en", "abc"[min(2, i % 5)], 1) for i in range(400)] + [(i, "w " * 9, "en", "d", 1) for i in range(400, 404)] + EMPTY
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(spark, docs).collect()
    size = {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    target, free, left = {}, set(size), sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
        free -= over
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
    for s in size:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 40
    again = {(r.doc_id, r.taken) for r in mixing.mix(spark, docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    mixed = mixing.apply_mix(spark, docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(spark, docs.limit(0)).count() == 0


def test_mixing_sql(spark, duck, sf):
    want = sorted(duck.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE_SQL})").fetchall())
    assert sorted(tuple(r) for r in mixing.op6_mixing(spark, sf).collect()) == want


def test_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_metadata", F.lit("clash")).drop("_metadata")
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target=200_000, small=4_000, fan_in=3)
    assert store.append(docs.repartition(6), arrival_rows=10) == 1
    before = store.manifest()
    assert len(before) >= 18
    store.compact(keep=2)
    after = store.manifest()
    assert len(after) < len(before) and store.read().count() == 200
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    assert store.plan(after) is None
    with pytest.raises(shards.Conflict):
        store.commit(store.version(), [])
    store.append(docs.limit(0))
    assert store.read().count() == 200
    placed = shards.op7_sharding(spark, sf)
    assert placed.count() == 200 and placed.select("doc_id").distinct().count() == 200


TOKENS = sentencepiece.tokenizer()


def best_score(tokens, text):
    """The greatest score of any segmentation, by trying all."""
    pieces = {p: s for p, s, t in tokens.pieces if t == sentencepiece.NORMAL}
    best = [0.0] + [-np.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            s = pieces.get(text[i:j], tokens.unknown if j == i + 1 else -np.inf)
            best[j] = max(best[j], best[i] + s)
    return best[-1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abthe ing \n\t▁é漢😀", max_size=30))
def test_tokens(text):
    ids = TOKENS.encode(text)
    assert TOKENS.decode(ids) == text
    if text and "▁" not in text:
        score = 0.0
        pieces = [TOKENS.pieces[i] for i in ids]
        raw = b""
        for p, s, t in pieces:
            if t == sentencepiece.BYTE:
                raw += TOKENS.out[TOKENS.byte_id[int(p[3:5], 16)]]
            else:
                score += s
        assert score + len(raw.decode()) * TOKENS.unknown == pytest.approx(best_score(TOKENS, "▁" + text.replace(" ", "▁")))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abthe  ing \n▁é漢😀", max_size=40)), max_size=8))
def test_tokens_of_batches(texts):
    ids = TOKENS.encode_all(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [None if t is None else TOKENS.encode(t) for t in texts]
    assert TOKENS.decode_all(ids).to_pylist() == texts


def test_tokens_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sentencepiece.with_tokens(docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 3000)], "doc_id long, text string")))
    assert rows.where("exact = false").count() == 0 and rows.where("doc_id = -1 AND ids IS NULL").count() == 1


def plain_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"a_.@-+012 (é٣\n", "1.2.3.4", "4111 1111 1111 1111", "+1 (234) 567-8901", "x@y.z", "999.1.1.1"]), max_size=25))
def test_base_spans(parts):
    assert pii.base_spans("".join(parts)) == plain_spans("".join(parts))


def test_long_digits_are_linear():
    assert pii.base_spans("1" * 200_000 + ".") == []


def test_telling_terms(spark):
    rng = np.random.default_rng(4)
    noise = lambda: " ".join(f"w{x}" for x in rng.integers(0, 30, 12))
    texts = [f"{noise()} Zorblax wrote from ann@mail.example.org {noise()}" for _ in range(6)] + [noise() for _ in range(60)] + ["nothing private here", None, ""]
    texts += [texts[0]] * 50  # copies count once
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in pii.with_spans(spark, docs, clean=True).select("doc_id", "_pii.*").collect()}
    for i in range(6):
        kinds = Counter(x.split(":")[0] for x in got[i].spans.split(","))
        assert got[i].n_email == 1 and kinds["email"] == 1 and kinds["term"] >= 1
        assert "[EMAIL]" in got[i].clean and "Zorblax" not in got[i].clean and "w1" in got[i].clean
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(plain_spans(texts[i])).encode()).hexdigest()
    assert all(got[i].spans == "" for i in range(6, 69)) and got[67].clean is None
    few = pii.BROADCAST_ROWS
    try:
        pii.BROADCAST_ROWS = 0  # the way without a broadcast gives the same
        other = {r.doc_id: r for r in pii.with_spans(spark, docs, clean=True).select("doc_id", "_pii.*").collect()}
    finally:
        pii.BROADCAST_ROWS = few
    assert {i: (r.spans, r.clean) for i, r in other.items()} == {i: (r.spans, r.clean) for i, r in got.items()}
    out = pii.sanitised(spark, docs)
    assert out.columns == docs.columns and out.where("n_chars <> length(text)").count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    toxic = {r.doc_id for r in toxicity.op3_toxicity(spark, sf).where("predicted = 1").collect()}
    assert rows and all(r.exact for r in rows)
    assert not toxic & {r.doc_id for r in rows} and {r.doc_id for r in rows} <= docs.keys()
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert not any(mail.search(TOKENS.decode(r.ids)) for r in rows)
