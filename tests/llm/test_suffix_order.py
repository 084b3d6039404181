"""Hot grams, repeated rows, and the pieces of the suffix comparison against plain loops."""

import random

import numpy as np
import pyarrow as pa

from facetmill.llm import suffixes
from facetmill.llm.bitmap import bitmap, hit


def test_one_passage_in_many_documents(spark):
    """50,000 copies of a passage, each in words of its own, take the aggregated way."""
    passage = " ".join(f"p{i}" for i in range(55))
    rows = spark.range(50_000).selectExpr("id AS doc_id", f"concat('a', id, ' b', id, ' {passage} c', id, ' d', id) AS text")
    got = suffixes.repeats(spark, rows).groupBy("repeated", "n_words").count().collect()
    assert [(r.repeated, r.n_words, r["count"]) for r in got] == [("2-57", 59, 50_000)]
    first = suffixes.repeats(spark, rows).where("extra = ''").collect()
    assert [r.doc_id for r in first] == [0]


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text)] * 300 + [(2, "x y"), (None, None), (3, "")], "doc_id long, text string")
    assert {(r.doc_id, r.repeated, r.partner) for r in suffixes.repeats(spark, docs).collect()} == {(1, "", None), (2, "", None), (None, "", None), (3, "", None)}
    both = docs.union(spark.createDataFrame([(None, text)], "doc_id long, text string"))
    assert {(r.repeated, r.extra) for r in suffixes.repeats(spark, both).where("n_words = 80").collect()} == {("0-80", ""), ("0-80", "0-80")}
    assert suffixes.repeats(spark, docs.limit(0)).count() == 0


def test_long_text_and_clashing_columns(spark):
    rng = random.Random(4)
    long = " ".join(f"v{rng.randrange(10**9)}" for _ in range(120_000))
    part = " ".join(long.split(" ")[70_000:70_060])
    docs = spark.createDataFrame([(1, long, 5, "k"), (2, part, 6, "k")], "doc_id long, text string, h int, key string")
    got = {r.doc_id: r.repeated for r in suffixes.repeats(spark, docs).collect()}
    assert got == {1: "70000-70060", 2: "0-60"}


def test_common_and_lows():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2, (2, 200, 9)).astype(np.uint64)
    most = rng.integers(0, 10, 200)
    for i, n in enumerate(suffixes._common(x, y, most)):
        want = next((k for k in range(9) if x[i, k] != y[i, k]), 9)
        assert n == min(want, most[i])
    a = rng.integers(0, 99, 77)
    i = rng.integers(0, 76, 500)
    j = i + 1 + (rng.random(500) * (77 - i - 1)).astype(int)
    assert (suffixes._lows(a)(i, j) == [a[p:q].min() for p, q in zip(i, j, strict=True)]).all()


def test_matrix_of_slices():
    w = np.arange(1, 16, dtype=np.uint64)
    column = suffixes._binary([(w, np.array([3, 0, 5, 7]))])
    got = suffixes._matrix(pa.chunked_array([column.slice(1, 3)]), 8)
    assert got.tolist() == [[0] * 8, [4, 5, 6, 7, 8, 0, 0, 0], [9, 10, 11, 12, 13, 14, 15, 0]]


def test_bitmap(spark):
    h = [int(x) for x in np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000)]
    bits = bitmap(spark.createDataFrame([(x,) for x in h], "h long"), "h", len(h))
    assert hit(bits, np.array(h).view(np.uint64)).all()
    other = np.random.default_rng(3).integers(0, 2**63 - 1, 5000).astype(np.uint64)
    assert hit(bits, other).mean() < 0.2
    assert bitmap(spark.range(1), "id", 1 << 40) is None
