"""Runs of one word, of different lengths, beside one passage."""

import random

from facetmill.llm import suffixes


def test_runs_of_different_lengths(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(30):
        x, rest = f"x{k}", [f"w{rng.randrange(10**9)}" for _ in range(35)]
        for i, n in enumerate((60, 20)):
            after, before = 4 * k + i, 4 * k + 2 + i
            rows.append((after, " ".join([x] * n + rest)))
            want[after] = f"{n - 20}-{n + 35}"
            rows.append((before, " ".join([w + "b" for w in rest] + [x + "b"] * n)))
            want[before] = "0-55"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.repeated for r in suffixes.repeats(spark, docs).collect()}
    assert got == want
