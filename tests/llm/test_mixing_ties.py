"""Mixing with repeated rows, short texts and columns of any names."""

from collections import Counter

from facetmill.llm import mixing

DOCS = "doc_id long, text string, source string"


def test_repeated_rows_meet_the_target(spark):
    rows = [(None, "w " * 40, "a")] * 300 + [(7, "v " * 9, "b")] * 500 + [(i, "u " * 11, "c") for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = mixing.mix(spark, docs).collect()
    assert len(got) == len(rows)
    for s, size in (("a", 40), ("b", 9), ("c", 11)):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= size / 2
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    again = mixing.mix(spark, docs.repartition(3)).collect()
    assert Counter((r.source, r.doc_id, r.taken) for r in again) == Counter((r.source, r.doc_id, r.taken) for r in got)
    mixed = mixing.apply_mix(spark, docs)
    assert Counter(r.source for r in mixed.collect()) == {s: sum(r.copies for r in got if r.source == s) for s in "abc"}


def test_buckets_of_short_texts_are_small(spark):
    docs = spark.createDataFrame([(i, "a few short words stand in this text", "s") for i in range(20_000)], DOCS)
    n = Counter(r.bucket for r in mixing.keyed(docs).select("bucket").collect())
    assert max(n.values()) <= 200


def test_clashing_columns(spark):
    names = "doc_id long, text string, source string, copies int, cut int, size int, key int, bucket int, row int, n int, all int, target int, _source int"
    docs = spark.createDataFrame([(i, "some words " * i, "ab"[i % 2], *range(10)) for i in range(40)], names)
    mixed = mixing.apply_mix(spark, docs)
    assert mixed.columns == docs.columns
    assert {tuple(r)[3:] for r in mixed.collect()} == {tuple(range(10))}
    assert mixing.mix(spark, docs).count() == 40 and mixing.apply_mix(spark, docs.limit(0)).count() == 0
