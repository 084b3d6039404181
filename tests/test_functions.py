"""Golden vectors of the text functions, and properties of codec, tree and hull."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetmill.functions import codec
from facetmill.functions import text as T
from facetmill.functions import vectors as V
from facetmill.operators import records, tree
from facetmill.operators.hull import outline


def value(spark, text, f):
    r = spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first().y
    return r


@pytest.mark.parametrize("text,want", [("a!.", "a"), ("a.!", "a."), (" b? ", "b"), ("", ""), (None, None), ("a.?!", "a.?"), ("a!?.", "a")])
def test_strip_punctuation(spark, text, want):
    assert value(spark, text, T.strip_punctuation) == want


@pytest.mark.parametrize("text,want", [("1. hi", "hi"), ("144. wow", "wow"), ("12 hi", "12 hi"), (". x", "x")])
def test_strip_number(spark, text, want):
    assert value(spark, text, T.strip_number) == want


@pytest.mark.parametrize("text,found,want", [("x <Answer> y </ANSWER> z", True, "y"), ("y </answer> z", False, "y"), ("none", False, "none"), ("<answer> open", False, "open")])
def test_tag_value(spark, text, found, want):
    assert tuple(value(spark, text, lambda c: T.tag_value(c, "answer"))) == (found, want)


def test_numbered_list(spark):
    text = "<answer>\n1. blah\n2. blahhh\n3. wow\n</answer>"
    assert value(spark, text, T.numbered_list) == ["blah", "blahhh", "wow"]
    assert value(spark, "1. a\n2. b", T.numbered_list) == []
    assert value(spark, "1. a\n2. b", lambda c: T.numbered_list(c, keep_open=True)) == ["a"]


def test_tags_and_pairs(spark):
    assert value(spark, "name</name> more", T.clean_trailing_tags) == "name"
    assert tuple(value(spark, "<summary> s. </summary> <name> n. </name>", T.summary_name)) == ("s", "n")
    assert tuple(value(spark, "nothing", T.summary_name)) == (T.NO_SUMMARY, T.NO_NAME)
    assert value(spark, "90061", T.duration) == "1 day  1 hour 1 minute 1 second "


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.normalised(F.col("a")), V.normalised(F.col("b")), V.cosine_distance(F.col("a"), F.col("b")), V.euclidean(F.col("a"), F.col("b"))).first()
    assert r[0] == pytest.approx([0.6, 0.8]) and list(r[1]) == [0.0, 0.0] and r[2] == 1.0 and r[3] == 5.0


def test_dedup_and_merge(spark):
    rows = spark.createDataFrame(list(enumerate("abacb")), "id long, k string")
    assert [r.id for r in records.dedup(rows, F.col("k"), "id").orderBy("id").collect()] == [0, 1, 3]
    m = {r.old: r.position for r in records.dedup_mapping(rows, F.col("k"), "id").collect()}
    assert m == {0: 0, 1: 1, 2: 0, 3: 2, 4: 1}
    merged = records.merge_sources(spark.createDataFrame([("x", [1, 2]), ("y", [3]), ("x", [2, 4])], "name string, sources array<long>"))
    assert [(r.name, r.sources) for r in merged.collect()] == [("x", [1, 2, 4]), ("y", [3])]
    values = spark.createDataFrame([("g", v) for v in "bbaac"], "g string, v string")
    assert records.most_common(values, "g", "v").first()[1:] == ("a", 2)


def test_truncation(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a " * 50), (1, 1, "assistant", "b " * 5), (1, 2, "user", "c " * 50), (2, 0, "user", "x " * 99), (3, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    got = {r.record_id: r.text for r in records.truncated(turns, 60).collect()}
    assert got[1].startswith("user:\na a") and "b b" in got[1] and "c c" not in got[1]
    assert got[2] == "" and got[3] == "user:\nhi"
    assert len(records.truncated(turns, -1).where("record_id = 2").first().text) > 100


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_codec_round_trip(text):
    assert codec.decode_path(codec.encode_path(text)) == text


def test_codec_shortens():
    long = "f0,f0.12,f0.12.3,f0.12.3.44,f0.12.3.44$c,c!f0.12.3.44!5" * 3
    assert len(codec.encode_path(long)) < len(long) * 0.7


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 60))
def test_packing_covers_all(seed, n):
    rng = random.Random(seed)
    nodes = [(i, None if i == 0 else rng.randrange(i), rng.randint(10, 400)) for i in range(n)]
    files = tree.packed(nodes, 1_000)
    assert sorted(files) == list(range(n))


def test_outline():
    square = [(0, 0, 1), (0, 2, 2), (2, 0, 3), (2, 2, 4), (1, 1, 5), (1, 0, 6)]
    assert sorted(outline(square)) == [1, 2, 3, 4]
    assert outline([]) == [] and outline([(1, 1, 9)]) == [9]


def test_tree(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, None)], "node long, parent long")
    leaves = spark.createDataFrame([(4, 10), (3, 2)], "node long, n long")
    n = {r.node: r.n for r in tree.rolled_up(nodes, leaves).collect()}
    assert n == {1: 12, 2: 10, 3: 2, 4: 10, 5: 0}
    paths = {r.node: r.path for r in tree.paths(nodes, tree.rolled_up(nodes, leaves)).collect()}
    assert paths == {1: "f0.0", 5: "f0.1", 2: "f0.0.0", 3: "f0.0.1", 4: "f0.0.0.0"}
