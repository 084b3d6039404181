"""Components, clusters, models, stages, publishing and the stream of new records."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill.operators import graph, providers, similarity, tree
from facetmill.plans import insight
from facetmill.sources import publish
from facetmill.sources.scratch import Scratch
from facetmill.sources.stages import Stages
from facetmill.streaming.assign import assigned_stream


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 9), (5, 5), (9, 7), (7, 3)]
    edges = spark.createDataFrame(chain, "a long, b long").repartition(4)
    with Scratch(spark, "t") as s:
        got = {r.node: r.component for r in graph.connected_components(edges, s).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 7: 3, 9: 3}


def test_components_of_nothing(spark):
    with Scratch(spark, "t") as s:
        assert graph.connected_components(spark.createDataFrame([], "a long, b long"), s).count() == 0


def test_kmeans_finds_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(8)[i % 4] + rng.normal(0, 0.05, 8)).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "record_id long, vec array<double>")
    got = similarity.assign(df, similarity.spherical_kmeans(df, 4, "record_id", "vec"), "vec").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.cluster, set()).add(r.record_id % 4)
    assert all(len(g) == 1 for g in groups.values())


def test_generation_asks_once(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, prompt string")
    cache = spark.createDataFrame([], "prompt_key string, model string, output string")
    out = providers.generated(prompts, providers.FrequentWords(), cache=cache).collect()
    assert len(out) == 3 and len({r.output for r in out if r.prompt == "a"}) == 1
    known = spark.range(1).select(F.sha2(F.lit("b"), 256).alias("prompt_key"), F.lit("frequent-words-1").alias("model"), F.lit("kept").alias("output"))
    assert {r.output for r in providers.generated(prompts, providers.FrequentWords(), cache=known).collect() if r.prompt == "b"} == {"kept"}


def test_insight_and_publishing(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120").select(F.col("doc_id").alias("record_id"), F.substring("text", 1, 400).alias("text"))
    got = insight.run(spark, docs, [insight.SUMMARY], insight.Config().with_options(name_samples=2))
    n = got["records"].count()
    clusters = got["clusters"].collect()
    assert sum(c.n for c in clusters if c.level == 0) == n
    assert sum(c.n for c in clusters if c.parent_id is None) == n
    assert got["members"].groupBy("record_id").count().where("count > 1").count() == 0
    assert got["points"].count() == n
    text = got["records"].select("record_id", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("turns"))
    values = got["values"].select("record_id", F.array(F.struct(F.lit("Summary").alias("facet"), "value")).alias("facets"), "value")
    rows = publish.record_json(text.join(values, "record_id").withColumn("url_path", F.lit("x")))
    files = publish.file_plan(got["clusters"], got["members"], rows, 20_000)
    placed = publish.place(got["members"], files)
    publish.write(rows, placed, f"file://{tmp_path}/site")
    assert spark.read.text(f"file://{tmp_path}/site").count() == n
    assert sum(x["numConvs"] for x in json.loads(publish.root_index(got["clusters"], files).first().value)) == n


def test_sealed(spark):
    key, salt = publish.key_of("secret", b"s" * 16, 1000)
    blob = bytes(spark.range(1).select(publish.sealed(F.lit(b"hello"), key, salt, 1000).alias("x")).first().x)
    assert blob[:4] == publish.MAGIC and int.from_bytes(blob[4:8], "little") == 1000 and blob[8:24] == salt
    body = spark.createDataFrame([(bytearray(blob[24:]),)], "b binary")
    assert bytes(body.select(F.aes_decrypt("b", F.lit(key), F.lit("GCM")).alias("p")).first().p) == b"hello"


def test_stages(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    s = Stages(spark, f"file://{tmp_path}")
    _, a = s.get("x", {"k": 1}, make)
    s.get("x", {"k": 1}, make)
    assert len(made) == 1
    s.get("x", {"k": 2}, make)
    s.get("x", {"k": 1}, make, after=(a,))
    assert len(made) == 3


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "record_id long, text string").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("record_id long, text string").parquet(f"{tmp_path}/in")
    model, seen = providers.HashedWords(16), []
    q = assigned_stream(rows, model.encode(["alpha beta", "gamma"]), model, lambda df, n: seen.extend(df.collect()), f"{tmp_path}/cp")
    q.awaitTermination()
    assert {r.record_id: r.cluster for r in seen} == {1: 0, 2: 1}


def test_levels_reject_cycles(spark):
    nodes = spark.createDataFrame([(1, None), (2, 3), (3, 2)], "node long, parent long")
    assert [r.node for r in tree.levels(nodes).collect()] == [1]
