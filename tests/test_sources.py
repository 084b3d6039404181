"""Readers, the response store, stages after changed data, names made one, retries and truncation in the flow."""

import glob
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from facetmill.operators import providers, records
from facetmill.plans import insight
from facetmill.sources import readers
from facetmill.sources.scratch import Scratch
from facetmill.sources.stages import Stages

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests
TURNS = "array<struct<role:string,content:string,language:string>>"


def test_wide_turns(spark, tmp_path):
    turn = "struct<role:string,content:string>"
    rows = [(("user", "a"), ("assistant", "b"), None), (("user", "a"), ("assistant", "b"), None), (("user", "c"), None, None)]
    spark.createDataFrame(rows, f"`0` {turn}, `1.x` {turn}, `2` {turn}").coalesce(1).write.parquet(f"{tmp_path}/w")
    got = readers.wide_turns(spark, f"{tmp_path}/w").orderBy("record_id").collect()
    assert [[t.content for t in r.turns] for r in got] == [["a", "b"], ["a", "b"], ["c"]]
    assert len({r.record_id for r in got}) == 3


def test_conversation_files(spark, tmp_path):
    for name, texts in (("train-00001", ["b1", "b1", "b2"]), ("train-00000", ["a1"]), ("other-1", ["no"])):
        rows = [([("user", t, "English"), ("assistant", "x", "French" if t == "b2" else "English")],) for t in texts]
        spark.createDataFrame(rows, f"conversation {TURNS}").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        os.makedirs(f"{tmp_path}/all", exist_ok=True)
        os.rename(glob.glob(f"{tmp_path}/{name}/part-*")[0], f"{tmp_path}/all/{name} x.parquet")
    read = lambda language: [r.turns[0].content for r in readers.conversation_files(spark, f"{tmp_path}/all", language=language).orderBy("record_id").collect()]
    assert read(None) == ["b1", "b1", "b2", "a1"] and read("English") == ["b1", "b1", "a1"]


class Fussy:
    """Fails on some prompts, and counts what it is asked in files."""

    name = "fussy"

    def __init__(self, folder):
        self.folder = folder

    def generate(self, prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        for p in prompts:
            with open(f"{self.folder}/asked", "a") as f:
                f.write(p + "\n")
        return ["to " + p for p in prompts]


def test_responses(spark, tmp_path):
    store, model = providers.Responses(spark, f"file://{tmp_path}/r"), Fussy(str(tmp_path))
    rows = lambda *p: spark.createDataFrame(list(enumerate(p)), "id int, prompt string")
    with Scratch(spark, "t") as scratch:
        got = {r.prompt: r.output for r in providers.answered(rows("a", "b", "bad", "a"), model, scratch, store).collect()}
        assert got == {"a": "to a", "b": "to b", "bad": None}
        assert [(r.prompt, r.error) for r in store.failed().collect()] == [("bad", "ValueError: no")]
        assert store.known().count() == 2
        assert {r.output for r in providers.answered(rows("b", "c"), model, scratch, store).collect()} == {"to b", "to c"}
    assert sorted(open(f"{tmp_path}/asked").read().split()) == ["a", "b", "c"]  # each once
    assert {r.prompt: r.output for r in providers.generated(rows("a", "bad"), model).collect()} == {"a": "to a", "bad": None}


def test_stages_follow_the_data(spark, tmp_path):
    made = []
    s = Stages(spark, f"file://{tmp_path}")

    def get(df):
        return s.get("x", {}, lambda: made.append(1) or df.withColumn("y", F.lit(1)), inputs=(df,))[0].count()

    a = spark.range(5)
    assert get(a) == 5 and get(a.repartition(3)) == 5 and len(made) == 1  # order is no content
    assert get(spark.range(1, 6)) == 5 and get(spark.range(6)) == 6 and len(made) == 3


def test_insight_resumes(spark, tmp_path):
    class Counted(providers.FrequentWords):
        name = "counted"

        def generate(self, prompts):
            with open(f"{tmp_path}/calls", "a") as f:
                f.write("x" * len(prompts))
            return super().generate(prompts)

    calls = lambda: len(open(f"{tmp_path}/calls").read())
    docs = spark.range(40).selectExpr("id AS record_id", "concat('text about subject', id % 7, ' and number', id) AS text")
    config = insight.Config().with_options(name_samples=1, generator=Counted())
    stages = Stages(spark, f"file://{tmp_path}/stages")
    run = lambda d, c=config: sorted(map(str, insight.run(spark, d, [insight.SUMMARY], c, stages)["clusters"].collect()))
    first, n = run(docs), calls()
    assert run(docs) == first and calls() == n  # nothing is asked again
    assert run(docs.where("record_id > 9")) != first and calls() > n
    n = calls()
    assert run(docs, config.with_options(seed=5)) and calls() > n


class Scripted:
    """Answers each kind of prompt as told; the last answer holds on."""

    name = "scripted"

    def __init__(self, **answers):
        self.answers = answers

    def generate(self, prompts):
        kind = lambda p: "dedup" if p.startswith("Names:") else "higher" if p.startswith("Groups") else "other"
        return [self.answers.get(kind(p), "")(p) if callable(self.answers.get(kind(p))) else self.answers.get(kind(p), "") for p in prompts]


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame([(0, [1, 2], ["red\nall red", "blue\nall blue", "green\nall green"]), (1, [3], ["cat\nall cats"])], "hood int, sources array<long>, clusters array<string>")


def test_unparsable_names_are_asked_again_and_then_given_up(spark, lists):
    with Scratch(spark, "t") as scratch:
        never = insight.Config(generator=Scripted(higher="I don't know"), name_tries=3)
        got = {r.hood: r.names for r in insight.proposed(lists, never, scratch).collect()}
        assert got[1] == ["cat"] and len(got[0]) == 1 and got[0][0] in ("red", "blue", "green")
        # only one order of the three clusters gives an answer
        picky = insight.Config(generator=Scripted(higher=lambda p: "<answer>\n1. Colours.\n</answer>" if "red\nall red\nblue" not in p else "?"), name_tries=9)
        assert {r.hood: r.names for r in insight.proposed(lists, picky, scratch).collect()} == {0: ["Colours"], 1: ["Colours"]}


def test_names_are_made_one(spark):
    names = spark.createDataFrame([("big cats", [1, 2]), ("large cats", [2, 3]), ("trees", [4]), ("old trees", [5])], "name string, sources array<long>")
    with Scratch(spark, "t") as scratch:
        config = insight.Config(per_cluster=4, generator=Scripted(dedup="<answer>\n1. Cats\n2. Trees\n</answer>"))
        assert {(r.name, tuple(r.sources)) for r in insight.deduplicated(names, config, scratch).collect()} == {("Cats", (1, 2, 3, 4, 5)), ("Trees", (1, 2, 3, 4, 5))}
        silent = insight.Config(per_cluster=4, generator=Scripted(dedup=""), name_tau=0.55)
        got = {(r.name, tuple(r.sources)) for r in insight.deduplicated(names, silent, scratch).collect()}
        assert {s for _, s in got} == {(1, 2, 3), (4, 5)} and all(n in ("big cats", "large cats", "trees", "old trees") for n, _ in got)


def test_conversations_are_cut_to_the_budget(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a " * 30), (1, 1, "assistant", "b " * 30), (1, 2, "user", "c " * 30), (2, 0, "user", "short")], "conv_id long, turn long, role string, text string")
    got = {r.record_id: r.text for r in insight.conversation_records(turns, insight.Config(max_tokens=70)).collect()}
    assert got[2] == "user:\nshort" and "b b" in got[1] and "c c" not in got[1]


def test_dedup_with_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None), (4, None)], "record_id long, text string")
    assert sorted(map(tuple, records.dedup(rows, F.col("text"), "record_id").collect()), key=str) == [(1, "a"), (1, "b"), (3, None)]


def test_positions_of_many_ranges(spark):
    ids = spark.range(0, 3000, 3).toDF("id").repartition(5)
    for parts in (None, 7):
        assert {r.id: r.position for r in records.survivor_positions(ids, parts).collect()} == {3 * i: i for i in range(1000)}
