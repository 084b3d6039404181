"""The published site: nested files, stubs, counts of a filter, index, arrays, sealing."""

import gzip
import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from facetmill.functions.codec import path_code
from facetmill.operators import tree
from facetmill.plans import insight
from facetmill.sources import publish
from facetmill.sources.scratch import Scratch

FACETS = [insight.Facet("Other", "What?"), insight.Facet("Topic", "Which?", "", "Name it.")]


def tables(spark, leaves=9, records=120):
    clusters = [(100, None), (101, None)] + [(10 + i, 100 + i % 2) for i in range(4)] + [(i, 10 + i % 4) for i in range(leaves)]
    level = lambda c: 2 if c >= 100 else 1 if c >= 10 else 0
    rows = [(1, c, level(c), p, f"name {c}", f"about {c}", 0) for c, p in clusters]
    rng = random.Random(2)
    return {
        "records": spark.createDataFrame([(7 * i,) for i in range(records)], "record_id long"),
        "clusters": spark.createDataFrame(rows, "facet_id int, cluster_id int, level int, parent_id int, name string, summary string, n long"),
        "members": spark.createDataFrame([(1, i % leaves, 7 * i) for i in range(records)], "facet_id int, cluster_id int, record_id long"),
        "values": spark.createDataFrame([(7 * i, f, f"value {f} {i}") for i in range(records) for f in (0, 1)], "record_id long, facet_id int, value string"),
        "points": spark.createDataFrame([(1, 7 * i, rng.random(), rng.random()) for i in range(records)], "facet_id int, record_id long, x double, y double"),
    }


def turns(spark, records=120):
    return spark.createDataFrame([(7 * i, [("user", f'say "{i}"\n'), ("assistant", "é" * (i % 9))]) for i in range(records)], "record_id long, turns array<struct<role:string,content:string>>")


def walk(node, read):
    """Every leaf's records below a node, following stubs into other files."""
    def inside(n, data):
        if "path" in n:
            other = read(n["path"])
            assert other["numConvs"] == n["numConvs"]
            yield from inside(other, other["conversationsData"])
        elif "children" in n:
            assert n["numConvs"] == sum(k["numConvs"] for k in n["children"])
            for k in n["children"]:
                yield from inside(k, data)
        else:
            assert n["numConvs"] == len(n["conversations"])
            for i in n["conversations"]:
                yield n, data[i]

    yield from inside(node, node.get("conversationsData"))


@pytest.mark.parametrize("most", [100_000, 4_000, 10])
def test_site(spark, tmp_path, most):
    t, path = tables(spark), f"{tmp_path}/site"
    kept = t["records"].where("record_id % 2 = 0")
    mapping = {r.record_id: r for r in publish.site(t, FACETS, turns(spark), f"file://{path}", "/x", kept, most)["Topic"].collect()}
    read = lambda p: json.load(gzip.open(path + p.removeprefix("/x")))
    index = json.load(open(f"{path}/rootObjects.json"))
    assert [f["facet"]["name"] for f in index] == ["Topic"]
    roots = index[0]["hierarchy"]
    assert sum(r["numConvs"] for r in roots) == kept.count() == len(mapping)
    assert [r["numConvs"] for r in roots] == sorted((r["numConvs"] for r in roots), reverse=True)
    seen = [x for r in roots for x in walk({"numConvs": r["numConvs"], "path": r["path"]}, read)]
    assert len(seen) == len(mapping) and {x["facetValue"] for _, x in seen} == {f"value 1 {i // 7}" for i in mapping}
    for leaf, x in seen:
        assert leaf["name"].startswith("name ") and len(x["conversation"]) == 2
        assert [v["facet"] for v in x["allFacetValues"]] == ["Other", "Topic"]
        assert leaf["concaveHull"]
    n = len([f for f in os.listdir(f"{path}/Topic") if f.startswith("data")])
    assert n == {100_000: 2, 10: 15}.get(most, n) and (most != 4_000 or 2 < n < 15)
    flat = struct.unpack("<240i", open(f"{path}/Topic/conversationsMapping.bin", "rb").read())
    for i in range(120):
        if 7 * i in mapping:
            m = mapping[7 * i]
            assert flat[2 * i : 2 * i + 2] == (m.file_idx, m.offset)
            assert read(f"/x/Topic/data{m.file_idx}.json.gz")["conversationsData"][m.offset]["hash"] == m.url_path
    points = struct.unpack("<240f", open(f"{path}/Topic/points.bin", "rb").read())
    want = {r.record_id: (r.x, r.y) for r in t["points"].collect()}
    assert all(abs(points[2 * i] - want[7 * i][0]) < 1e-6 and abs(points[2 * i + 1] - want[7 * i][1]) < 1e-6 for i in range(120))


def test_sealed_site(spark, tmp_path):
    path = f"{tmp_path}/site"
    publish.site(tables(spark), FACETS, turns(spark), f"file://{path}", "", None, 4_000, password="pass", iterations=1000)
    nonces = set()
    for f in os.listdir(f"{path}/Topic"):
        if f.startswith("data"):
            blob = open(f"{path}/Topic/{f}", "rb").read()
            assert blob[:4] == publish.MAGIC
            key, salt = publish.key_of("pass", blob[8:24], int.from_bytes(blob[4:8], "little"))
            nonces.add(blob[24:36])
            body = spark.createDataFrame([(bytearray(blob[24:]), bytearray(key))], "b binary, k binary")
            assert "conversationsData" in json.loads(gzip.decompress(bytes(body.select(F.aes_decrypt("b", "k", F.lit("GCM")).alias("p")).first().p)))
    assert len(nonces) == len([f for f in os.listdir(f"{path}/Topic") if f.startswith("data")])


def test_key_is_not_in_the_plan(spark):
    key, salt = publish.key_of("secret", b"s" * 16, 1000)
    plan = spark.range(1).select(publish.sealed(F.lit(b"hello"), key, salt, 1000).alias("x"))._jdf.queryExecution().toString()
    assert key.hex().upper() not in plan.upper() and str(key) not in plan


def test_record_path_of_the_survey(spark):
    """Facet 0, root ordinal 2, child ordinal 1, member 3."""
    nodes = spark.createDataFrame([(i, None) for i in range(3)] + [(10 + i, 2) for i in range(2)], "node long, parent long")
    n = spark.createDataFrame([(0, 50), (1, 40), (2, 30), (10, 20), (11, 10)], "node long, n long")
    members = spark.createDataFrame([(11, i) for i in (5, 6, 8, 9)], "node long, record_id long")
    leaf = tree.paths(nodes, n).select("node", "path")
    got = {r.record_id: r.url_path for r in tree.record_paths(leaf, members).collect()}
    assert got[9] == "f0,f0.2,f0.2.1,f0.2.1$c,c!f0.2.1!3"
    assert tree.record_paths(leaf, members).select(path_code(F.col("url_path"))).count() == 4


@pytest.mark.parametrize("seed", range(4))
def test_files_hold_whole_subtrees(spark, seed):
    rng = random.Random(seed)
    nodes = [(i, None if i < 2 else rng.randrange(i), rng.randrange(10, 400)) for i in range(60)]
    df = spark.createDataFrame(nodes, "node long, parent long, size long")
    with Scratch(spark, "t") as scratch:
        got = {r.node: (r.file, r.place) for r in tree.files(df, 900, scratch).collect()}
    parent, size = {n: p for n, p, _ in nodes}, {n: s for n, _, s in nodes}
    kids = {n: [k for k in parent if parent[k] == n] for n in parent}
    for n in parent:
        file = got[n][0]
        assert got[file][0] == file and (n == file or got[parent[n]][0] == file)  # files are connected, and named by their top
        assert parent[n] is None or got[parent[n]][1] < got[n][1]
    for top in {f for f, _ in got.values()}:
        inside = [n for n in got if got[n][0] == top]
        total = sum(size[n] for n in inside) + tree.STUB * sum(got[k][0] != top for n in inside for k in kids[n])
        assert total < 900 or all(got[k][0] != top for k in kids[top]) or len(inside) == 1


def test_tree_deeper_than_any_bound(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)], "node long, parent long")
    a = tree.ancestors(nodes)
    assert a.count() == 70 * 71 // 2 and a.agg(F.max("steps")).first()[0] == 69
