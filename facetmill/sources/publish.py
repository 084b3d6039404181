"""Publishing: size-bounded JSON files of a tree and its records, an index, points and mapping, plain or encrypted."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetmill.operators import hull, tree
from facetmill.operators.records import survivor_positions
from facetmill.sources.scratch import Scratch, hadoop_path

ITERATIONS = 800_000
MAGIC = b"EJ01"  # fixed value of the format, before iterations (4 bytes, low first), salt (16), nonce (12), cipher text
MAX_CHARS = 10_000_000
CHUNK = 100_000  # rows of an array file that are put together at once


def key_of(password: str, salt: bytes | None = None, iterations: int = ITERATIONS) -> tuple[bytes, bytes]:
    salt = os.urandom(16) if salt is None else salt
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, 32), salt


def sealed(data: Column, key: bytes, salt: bytes, iterations: int = ITERATIONS) -> Column:
    """Header and AES-GCM cipher text; the engine's own output begins with the nonce and ends with the tag.

    The key is no literal of the plan, which logs would show: tasks take it from a broadcast.
    """
    shared = SparkSession.active().sparkContext.broadcast(key)
    secret = F.pandas_udf(lambda n: pd.Series([shared.value] * len(n)), "binary")
    head = MAGIC + iterations.to_bytes(4, "little") + salt
    return F.concat(F.lit(head), F.aes_encrypt(data, secret(F.length(data)), F.lit("GCM")))


def record_json(rows: DataFrame) -> DataFrame:
    """record_id, json of (record_id, turns, url_path, facets ARRAY<STRUCT<facet, value>>, value)."""
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return rows.select("record_id", F.to_json(F.struct(turns.alias("conversation"), F.col("url_path").alias("hash"), F.col("facets").alias("allFacetValues"), F.col("value").alias("facetValue"))).alias("json"))


def filtered(members: DataFrame, kept: DataFrame | None) -> DataFrame:
    """Leaf members (cluster_id, record_id) whose record is among kept (record_id); all without it."""
    return members if kept is None else members.join(kept.select("record_id").distinct(), "record_id", "left_semi").select(*members.columns)


def recounted(clusters: DataFrame, members: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """clusters with n counted anew from the leaves' members; clusters that have lost all stay, with 0."""
    nodes = clusters.select(F.col("cluster_id").alias("node"), F.col("parent_id").alias("parent"))
    n = tree.rolled_up(nodes, members.groupBy(F.col("cluster_id").alias("node")).agg(F.count("*").alias("n")), scratch)
    return clusters.drop("n").join(n.withColumnRenamed("node", "cluster_id"), "cluster_id")


def outlines(clusters: DataFrame, members: DataFrame, points: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """cluster_id, hull: ids of the records around each cluster's points, of its whole subtree."""
    nodes = clusters.select(F.col("cluster_id").alias("node"), F.col("parent_id").alias("parent"))
    below = tree.members_under(nodes, members.select(F.col("cluster_id").alias("node"), "record_id"), scratch).join(points.select("record_id", "x", "y"), "record_id")
    h = hull.hulls(below.withColumnRenamed("node", "cluster_id"), "cluster_id")
    h = h.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "record_id"))), lambda p: p["record_id"]).alias("hull"))
    return clusters.select("cluster_id").join(h, "cluster_id", "left").select("cluster_id", F.coalesce("hull", F.array().cast("array<bigint>")).alias("hull"))


def _own(clusters: DataFrame) -> Column:
    return F.to_json(F.struct("summary", "name", F.col("n").alias("numConvs"), F.col("hull").alias("concaveHull")))


def file_plan(clusters: DataFrame, members: DataFrame, json: DataFrame, most: int = MAX_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """cluster_id, file_idx, top (whether the file begins with it), place: which file holds each cluster. Records' sizes are summed by cluster first."""
    sizes = members.join(json.select("record_id", (F.length("json") + 8).alias("_json")), "record_id").groupBy("cluster_id").agg(F.sum("_json").alias("_chars"))
    own = F.length(F.concat_ws("", "name", "summary")) + 60 + (8 * F.size("hull") if "hull" in clusters.columns else F.lit(0))
    nodes = clusters.join(sizes, "cluster_id", "left").select(F.col("cluster_id").alias("node"), F.col("parent_id").alias("parent"), (own + F.coalesce("_chars", F.lit(0))).cast("long").alias("size"))
    found = tree.files(nodes, most, scratch)
    number = survivor_positions(found.select("file").distinct()).select("file", F.col("position").alias("file_idx"))
    return found.join(number, "file").select(F.col("node").alias("cluster_id"), "file_idx", (F.col("node") == F.col("file")).alias("top"), "place")


def place(members: DataFrame, files: DataFrame) -> DataFrame:
    """record_id, cluster_id, file_idx, offset: where each record stands among its file's records."""
    w = Window.partitionBy("file_idx").orderBy("place", "record_id")
    return members.join(files, "cluster_id").withColumn("offset", (F.row_number().over(w) - 1).cast("long")).select("record_id", "cluster_id", "file_idx", "offset")


def _nested(nodes: pd.DataFrame, records: pd.DataFrame) -> str:
    """The JSON of one file: its clusters one in the other, those of other files as stubs, and the records they point to."""
    held = {c: (own, parent, top) for c, own, parent, top in zip(nodes["cluster_id"], nodes["own"], nodes["parent_id"], nodes["inside"], strict=True)}
    kids: dict[int, list[int]] = {}
    for c in nodes.sort_values("place")["cluster_id"]:
        kids.setdefault(held[c][1], []).append(c)
    at = records.groupby("cluster_id")["offset"].apply(list).to_dict() if len(records) else {}
    text: dict[int, str] = {}
    for c in nodes.sort_values("place", ascending=False)["cluster_id"]:  # children stand after their parents
        own, _, inside = held[c]
        if not inside:
            text[c] = own
        elif c in kids:
            text[c] = own[:-1] + ',"children":[' + ",".join(text.pop(k) for k in kids[c]) + "]}"
        else:
            text[c] = own[:-1] + ',"conversations":' + json.dumps(sorted(int(i) for i in at.get(c, [])), separators=(",", ":")) + "}"
    top = nodes.loc[nodes["top"], "cluster_id"].iloc[0]
    return text[top][:-1] + ',"conversationsData":[' + ",".join(records.sort_values("offset")["json"]) + "]}"


def documents(clusters: DataFrame, files: DataFrame, placed: DataFrame, records: DataFrame, folder: str) -> DataFrame:
    """file_idx, value: one line of JSON a file. clusters: cluster_id, parent_id, name, summary, n, hull; records: record_id, json.

    A file's clusters and records meet in one task; only a leaf larger than the limit makes a file larger than it.
    """
    path = F.concat(F.lit(f"{folder}/data"), F.col("file_idx").cast("string"), F.lit(".json.gz"))
    c = clusters.join(files, "cluster_id").withColumn("own", _own(clusters))
    mine = c.select("file_idx", "cluster_id", "parent_id", "own", "top", "place", F.lit(True).alias("inside"))
    # the first cluster of another file stands as a stub in the file of its parent
    stub = F.to_json(F.struct(F.col("n").alias("numConvs"), path.alias("path")))
    of = files.select(F.col("cluster_id").alias("_p"), F.col("file_idx").alias("_f"))
    stubs = c.where("top AND parent_id IS NOT NULL").join(of, F.col("parent_id") == F.col("_p")).select(F.col("_f").alias("file_idx"), "cluster_id", "parent_id", stub.alias("own"), F.lit(False).alias("top"), "place", F.lit(False).alias("inside"))
    held = placed.join(records, "record_id").select("file_idx", "cluster_id", "offset", "json")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"file_idx": [], "value": []}).astype({"file_idx": "int64", "value": "str"})
        return pd.DataFrame({"file_idx": a["file_idx"].iloc[:1], "value": [_nested(a, b)]})

    return mine.unionByName(stubs).groupBy("file_idx").cogroup(held.groupBy("file_idx")).applyInPandas(run, "file_idx long, value string")


def write(json: DataFrame, placed: DataFrame, path: str, key: tuple[bytes, bytes] | None = None) -> None:
    """Records alone, one folder a file number: gzip lines of JSON in order of offset, or sealed lines in Parquet."""
    rows = json.join(placed, "record_id").repartition("file_idx").sortWithinPartitions("file_idx", "offset")
    if key:
        rows.select("file_idx", "offset", sealed(F.encode("json", "utf-8"), *key).alias("sealed")).write.mode("overwrite").partitionBy("file_idx").parquet(path)
    else:
        rows.select("file_idx", F.col("json").alias("value")).write.mode("overwrite").partitionBy("file_idx").option("compression", "gzip").text(path)


def root_index(clusters: DataFrame, files: DataFrame) -> DataFrame:
    """value: one line of JSON with each root's count and folder of ``write``."""
    roots = clusters.where("parent_id IS NULL").join(files, "cluster_id")
    one = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("cluster_id"), F.col("n").alias("numConvs"), F.concat(F.lit("file_idx="), F.col("file_idx").cast("string")).alias("path"))))
    return roots.agg(F.to_json(F.transform(one, lambda x: F.struct(x["numConvs"].alias("numConvs"), x["path"].alias("path")))).alias("value"))


def site_index(facets: list[tuple[dict, DataFrame, DataFrame]], folder: str = "") -> str:
    """JSON of all facets: (what the index says of the facet, its clusters with n, their files)."""
    out = []
    for said, clusters, files in facets:
        roots = clusters.where("parent_id IS NULL").join(files, "cluster_id").select("cluster_id", "n", "file_idx").orderBy(F.col("n").desc(), "cluster_id").collect()  # the top of a tree, made small
        base = f"{folder}/{said['name']}"
        out.append({"facet": said, "hierarchy": [{"numConvs": r.n, "path": f"{base}/data{r.file_idx}.json.gz"} for r in roots], "points": f"{base}/points.bin", "conversationsMapping": f"{base}/conversationsMapping.bin"})
    return json.dumps(out)


def _write_bytes(spark: SparkSession, path: str, parts: Iterator[bytes]) -> None:
    p, fs = hadoop_path(spark, path)
    out = fs.create(p, True)
    for x in parts:
        out.write(bytearray(x))
    out.close()


def write_files(docs: DataFrame, path: str, key: tuple[bytes, bytes] | None = None, iterations: int = ITERATIONS) -> None:
    """data{file_idx}.json.gz for each row of (file_idx, value): gzip, or with a key a sealed gzip.

    Plain files are written by the tasks and then only renamed; sealed ones pass through the driver one at a time.
    """
    spark = docs.sparkSession
    if key:
        packed = F.pandas_udf(lambda s: s.map(lambda x: gzip.compress(x.encode(), 9, mtime=0)), "binary")
        for r in docs.select("file_idx", sealed(packed("value"), *key, iterations).alias("b")).toLocalIterator():
            _write_bytes(spark, f"{path}/data{r.file_idx}.json.gz", iter([bytes(r.b)]))
        return
    temp = f"{path}/_parts"
    docs.select("file_idx", "value").repartition("file_idx").write.mode("overwrite").partitionBy("file_idx").option("compression", "gzip").text(temp)
    folder, fs = hadoop_path(spark, temp)
    for of in fs.listStatus(folder):
        if (m := re.fullmatch(r"file_idx=(\d+)", of.getPath().getName())) is None:
            continue
        for part in fs.listStatus(of.getPath()):
            if part.getPath().getName().startswith("part-"):
                fs.rename(part.getPath(), hadoop_path(spark, f"{path}/data{m[1]}.json.gz")[0])
    fs.delete(folder, True)


def write_array(rows: DataFrame, columns: tuple[str, str], kind: str, path: str) -> None:
    """A binary file of two numbers (kind f or i, 4 bytes, low first) for each row, in order of ``position`` (0, 1, ...).

    Chunks are put together by tasks; the driver passes them on, one at a time.
    """
    chunk = rows.select(F.floor(F.col("position") / CHUNK).alias("chunk"), "position", *columns)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("position")
        flat = p[list(columns)].to_numpy().reshape(-1).tolist()
        return pd.DataFrame({"chunk": p["chunk"].iloc[:1], "bytes": [struct.pack(f"<{len(flat)}{kind}", *flat)]})

    made = chunk.groupBy("chunk").applyInPandas(run, "chunk long, bytes binary").orderBy("chunk")
    _write_bytes(rows.sparkSession, path, (bytes(r["bytes"]) for r in made.toLocalIterator()))


def site(tables: dict[str, DataFrame], facets: list, turns: DataFrame, path: str, folder: str = "", kept: DataFrame | None = None, most: int = MAX_CHARS, password: str | None = None, iterations: int = ITERATIONS) -> dict[str, DataFrame]:
    """Writes what a viewer needs of ``insight.run``'s tables: per facet nested JSON files, points and mapping; the index.

    turns: record_id, turns ARRAY<STRUCT<role, content>>. kept: record_id of the records to publish; counts follow them.
    Returns, by facet name, the mapping (record_id, file_idx, offset, url_path).
    """
    spark = turns.sparkSession
    key = key_of(password, iterations=iterations) if password else None
    index, out = [], {}
    scratch = Scratch(spark, "site")
    names = spark.createDataFrame([(i, f.name) for i, f in enumerate(facets)], "facet_id int, _facet string")
    said = tables["values"].join(F.broadcast(names), "facet_id").groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("facet_id", F.col("_facet").alias("facet"), "value"))), lambda v: F.struct(v["facet"].alias("facet"), v["value"].alias("value"))).alias("facets"))
    position = scratch.table(survivor_positions(tables["records"].select("record_id").distinct()), "positions")
    for i, f in enumerate(facets):
        clusters = tables["clusters"].where(F.col("facet_id") == i)
        if f.summary_criteria is None or not clusters.head(1):
            continue
        members = scratch.table(filtered(tables["members"].where(F.col("facet_id") == i).select("cluster_id", "record_id"), kept), "members")
        clusters = scratch.table(recounted(clusters, members, scratch), "clusters")
        points = tables["points"].where(F.col("facet_id") == i)
        clusters = scratch.table(clusters.join(outlines(clusters, members, points, scratch), "cluster_id"), "outlined")
        nodes = clusters.select(F.col("cluster_id").alias("node"), F.col("parent_id").alias("parent"))
        leaf = tree.paths(nodes, clusters.select(F.col("cluster_id").alias("node"), "n"), i, scratch).select("node", "path")
        url = scratch.table(tree.record_paths(leaf, members.withColumnRenamed("cluster_id", "node")), "urls")
        value = tables["values"].where(F.col("facet_id") == i).select("record_id", "value")
        records = scratch.table(record_json(turns.join(url, "record_id").join(said, "record_id").join(value, "record_id")), "json")
        files = scratch.table(file_plan(clusters, members, records, most, scratch), "plan")
        placed = scratch.table(place(members, files), "placed")
        write_files(documents(clusters, files, placed, records, f"{folder}/{f.name}"), f"{path}/{f.name}", key, iterations)
        where = position.join(placed, "record_id", "left").select("position", F.coalesce("file_idx", F.lit(0)).cast("int").alias("file_idx"), F.coalesce("offset", F.lit(0)).cast("int").alias("offset"))
        write_array(where, ("file_idx", "offset"), "i", f"{path}/{f.name}/conversationsMapping.bin")
        write_array(position.join(points, "record_id", "left").select("position", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y")), ("x", "y"), "f", f"{path}/{f.name}/points.bin")
        index.append(({"name": f.name, "question": f.question, "prefill": f.prefill, "summaryCriteria": f.summary_criteria or "", "numeric": list(f.numeric or ())}, clusters, files))
        out[f.name] = placed.join(url, "record_id").select("record_id", "file_idx", "offset", "url_path")
    _write_bytes(spark, f"{path}/rootObjects.json", iter([site_index(index, folder).encode()]))
    return out
