"""Trees as parent tables: levels, ancestors, counts, paths, outline and packing in files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetmill.sources.scratch import Scratch


def levels(nodes: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """nodes (node, parent; null for roots) with ``level``, 0 for roots. Nodes on a cycle, or below none, are left out.

    A level is a written table, so plans don't grow with the depth; the tree may be of any depth.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "levels")
    nodes = scratch.table(nodes, "nodes")
    front = nodes.where("parent IS NULL").withColumn("level", F.lit(0))
    out, depth = front, 0
    while True:
        depth += 1
        up = front.select(F.col("node").alias("parent"))
        front = scratch.table(nodes.join(up, "parent", "left_semi").withColumn("level", F.lit(depth)).select(*out.columns), "level")
        if not front.head(1):
            return out
        out = out.unionByName(front)


def ancestors(nodes: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, ancestor, steps) for every node and itself at 0, by doubling: as many rounds as the log of the depth.

    jump holds the pairs 2**r steps apart; those of up (under 2**r steps) go on by one jump each, so no pair comes twice.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "ancestors")
    up = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps"))
    jump = scratch.table(nodes.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")), "jump")
    while jump.head(1):
        more = jump.select(F.col("node").alias("_m"), F.col("ancestor").alias("_a"), F.col("steps").alias("_s"))
        on = lambda t: t.join(more, t.ancestor == more._m).select("node", F.col("_a").alias("ancestor"), (F.col("steps") + F.col("_s")).alias("steps"))
        up = scratch.table(up.unionByName(on(up)), "up")
        jump = scratch.table(on(jump), "jump")
    return up


def rolled_up(nodes: DataFrame, leaf_counts: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, n: counts (node, n) of leaves summed over each node's whole subtree; 0 where there are none."""
    a = ancestors(nodes, scratch)
    n = a.join(leaf_counts, "node").groupBy(F.col("ancestor").alias("node")).agg(F.sum("n").alias("n"))
    return nodes.select("node").join(n, "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def members_under(nodes: DataFrame, members: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, record_id): leaf members (node, record_id) of each subtree."""
    return ancestors(nodes, scratch).join(members, "node").select(F.col("ancestor").alias("node"), "record_id")


def ordinals(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """nodes with n and ``ordinal``, the place among siblings from the largest, ties to the smaller id."""
    w = Window.partitionBy("parent").orderBy(F.col("n").desc(), "node")
    return nodes.join(counts, "node").withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))


def paths(nodes: DataFrame, counts: DataFrame, facet: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """node, level, path: f{facet}.{ordinal of root}.{ordinal of child}..."""
    scratch = scratch or Scratch(nodes.sparkSession, "paths")
    o = scratch.table(ordinals(nodes, counts), "ordinals")
    front = o.where("parent IS NULL").select("node", F.lit(0).alias("level"), F.concat(F.lit(f"f{facet}."), F.col("ordinal").cast("string")).alias("path"))
    out, depth = front, 0
    while True:
        depth += 1
        up = front.select(F.col("node").alias("parent"), F.col("path").alias("_p"))
        front = scratch.table(o.where("parent IS NOT NULL").join(up, "parent").select("node", F.lit(depth).alias("level"), F.concat("_p", F.lit("."), F.col("ordinal").cast("string")).alias("path")), "paths")
        if not front.head(1):
            return out
        out = out.unionByName(front)


def record_paths(leaf_paths: DataFrame, members: DataFrame) -> DataFrame:
    """record_id, url_path: the chain of paths from the facet to the leaf, the leaf again with its conversations open, the record's place there."""
    w = Window.partitionBy("node").orderBy("record_id")
    m = members.withColumn("_i", F.row_number().over(w) - 1).join(leaf_paths, "node")
    parts = F.split("path", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    url = F.concat(F.array_join(chain, ","), F.lit(","), F.col("path"), F.lit("$c,c!"), F.col("path"), F.lit("!"), F.col("_i").cast("string"))
    return m.select("record_id", url.alias("url_path"))


def outline(nodes: DataFrame, counts: DataFrame, names: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """position key and line of each node in pre-order, indented by two spaces a level; sort by ``sort_key``."""
    p = paths(nodes, counts, scratch=scratch)
    key = F.array_join(F.transform(F.split("path", r"\."), lambda x: F.lpad(F.regexp_replace(x, "^f", ""), 10, "0")), ".")
    return p.join(names, "node").select(key.alias("sort_key"), F.concat(F.repeat(F.lit("  "), F.col("level")), F.col("name")).alias("line"))


STUB = 64  # characters that stand for a node kept in another file


def _files(nodes: list[tuple[int, int | None, int]], most: int) -> list[tuple[int, int, int]]:
    """(node, file, place) of one tree of (node, parent, own size): the file is named by its topmost node, the place is the
    node's in pre-order.

    In rounds from the top, a node goes to a file of its own, with all below that isn't in one yet, once that is shorter than
    most or everything under it is in files already; what is in files counts as a stub.
    """
    children: dict[int | None, list[int]] = {}
    own = {n: size for n, _, size in nodes}
    for n, p, _ in sorted(nodes):
        children.setdefault(p if p in own else None, []).append(n)
    order, todo = [], children.get(None, [])[::-1]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(children.get(n, [])[::-1])
    file: dict[int, int] = {}
    tops: set[int] = set()
    while not all(r in tops for r in children.get(None, [])):
        whole: dict[int, int] = {}
        for n in reversed(order):
            whole[n] = STUB if n in tops else own[n] + sum(whole[c] for c in children.get(n, []))
        settled = set(tops)
        todo = list(children.get(None, []))
        while todo:
            n = todo.pop()
            if n in tops:
                continue
            if whole[n] >= most and not all(c in settled for c in children.get(n, [])):
                todo.extend(children.get(n, []))
                continue
            tops.add(n)
            inside = [n]
            while inside:
                x = inside.pop()
                file[x] = n
                inside.extend(c for c in children.get(x, []) if c not in settled)
    return [(n, file[n], i) for i, n in enumerate(order)]


def packed(nodes: list[tuple[int, int | None, int]], most: int) -> dict[int, int]:
    """The file (its topmost node) of each node of (node, parent, own size), in memory."""
    return {n: f for n, f, _ in _files(nodes, most)}


def files(nodes: DataFrame, most: int, scratch: Scratch | None = None) -> DataFrame:
    """node, file (its topmost node), place (in pre-order): nodes (node, parent, size) packed by size. A task packs the outline of one root."""
    scratch = scratch or Scratch(nodes.sparkSession, "files")
    nodes = scratch.table(nodes.select("node", "parent", "size"), "sizes")
    up = ancestors(nodes, scratch)
    root = up.join(nodes.where("parent IS NULL").select(F.col("node").alias("ancestor")), "ancestor").select("node", F.col("ancestor").alias("root"))
    kind = nodes.schema["node"].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(n), None if pd.isna(q) else int(q), int(s)) for n, q, s in zip(p["node"], p["parent"], p["size"], strict=True)]
        return pd.DataFrame(_files(rows, most), columns=["node", "file", "place"])

    return scratch.table(nodes.join(root, "node").groupBy("root").applyInPandas(run, f"node {kind}, file {kind}, place int"), "files")
