"""Convex outline of each group of points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURNS = 64


def outline(points: list[tuple[float, float, int]]) -> list[int]:
    """Record ids of the convex hull, counter-clockwise from the leftmost; of fewer than three corners, those."""
    p = sorted(points)
    if len(p) < 3:
        return [r for _, _, r in p]

    def half(ps):
        out: list[tuple[float, float, int]] = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out

    low, high = half(p), half(p[::-1])
    return [r for _, _, r in low[:-1] + high[:-1]]


def hulls(points: DataFrame, by: str) -> DataFrame:
    """by, position, record_id of each group's hull; points: by, record_id, x, y.

    Parts of a group, by a hash, give their own hulls first; only those few points meet in one task.
    """
    kind = points.schema[by].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        ids = outline(list(zip(p["x"], p["y"], p["record_id"], strict=True)))
        at = p.drop_duplicates("record_id").set_index("record_id").loc[ids]
        return pd.DataFrame({by: p[by].iloc[0], "position": range(len(ids)), "record_id": ids, "x": at["x"].to_numpy(), "y": at["y"].to_numpy()})

    schema = f"{by} {kind}, position int, record_id long, x double, y double"
    part = points.select(by, F.col("record_id").cast("long"), "x", "y").withColumn("_s", F.pmod(F.xxhash64("record_id"), F.lit(TURNS)))
    few = part.groupBy(by, "_s").applyInPandas(lambda p: run(p), schema).drop("position")
    return few.groupBy(by).applyInPandas(lambda p: run(p), schema)
