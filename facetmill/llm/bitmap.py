"""Bitmaps of hashes that tasks use to drop rows early: a false bit costs a row, never a result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITMAP_MOST = 1 << 28  # bits, 32 MB
PIECE = 16  # log of the bits that one group of rows makes
_U = np.uint64


def bitmap(rows: DataFrame, h: str, n: int) -> np.ndarray | None:
    """A bitmap of n rows' hashes (column h, long), put together from pieces that groups of rows make; None if it would go over BITMAP_MOST."""
    if 4 * n > BITMAP_MOST:
        return None
    bits = min(BITMAP_MOST, 1 << max(PIECE, (8 * n - 1).bit_length() if n else 0))

    def piece(key: tuple, t: pa.Table) -> pa.Table:
        at = t.column("h").to_numpy().view(_U) & _U((1 << PIECE) - 1)
        own = np.zeros(1 << PIECE, np.uint8)
        own[at.astype(np.int64)] = 1
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    of = F.shiftright(F.col(h).bitwiseAND(F.lit(bits - 1).cast("long")), PIECE).cast("int").alias("piece")
    got = rows.select(of, F.col(h).alias("h")).groupBy("piece").applyInArrow(piece, "piece int, bits binary").toArrow()  # BITMAP_MOST bits at most
    out = np.zeros((bits >> PIECE, (1 << PIECE) // 8), np.uint8)
    for k, raw in zip(got.column("piece").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[k] = np.frombuffer(raw, np.uint8)
    return out.reshape(-1)


def hit(bits: np.ndarray | None, g: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the bitmap; all without one."""
    if bits is None:
        return np.ones(len(g), bool)
    spot = (g & _U(8 * len(bits) - 1)).astype(np.int64)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def among(sorted_: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which of the hashes are in the sorted ones."""
    if not len(sorted_):
        return np.zeros(len(g), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, g), len(sorted_) - 1)] == g
