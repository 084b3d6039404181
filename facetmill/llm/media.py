"""Cropped and edited copies of images by local descriptors.

At each of several scales, a quarter octave apart, all Harris corners that are strongest within SPACING
pixels and not FAINT beside the image's strongest are kept, so their number grows with the area; each gets the
orientation of its patch's intensity centroid and BITS binary brightness tests, turned by that orientation. The
patch is wide beside the scale's blur (25 pixels), as small patches of smooth images look alike; over the edge
the image goes on with its border. A descriptor is cut in BANDS words, which are the keys of Hamming tables:
descriptors that differ in fewer bits than there are bands have a word in common. All entries of a word are
compared. Images are cut in blocks by a hash, one task a pair of blocks holds all corners of both, so no partner
is missed, a common word is shared out over the pairs of blocks, and only one row a linked image leaves a task (the
smallest image that its links reach and their number, so a group of near copies is not written as all its pairs); a
corner travels once a block. Matches of two images vote for the turn, zoom and shift between them; a link is made by
CONSENSUS different places (PLACE pixels wide, so one corner at several scales counts once) that agree, or SHARE of
the corners of the image with fewer, if that is more.
Images with equal pixels are one class beforehand, so groups of exact copies are never matched.

No table holds images, so the query draws each embedding as one: its numbers, scaled to 0-255, are
the grey values of a square grid that is enlarged with linear interpolation.

Edge cases: null ids and null, empty or misshapen images (width * height other than the number of pixels)
take no part and are their own class; flat images have no corners, so they are linked only to equal ones;
repeated rows are one class; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from facetmill.operators.graph import connected_components, hung
from facetmill.sources.memory import tidy
from facetmill.sources.scratch import Scratch, arrow_rows

SCALES = tuple(2 ** (-i / 4) for i in range(6))
RADIUS = 12
MARGIN = 4
SPACING = 4
FAINT = 0.05
BITS, BANDS = 256, 8
TURNS = 24
NEAR = 40  # bits that matched descriptors may differ in
CONSENSUS = 5
SHARE = 0.02
PLACE = 8
TURN_CELLS = 12
TURN_CELL = 2 * math.pi / TURN_CELLS
SHIFT_CELL = 12.0
PART = 20_000  # corners whose partners are looked up at once
BLOCK = 400_000  # corners of a block of images; two of them are in a task
SPREAD = 3  # blocks that smaller tables are cut in, for work in parallel
ROOM = 500_000  # entries of equal words compared at once


def _pattern() -> np.ndarray:
    """turn x test x (y1, x1, y2, x2): random pairs in the disc, from a fixed seed, turned."""
    rng = np.random.default_rng(27)
    p = rng.normal(0, 0.6 * RADIUS, (BITS, 2, 2))
    p *= np.minimum(1, RADIUS / np.maximum(np.linalg.norm(p, axis=2, keepdims=True), 1e-9))
    out = []
    for t in range(TURNS):
        c, s = math.cos(2 * math.pi * t / TURNS), math.sin(2 * math.pi * t / TURNS)
        y, x = p[..., 0], p[..., 1]
        out.append(np.stack([s * x[:, 0] + c * y[:, 0], c * x[:, 0] - s * y[:, 0], s * x[:, 1] + c * y[:, 1], c * x[:, 1] - s * y[:, 1]], axis=1))
    return np.rint(np.array(out)).astype(np.int64)


PATTERN = _pattern()
_DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if y * y + x * x <= RADIUS * RADIUS])


def resize(stack: np.ndarray, h: int, w: int) -> np.ndarray:
    """Images (n, height, width) at another size, by linear interpolation between pixel centres."""
    _, oh, ow = stack.shape
    y = np.clip((np.arange(h) + 0.5) * oh / h - 0.5, 0, oh - 1)
    x = np.clip((np.arange(w) + 0.5) * ow / w - 0.5, 0, ow - 1)
    y0, x0 = np.minimum(y.astype(int), max(oh - 2, 0)), np.minimum(x.astype(int), max(ow - 2, 0))
    y1, x1 = np.minimum(y0 + 1, oh - 1), np.minimum(x0 + 1, ow - 1)
    fy, fx = (y - y0)[None, :, None], (x - x0)[None, None, :]
    top = stack[:, y0][:, :, x0] * (1 - fx) + stack[:, y0][:, :, x1] * fx
    low = stack[:, y1][:, :, x0] * (1 - fx) + stack[:, y1][:, :, x1] * fx
    return top * (1 - fy) + low * fy


def _blur(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), mode="edge")
    v = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return (v[:, :, :-2] + 2 * v[:, :, 1:-1] + v[:, :, 2:]) / 16


def describe(stack: np.ndarray) -> dict[str, np.ndarray]:
    """image, y, x, scale, angle and desc (bytes) of the corners of images (n, height, width)."""
    n, h, w = stack.shape
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("image", "y", "x", "scale", "angle", "desc")}
    for scale in SCALES:
        sh, sw = round(h * scale), round(w * scale)
        if min(sh, sw) <= 2 * MARGIN + 2:
            continue
        a = _blur(_blur(stack.astype(np.float32) if scale == 1 else resize(stack.astype(np.float32), sh, sw)))
        gy, gx = np.gradient(a, axis=1), np.gradient(a, axis=2)
        yy, xx, xy = _blur(_blur(gy * gy)), _blur(_blur(gx * gx)), _blur(_blur(gx * gy))
        r = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
        inner = r[:, MARGIN : sh - MARGIN, MARGIN : sw - MARGIN]
        top = (inner > 1e-3) & (inner >= FAINT * r.max(axis=(1, 2), keepdims=True))
        around = np.pad(r, ((0, 0), (SPACING, SPACING), (SPACING, SPACING)), mode="edge")
        for dy in range(-SPACING, SPACING + 1):
            for dx in range(-SPACING, SPACING + 1):
                if dy or dx:
                    other = around[:, MARGIN + SPACING + dy :, MARGIN + SPACING + dx :][:, : inner.shape[1], : inner.shape[2]]
                    top &= inner > other if (dy, dx) > (0, 0) else inner >= other
        i, y, x = np.nonzero(top)
        y, x = y + MARGIN, x + MARGIN
        wide = np.pad(a, ((0, 0), (RADIUS + 1, RADIUS + 1), (RADIUS + 1, RADIUS + 1)), mode="edge")
        of, row, column = i[:, None], y[:, None] + RADIUS + 1, x[:, None] + RADIUS + 1
        patch = wide[of, row + _DISC[:, 0], column + _DISC[:, 1]]
        angle = np.arctan2((patch * _DISC[:, 0]).sum(1), (patch * _DISC[:, 1]).sum(1))
        turn = np.rint(angle / (2 * np.pi / TURNS)).astype(int) % TURNS
        t = PATTERN[turn]
        bits = wide[of, row + t[..., 0], column + t[..., 1]] < wide[of, row + t[..., 2], column + t[..., 3]]
        for key, v in (("image", i), ("y", (y + 0.5) / scale), ("x", (x + 0.5) / scale), ("scale", np.full(len(i), 1 / scale)), ("angle", angle), ("desc", np.packbits(bits, axis=1))):
            found[key].append(v)
    if not found["image"]:
        return {k: np.empty((0, BITS // 8) if k == "desc" else 0, np.uint8 if k == "desc" else float) for k in found}
    return {k: np.concatenate(v) for k, v in found.items()}


def drawn(embeddings: DataFrame, side: int = 48) -> DataFrame:
    """media_id, width, height, pixels: each vector as a grey image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pixels = []
            for v in b.column(1).to_pylist():
                ok = v and all(x is not None and math.isfinite(x) for x in v)
                if not ok:
                    pixels.append(None)
                    continue
                a = np.array(v, np.float64)
                grid = math.ceil(math.sqrt(len(a)))
                a = np.pad(a, (0, grid * grid - len(a))).reshape(1, grid, grid)
                low, high = a.min(), a.max()
                a = resize((a - low) / (high - low or 1.0) * 255, side, side)
                pixels.append(np.rint(a).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([side] * b.num_rows, pa.int32()), pa.array([side] * b.num_rows, pa.int32()), pa.array(pixels, pa.binary())], names=["media_id", "width", "height", "pixels"])

    return embeddings.select(F.col("vec_id").cast("long").alias("media_id"), "embedding").mapInArrow(tidy(run), "media_id long, width int, height int, pixels binary")


CORNER = "cid long, corner int, y double, x double, scale double, angle double, desc binary"


def _corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shapes: dict[tuple[int, int], list[int]] = {}
        for i, (w, h) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            shapes.setdefault((h, w), []).append(i)
        cid, pixels = b.column(0).to_numpy(), b.column(3).to_pylist()
        for (h, w), rows in shapes.items():
            step = max(1, 800_000 // (h * w))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                got = describe(np.stack([np.frombuffer(pixels[i], np.uint8).reshape(h, w) for i in part]))
                image = got["image"].astype(int)
                place = (got["y"] // PLACE).astype(np.int32) * (w // PLACE + 1) + (got["x"] // PLACE).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[np.array(part)[image]] if len(image) else np.empty(0, np.int64)), pa.array(place.astype(np.int32)), *[pa.array(got[k].astype(np.float64)) for k in ("y", "x", "scale", "angle")], pa.array([d.tobytes() for d in got["desc"]], pa.binary())],
                    names=["cid", "corner", "y", "x", "scale", "angle", "desc"])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one after the other."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def _agreeing(pair: np.ndarray, corner: np.ndarray, zoom: np.ndarray, turn: np.ndarray, dy: np.ndarray, dx: np.ndarray, need: np.ndarray | int) -> np.ndarray:
    """Pairs with so many different corners as they need in one cell of the transforms. turn, dy and dx are in half cells: votes
    are counted in cells, twice a dimension so that neighbours over an edge meet as well; the cells of the turn close the circle."""
    linked = np.empty(0, np.int64)
    need = np.broadcast_to(need, pair.shape)
    for k in range(8):
        t, y, x = (turn + (k & 1)) // 2 % TURN_CELLS, (dy + (k >> 1 & 1)) // 2, (dx + (k >> 2)) // 2
        key, room = np.zeros(len(pair), np.int64), 1
        for v in (pair, zoom, t, y, x, corner):
            low, size = (int(v.min()), int(v.max()) - int(v.min()) + 1) if len(v) else (0, 1)
            if room * size >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
                room = len(key) + 1
            if v is corner:
                cells = size
            key, room = key * size + (v - low), room * size
        by = np.argsort(key)
        key = key[by]
        keep = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
        by, cell = by[keep], key[keep] // cells
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, np.int64)
        votes = np.diff(np.append(first, len(cell)))
        found = np.unique(pair[by[first[votes >= need[by[first]]]]])
        if len(found):
            linked = np.concatenate((linked, found))
            rest = ~np.isin(pair, found)
            pair, corner, zoom, turn, dy, dx, need = (v[rest] for v in (pair, corner, zoom, turn, dy, dx, need))
    return linked


class _Side:
    """Corners sorted by cid, with the order of each table's words."""

    def __init__(self, rows: dict[str, np.ndarray]):
        self.rows = rows
        self.orders = [np.argsort(rows["word"][:, k], kind="stable").astype(np.int32) for k in range(BANDS)]
        self.sorted = [rows["word"][o, k] for k, o in enumerate(self.orders)]
        self.ids, self.image, self.many = np.unique(rows["cid"], return_inverse=True, return_counts=True)


def _linked(left: dict[str, np.ndarray], right: dict[str, np.ndarray], consensus: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked classes (a, b) between corners of two sides, or within one side given twice. Rows are sorted by cid."""
    if not len(left["cid"]) or not len(right["cid"]):
        return
    side = _Side(right)
    edges = np.append(np.flatnonzero(np.concatenate(([True], left["cid"][1:] != left["cid"][:-1]))), len(left["cid"]))
    at = 0
    while at < len(edges) - 1:  # whole images of PART corners together
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + PART, "right")) - 1)
        yield from _part({k: v[edges[at] : edges[end]] for k, v in left.items()}, side, left is right, consensus)
        at = end


def _part(left: dict[str, np.ndarray], side: _Side, same: bool, consensus: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    right, orders, ids, image, many = side.rows, side.orders, side.ids, side.image, side.many
    low, count = np.empty((BANDS, len(left["cid"])), np.int64), np.empty((BANDS, len(left["cid"])), np.int64)
    for k, w in enumerate(side.sorted):
        low[k] = np.searchsorted(w, left["word"][:, k])
        count[k] = np.searchsorted(w, left["word"][:, k], "right") - low[k]
    total = np.concatenate(([0], np.cumsum(count.sum(axis=0))))
    starts = np.append(np.flatnonzero(np.concatenate(([True], left["cid"][1:] != left["cid"][:-1]))), len(left["cid"]))
    at = 0
    while at < len(starts) - 1:
        end = max(at + 1, int(np.searchsorted(total[starts], total[starts[at]] + ROOM, "right")) - 1)
        first, last = starts[at], starts[end]
        if end == at + 1 and total[last] - total[first] > ROOM and len(ids) > 1:
            one = {k: v[first:last] for k, v in left.items()}
            for half in (right["cid"] < ids[len(ids) // 2], right["cid"] >= ids[len(ids) // 2]):
                other = {k: v[half & (right["cid"] > one["cid"][0]) if same else half] for k, v in right.items()}
                yield from _linked(one, other, consensus)
            at = end
            continue
        names, own = np.unique(left["cid"][first:last], return_counts=True)
        votes: list[np.ndarray] = []
        row = first
        while row < last:
            stop = max(row + 1, int(np.searchsorted(total, total[row] + ROOM, "right")) - 1)
            stop = min(stop, last)
            for k, o in enumerate(orders):
                i, j = np.repeat(np.arange(row, stop), count[k, row:stop]), o[_ranges(low[k, row:stop], count[k, row:stop])]
                ok = left["cid"][i] < right["cid"][j] if same else left["cid"][i] != right["cid"][j]
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(left["desc"][i] ^ right["desc"][j]).sum(axis=1) <= NEAR
                for before in range(k):  # a pair counts in the first table that it meets in
                    ok &= left["word"][i, before] != right["word"][j, before]
                i, j = i[ok], j[ok]
                swap = left["cid"][i] > right["cid"][j]
                (y, v), (x, u), (s, z), (t, r), (n, m) = ((np.where(swap, right[c][j], left[c][i]), np.where(swap, left[c][i], right[c][j])) for c in ("y", "x", "scale", "angle", "corner"))
                turn, zoom = (r - t) % (2 * np.pi), np.log2(z / s)
                c, d = np.cos(turn) * z / s, np.sin(turn) * z / s
                half = lambda a, size: np.floor(a / size * 2).astype(np.int64)
                pair = np.searchsorted(names, left["cid"][i]) * len(ids) + image[j]
                votes.append(np.stack((pair, n, np.rint(zoom).astype(np.int64), half(turn, TURN_CELL), half(v - (d * x + c * y), SHIFT_CELL), half(u - (c * x - d * y), SHIFT_CELL))))
            row = stop
            if row < last:  # one pair of large images
                votes = [np.unique(np.concatenate(votes, axis=1), axis=1)]
        v = np.concatenate(votes, axis=1)
        v = v[:, (np.bincount(v[0]) >= consensus)[v[0]]] if v.shape[1] else v
        need = np.maximum(consensus, np.ceil(SHARE * np.minimum(own[v[0] // len(ids)], many[v[0] % len(ids)])).astype(np.int64))
        pair = _agreeing(*v, need)
        a, b = names[pair // len(ids)], ids[pair % len(ids)]
        yield np.minimum(a, b), np.maximum(a, b)
        at = end


def _bytes(descs: pa.Array) -> np.ndarray:
    edges = np.frombuffer(descs.buffers()[1], np.int32, len(descs) + 1, 4 * descs.offset)
    return np.frombuffer(descs.buffers()[2], np.uint8, edges[-1] - edges[0], edges[0]).reshape(len(descs), BITS // 8)


def _stars(ids: np.ndarray, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """cid, root and n of the classes that have links: the smallest class that is reached by them, and their number. Links are
    counted and joined as they come and never held together. ids are sorted."""
    root, n = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for a, b in links:
        u, v = np.searchsorted(ids, a), np.searchsorted(ids, b)
        n += np.bincount(u, minlength=len(ids)) + np.bincount(v, minlength=len(ids))
        root = hung(root, u, v)
    has = n > 0
    return pa.table({"cid": pa.array(ids[has], pa.int64()), "root": pa.array(ids[root[has]], pa.int64()), "n": pa.array(n[has], pa.int64())})


def _blocks(consensus: int, pairs: bool = True):
    """Links of one pair of blocks, or their stars; the corners of the pair are one table."""

    def run(t: pa.Table) -> pa.Table:
        low, high = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        block, cid = t.column("block").to_numpy(), t.column("cid").to_numpy()
        raw = np.concatenate([_bytes(c) for c in t.column("desc").chunks])

        def corners(of: int) -> dict[str, np.ndarray]:
            at = np.flatnonzero(block == of)
            at = at[np.argsort(cid[at], kind="stable")]
            desc = raw[at]
            rows = {c: t.column(c).to_numpy()[at] for c in ("cid", "corner", "y", "x", "scale", "angle")}
            return rows | {"desc": desc.view(np.uint64), "word": desc.view(f"u{BITS // 8 // BANDS}")}

        left = corners(low)
        right = left if low == high else corners(high)
        del raw
        if not pairs:
            return _stars(np.unique(cid), _linked(left, right, consensus))
        found = list(_linked(left, right, consensus))
        cat = lambda k: pa.array(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64), pa.int64())
        return pa.table({"a": cat(0), "b": cat(1)})

    return run


def _dealt(corners: DataFrame, block: int) -> GroupedData:
    n = corners.count()
    blocks = max(1, math.ceil(n / block), min(SPREAD, math.ceil(n / (block / 10))))
    rows = corners.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other")).drop("_other").groupBy("lo", "hi")


def linked(corners: DataFrame, consensus: int = CONSENSUS, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: classes of which consensus corners match in one transform, as many rows as there are links. corners is
    a written table."""
    return _dealt(corners, block).applyInArrow(_blocks(consensus), "a long, b long")


def stars(corners: DataFrame, consensus: int = CONSENSUS, block: int = BLOCK) -> DataFrame:
    """The same links as (cid, root, n): per pair of blocks one row for each class that has links between them, with the
    smallest class that they reach and their number. Edges cid-root give the components of all links, sums of n the degrees,
    and the rows grow with the classes of a group, not with their pairs. corners is a written table."""
    return _dealt(corners, block).applyInArrow(_blocks(consensus, pairs=False), "cid long, root long, n long")


def copies(spark: SparkSession, media: DataFrame, consensus: int = CONSENSUS) -> DataFrame:
    """media_id, class_id (smallest media_id of the images linked with it, itself included) and n_links (other
    classes of equal pixels that it is linked with directly) for each row of (media_id, width, height, pixels)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid = [None if m is None or not p or not w or not h or w * h != len(p) else xxhash.xxh64_intdigest(p + f"{w}x{h}".encode()) - (1 << 63) for m, w, h, p in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cid, pa.int64())], names=["media_id", "width", "height", "pixels", "cid"])

    with Scratch(spark, "media") as scratch, arrow_rows(spark, 1000):
        media = media.select(F.col("media_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "pixels")
        seen = media.mapInArrow(tidy(digest), "media_id long, width int, height int, pixels binary, cid long")
        marked = scratch.table(seen.select("media_id", "cid"), "marked")
        some = marked.where("cid IS NOT NULL")
        reps = some.groupBy("cid").agg(F.min("media_id").alias("rep"))
        copies_ = scratch.table(some.groupBy("cid").agg(F.count("*").alias("n"), F.min("media_id").alias("media_id")).where("n > 1").select("cid", "media_id"), "several")
        # images that stand once go on as they are; of the others, one row each
        single = seen.where("cid IS NOT NULL").join(copies_.select("cid"), "cid", "left_anti")
        one = seen.join(copies_, ["cid", "media_id"]).dropDuplicates(["cid"])
        one = single.select("cid", "width", "height", "pixels").unionByName(one.select("cid", "width", "height", "pixels"))
        corners = scratch.table(one.mapInArrow(tidy(_corners), CORNER), "corners")
        links = scratch.table(stars(corners, consensus), "links")
        parts = connected_components(links, scratch)
        degree = links.groupBy("cid").agg(F.sum("n").alias("n_links"))
        whole = reps.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
        of = whole.join(whole.groupBy("comp").agg(F.min("rep").alias("class_id")), "comp").join(degree, "cid", "left").select("cid", "class_id", "n_links")
        out = marked.select("media_id", "cid").join(of, "cid", "left")
        return scratch.keep(out.select("media_id", F.coalesce("class_id", "media_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(spark, drawn(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
