"""Links of images against all pairs of corners."""

from collections import defaultdict

import numpy as np

from facetmill.llm import media
from facetmill.sources.scratch import arrow_rows

MEDIA = "media_id long, width int, height int, pixels binary"


def image(rng, size=64, grain=12):
    return media.resize(rng.uniform(20, 200, (1, grain, grain)), size, size)[0]


def row(i, a):
    a = np.clip(np.rint(a), 0, 255).astype(np.uint8)
    return (i, a.shape[1], a.shape[0], bytearray(a.tobytes()))


def corners_of(images):
    out = []
    for c, a in enumerate(images):
        got = media.describe(np.clip(np.rint(a), 0, 255).astype(np.uint8)[None])
        out += [(c, k, *(float(got[f][k]) for f in ("y", "x", "scale", "angle")), bytearray(got["desc"][k].tobytes())) for k in range(len(got["y"]))]
    return out


def all_pairs(corners, consensus=media.CONSENSUS):
    """Links by comparing every corner with every other one, one vote at a time."""
    step = media.BITS // 8 // media.BANDS
    votes = defaultdict(set)
    for a in corners:
        for b in corners:
            if a[0] >= b[0] or not any(a[6][i : i + step] == b[6][i : i + step] for i in range(0, media.BITS // 8, step)):
                continue
            if bin(int.from_bytes(a[6], "big") ^ int.from_bytes(b[6], "big")).count("1") > media.NEAR:
                continue
            turn, s = (b[5] - a[5]) % (2 * np.pi), b[4] / a[4]
            c, d = np.cos(turn) * s, np.sin(turn) * s
            dy, dx = b[2] - (d * a[3] + c * a[2]), b[3] - (c * a[3] - d * a[2])
            for t in (0, 0.5):
                for y in (0, 0.5):
                    for x in (0, 0.5):
                        cell = (round(np.log2(s)), t, int(turn / media.TURN_CELL + t) % 12, y, np.floor(dy / media.SHIFT_CELL + y), x, np.floor(dx / media.SHIFT_CELL + x))
                        votes[a[0], b[0], cell].add(a[1])
    return {(a, b) for (a, b, _), v in votes.items() if len(v) >= consensus}


def edits(seed, n=5, k=5):
    rng = np.random.default_rng(seed)
    images = []
    for _ in range(n):
        a = image(rng)
        images += [a[i : 64 - i // 2, i // 2 :] * (1 - i / 20) + rng.normal(0, 2, a.shape)[i : 64 - i // 2, i // 2 :] for i in range(k)]
    return images


def test_many_copies_are_all_linked(spark):
    a = image(np.random.default_rng(1))
    rows = [row(i, a + i) for i in range(40)]  # equal descriptors: every word is shared by 40 corners at least
    got = media.copies(spark, spark.createDataFrame(rows, MEDIA)).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {39}


def test_links_equal_all_pairs(spark, monkeypatch):
    corners = corners_of(edits(2))
    want = all_pairs(corners)
    assert len(want) > 20
    df = spark.createDataFrame(corners, media.CORNER)
    for block in (10**6, 150):
        assert {(r.a, r.b) for r in media.linked(df, block=block).collect()} == want
    side = media.pa.table({f: [c[i] for c in corners] for i, f in enumerate(("cid", "corner", "y", "x", "scale", "angle"))} | {"desc": [bytes(c[6]) for c in corners], "block": [0] * len(corners), "lo": [0] * len(corners), "hi": [0] * len(corners)})
    for room in (10**6, 500, 20):
        monkeypatch.setattr(media, "ROOM", room)
        got = media._blocks(media.CONSENSUS)(side)
        assert set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == want


def test_small_turns_of_both_signs_agree():
    turn = np.array([0.02, 0.01, -0.02, -0.01]) % (2 * np.pi)
    same = np.zeros(4, np.int64)
    found = media._agreeing(same, np.arange(4), same, np.floor(turn / media.TURN_CELL * 2).astype(np.int64), same, same, 4)
    assert found.tolist() == [0]


def test_links_do_not_depend_on_batches(spark, monkeypatch):
    df = spark.createDataFrame([row(i, a) for i, a in enumerate(edits(3))], MEDIA)
    found = []
    for n in (1000, 3):
        monkeypatch.setattr(media, "arrow_rows", lambda spark, rows, n=n: arrow_rows(spark, n))
        found.append(sorted(tuple(r) for r in media.copies(spark, df).collect()))
    assert found[0] == found[1] and any(r[2] for r in found[0])


def test_near_copies_leave_a_task_once_an_image(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("links are written as pairs")

    a, n = image(np.random.default_rng(1)), 60
    images = [a + i for i in range(n)] + edits(2)
    corners = spark.createDataFrame(corners_of(images), media.CORNER)
    for block in (10**6, 2000):
        pairs = [tuple(r) for r in media.linked(corners, block=block).collect()]
        assert len(pairs) > n * (n - 1) // 2
        degree = np.bincount(np.array(pairs).ravel(), minlength=len(images))
        rows = media.stars(corners, block=block).collect()
        blocks = max(1, -(-corners.count() // block), min(media.SPREAD, -(-corners.count() * 10 // block)))
        assert len(rows) <= blocks * (degree > 0).sum() < len(pairs)
        assert all(r.root <= r.cid for r in rows)
        got = defaultdict(int)
        for r in rows:
            got[r.cid] += r.n
        assert dict(got) == {i: d for i, d in enumerate(degree.tolist()) if d}
        assert parts_of([(r.cid, r.root) for r in rows], len(images)) == parts_of(pairs, len(images))
    monkeypatch.setattr(media, "linked", never)
    out = media.copies(spark, spark.createDataFrame([row(i, x) for i, x in enumerate(images)], MEDIA)).collect()
    assert {r.class_id for r in out if r.media_id < n} == {0} and {r.n_links for r in out if r.media_id < n} == {n - 1}


def parts_of(edges, n):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label
