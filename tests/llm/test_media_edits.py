"""Planted crops and edits: recall per edit, and no links between different images."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from facetmill.llm import media

MEDIA = "media_id long, width int, height int, pixels binary, cid long, corner int"
SIZE, IMAGES = 112, 25


def image(rng):
    a = sum(w * media.resize(rng.normal(size=(1, g, g)), SIZE, SIZE)[0] for g, w in ((5, 1.0), (10, 0.8), (20, 0.6), (40, 0.4)))
    return (a - a.min()) / (a.max() - a.min()) * 255


def edits(a, rng):
    at, n = SIZE // 7, int(SIZE * 0.7)
    crop = a[at : at + n, at // 2 : at // 2 + n]
    larger, smaller = int(n * rng.uniform(1.1, 1.6)), int(SIZE * rng.uniform(0.7, 0.95))
    return {
        "crop": crop, "half": a[: SIZE // 2], "enlarged": media.resize(crop[None], larger, larger)[0], "scaled": media.resize(a[None], smaller, smaller)[0],
        "contrast": a * 0.8 + 20, "noise": a + rng.normal(0, 4, a.shape), "turned": np.rot90(a), "caption": np.where(np.arange(SIZE)[:, None] > SIZE * 0.85, 255, a),
    }


def row(i, a):
    a = np.clip(np.rint(a), 0, 255).astype(np.uint8)
    return (i, a.shape[1], a.shape[0], bytearray(a.tobytes()), 7, 7)


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(11)
    rows, of = [], {}
    for k in range(IMAGES):
        a = image(rng)
        for j, (name, x) in enumerate({"original": a, **edits(a, rng)}.items()):
            of[k * 100 + j] = (k, name)
            rows.append(row(k * 100 + j, x))
    got = {r.media_id: r.class_id for r in media.copies(spark, spark.createDataFrame(rows, MEDIA)).collect()}
    return of, got


def test_recall_of_each_edit(classes):
    of, got = classes
    hit = Counter(name for i, (k, name) in of.items() if got[i] == k * 100)
    assert all(n >= 0.9 * IMAGES for n in hit.values()), hit


def test_different_images_are_not_linked(classes):
    of, got = classes
    inside = defaultdict(set)
    for i, (k, _) in of.items():
        inside[got[i]].add(k)
    assert all(len(v) == 1 for v in inside.values())


def test_corners_grow_with_the_area():
    rng = np.random.default_rng(3)
    small = media.resize(rng.normal(size=(1, 40, 40)), 100, 100)[0]
    large = media.resize(rng.normal(size=(1, 160, 160)), 400, 400)[0]
    n = [len(media.describe(np.clip((a - a.min()) / np.ptp(a) * 255, 0, 255).astype(np.uint8)[None])["y"]) for a in (small, large)]
    assert n[1] > 8 * n[0] > 0


def test_null_and_empty_images(spark):
    rows = [(1, None, None, None, 0, 0), (None, 2, 2, bytearray(4), 0, 0), (3, 0, 0, bytearray(), 0, 0), (4, 5, 5, bytearray(25), 0, 0), (4, 5, 5, bytearray(25), 0, 0), (5, 5, 5, bytearray(25), 0, 0)]
    df = spark.createDataFrame(rows, MEDIA)
    got = sorted((r.media_id or 0, r.class_id or 0, r.n_links) for r in media.copies(spark, df).collect())
    assert got == [(0, 0, 0), (1, 1, 0), (3, 3, 0), (4, 4, 0), (4, 4, 0), (5, 4, 0)]
    assert media.copies(spark, df.limit(0)).count() == 0
