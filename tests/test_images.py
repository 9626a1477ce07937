"""Perceptual comparison of pictures against a pixel-by-pixel version."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import compare


def seen(p):
    r, g, b, a = p
    return (r, g, b) if a == 255 else tuple(255 + (c - 255) * (a / 255) for c in (r, g, b))


def luma(p):
    r, g, b = seen(p)
    return r * 0.29889531 + g * 0.58662247 + b * 0.11448223


def distance(p, q):
    (r, g, b), (s, t, u) = seen(p), seen(q)
    y = luma(p) - luma(q)
    i = (r * 0.59597799 - g * 0.27417610 - b * 0.32180189) - (s * 0.59597799 - t * 0.27417610 - u * 0.32180189)
    k = (r * 0.21147017 - g * 0.52261711 + b * 0.31114694) - (s * 0.21147017 - t * 0.52261711 + u * 0.31114694)
    return 0.5053 * y * y + 0.299 * i * i + 0.1957 * k * k


def near(img, x, y):
    return [(a, b) for a in (x - 1, x, x + 1) for b in (y - 1, y, y + 1) if (a, b) != (x, y) and (a, b) in img]


def flat(img, x, y):
    around = near(img, x, y)
    return (len(around) < 8) + sum(img[n] == img[x, y] for n in around) > 2


def smoothed(img, other, x, y):
    around = near(img, x, y)
    deltas = [(0 if img[n] == img[x, y] else luma(img[x, y]) - luma(img[n]), n) for n in around]
    if (len(around) < 8) + sum(d == 0 for d, _ in deltas) > 2:
        return False
    low, high = min(deltas, key=lambda d: d[0]), max(deltas, key=lambda d: d[0])
    if low[0] >= 0 or high[0] <= 0:
        return False
    return any(flat(img, *n) and flat(other, *n) for n in (low[1], high[1]))


def brute(want, have, threshold):
    n = 0
    for p in want:
        if p in have and distance(want[p], have[p]) > 35215 * threshold * threshold and not (smoothed(want, have, *p) or smoothed(have, want, *p)):
            n += 1
    return n


def picture(rng, w, h, kind):
    out = {}
    for x in range(w):
        for y in range(h):
            if kind == "noise":
                out[x, y] = tuple(rng.randrange(0, 256, 17) for _ in range(3)) + (rng.choice([255, 255, 128, 0]),)
            else:
                t = int(255 * min(1, max(0, (x - w / 2) + (y - h / 2) * kind[0] + kind[1])))
                out[x, y] = (t, t, t // 2, 255)
    return out


def frame(spark, pictures):
    rows = [(i, x, y, *c) for i, img in pictures.items() for (x, y), c in img.items()]
    return spark.createDataFrame(rows, "image_id long, px int, py int, r int, g int, b int, a int")


@pytest.mark.parametrize("tile", [4, 5, 64])
def test_mismatch_against_brute_force(spark, tile):
    rng, want, have = random.Random(4), {}, {}
    for i in range(12):
        w, h = rng.choice([(13, 9), (1, 7), (6, 1), (20, 20), (2, 2)])
        if i % 2:
            want[i], have[i] = picture(rng, w, h, "noise"), picture(rng, w, h, "noise")
            for p in rng.sample(sorted(want[i]), len(want[i]) // 2):
                have[i][p] = want[i][p]
        else:
            slope = rng.choice([0.25, -0.5, 1.5, 0])
            want[i], have[i] = picture(rng, w, h, (slope, 0)), picture(rng, w, h, (slope, rng.choice([0.25, 0.75, 2])))
    got = {r.image_id: r for r in compare.image_mismatch(frame(spark, want), frame(spark, have), ["image_id"], tile=tile).collect()}
    plain = {r.image_id: r for r in compare.image_mismatch(frame(spark, want), frame(spark, have), ["image_id"], tile=tile, smoothing=False).collect()}
    forgiven = 0
    for i in want:
        n = brute(want[i], have[i], 0.1)
        assert (got[i].n_rows, got[i].n_mismatched, got[i].n_unmatched, got[i].absent) == (len(want[i]), n, 0, False), i
        assert got[i].ratio == n / len(want[i])
        forgiven += plain[i].n_mismatched - n
    assert forgiven > 0


def test_sizes_and_absent_pictures(spark):
    rng = random.Random(1)
    img = picture(rng, 6, 6, "noise")
    want = {1: img, 2: img, 3: img}
    have = {1: {p: c for p, c in img.items() if p[0] < 5}, 2: img, 4: img}
    got = {r.image_id: (r.n_rows, r.n_mismatched, r.n_unmatched, r.absent, r.ratio) for r in compare.image_mismatch(frame(spark, want), frame(spark, have), ["image_id"]).collect()}
    assert got == {1: (36, 0, 6, False, 1.0), 2: (36, 0, 0, False, 0.0), 3: (36, 0, 36, True, 1.0), 4: (36, 0, 36, True, 1.0)}
    empty = frame(spark, want).limit(0)
    assert compare.image_mismatch(empty, empty, ["image_id"]).count() == 0
    odd = frame(spark, {1: img}).withColumn("px", F.lit(None).cast("int"))
    assert compare.image_mismatch(odd, odd, ["image_id"]).count() == 0
    with pytest.raises(ValueError):
        compare.image_mismatch(empty, empty, ["image_id"], threshold=2)
