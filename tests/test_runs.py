"""Run tables against arrays of pixels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import runs as R
from folioflow.operators.raster import fill_polygon

W, H = 60, 40


def polygons(n=14, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.choice([3, 4, 5, 7])
        out.append((i % 2, i, rng.randrange(0, 4), [(rng.randint(-8, W + 8), rng.randint(-8, H + 8)) for _ in range(k)]))
    out += [(0, 90, 2, [(1, 1), (5, 5)]), (0, 91, 2, None), (1, 92, 3, [(4, 4), (20, 4), (20, 12), (4, 12)]), (1, 93, 1, [(3.5, 2.5), (9.25, 2.5), (9.25, 7.75), (3.5, 7.75)])]
    return out


def frame(spark, shapes):
    rows = [(p, i, label, None if ps is None else [{"x": float(x), "y": float(y)} for x, y in ps]) for p, i, label, ps in shapes]
    return spark.createDataFrame(rows, "page int, ord int, label int, points array<struct<x:double,y:double>>").repartition(3)


def pages(spark, n=2):
    return spark.createDataFrame([(p, W, H) for p in range(n)], "page int, width int, height int")


def painted(rows, w=W, h=H):
    img = np.zeros((h, w), int)
    for r in rows:
        assert r.x0 <= r.x1 and not img[r.y, r.x0 : r.x1 + 1].any()
        img[r.y, r.x0 : r.x1 + 1] = getattr(r, "label", 1)
    return img


def of(df, **key):
    for k, v in key.items():
        df = df.where(F.col(k) == v)
    return df.collect()


def image(seed, w=W, h=H, share=0.5):
    rng = np.random.default_rng(seed)
    return (rng.random((h, w)) < share).astype(int)


def as_runs(spark, images):
    rows = []
    for p, img in enumerate(images):
        for y, line in enumerate(img):
            x = 0
            while x < len(line):
                e = x
                while e + 1 < len(line) and line[e + 1] == line[x]:
                    e += 1
                if line[x]:
                    rows.append((p, int(line[x]), y, x, e))
                x = e + 1
    return spark.createDataFrame(rows, "page int, label int, y int, x0 int, x1 int").repartition(3)


def test_filled_equals_scan_lines(spark):
    got = R.clipped(R.filled(frame(spark, polygons()), ["page", "ord"]), pages(spark), ["page"]).collect()
    for p, i, _, ps in polygons():
        want = np.zeros((H, W), np.uint8)
        if ps and len(ps) > 2:
            fill_polygon(want, np.array(ps), 1)
        assert (painted([r for r in got if r.ord == i]) == want).all(), i
        assert not [r for r in got if r.ord == i and r.page != p]


def test_later_shapes_show(spark):
    shapes = polygons()
    runs = R.clipped(R.filled(frame(spark, shapes), ["page", "ord", "label"]), pages(spark), ["page"])
    shown = R.overdrawn(runs, ["page"], "ord")
    counts = {(r.page, r.label): r.n for r in R.label_counts(shown, pages(spark, 3), ["page"]).collect()}
    for p in (0, 1, 2):
        want = np.zeros((H, W), np.uint8)
        for q, _, label, ps in shapes:
            if q == p and ps and len(ps) > 2:
                fill_polygon(want, np.array(ps), label)
        assert (painted(of(shown, page=p)) == want).all()
        assert {k[1]: n for k, n in counts.items() if k[0] == p} == {int(v): int(n) for v, n in zip(*np.unique(want, return_counts=True), strict=True)}


def test_and_and_minus(spark):
    a, b = [image(1), image(2)], [image(3), image(4)]
    x, y = as_runs(spark, a), as_runs(spark, b)
    for p in (0, 1):
        assert (painted(of(R.both(x, y, ["page"]), page=p)) == a[p] * b[p]).all()
        assert (painted(of(R.without(x, y, ["page"]), page=p)) == a[p] * (1 - b[p])).all()
    assert (painted(of(R.without(x, y.where("false"), ["page"]), page=0)) == a[0]).all()


@pytest.mark.parametrize("scale", [0.25, 0.4, 0.5, 1.0, 1.5, 3.0])
def test_scaling_takes_the_nearest(spark, scale):
    img = image(5) * np.random.default_rng(1).integers(1, 4, (H, W))
    got, _ = R.scaled(as_runs(spark, [img]), pages(spark, 1), ["page"], scale)
    h, w = int(H * scale), int(W * scale)
    at = lambda n, most: np.minimum(((np.arange(n) + 0.5) / scale).astype(int), most - 1)
    assert (painted(of(got, page=0), w, h) == img[np.ix_(at(h, H), at(w, W))]).all()


@pytest.mark.parametrize(("size", "step"), [(16, 16), (16, 10), (7, 3), (64, 64)])
def test_tiles_hold_what_they_cover(spark, size, step):
    img = image(6) * 2
    pad = lambda d: (size - d) if d < size else (step - d % step) % step
    full = np.pad(img, ((0, pad(H)), (0, pad(W))), constant_values=9)
    runs, sizes = R.padded(as_runs(spark, [img]), pages(spark, 1), ["page"], F.lit(pad(W)), F.lit(pad(H)), 9)
    assert (painted(of(runs, page=0), full.shape[1], full.shape[0]) == full).all()
    got = R.tiled(runs, sizes, ["page"], size, step).collect()
    ny, nx = (full.shape[0] - size) // step + 1, (full.shape[1] - size) // step + 1
    assert {r.tile for r in got} <= set(range(ny * nx))
    for t in range(ny * nx):
        y, x = t // nx * step, t % nx * step
        assert (painted([r for r in got if r.tile == t], size, size) == full[y : y + size, x : x + size]).all()


def labelled(img):
    """The first pixel (by line) of what each pixel touches, corners included."""
    out, seen = {}, np.zeros(img.shape, bool)
    for y, x in np.argwhere(img):
        if not seen[y, x]:
            todo = [(y, x)]
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                out[a, b] = (y, x)
                for c in range(max(0, a - 1), min(img.shape[0], a + 2)):
                    for d in range(max(0, b - 1), min(img.shape[1], b + 2)):
                        if img[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
    return out


def spiral(n=30):
    img = np.zeros((n, n), int)
    y = x = 0
    dy, dx = 0, 1
    for _ in range(n * n):
        img[y, x] = 1
        a, b = y + 2 * dy, x + 2 * dx
        if not (0 <= y + dy < n and 0 <= x + dx < n) or (0 <= a < n and 0 <= b < n and img[a, b]):
            dy, dx = dx, -dy
            if not (0 <= y + dy < n and 0 <= x + dx < n) or img[y + dy, x + dx] or (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and img[y + 2 * dy, x + 2 * dx]):
                break
        y, x = y + dy, x + dx
    return img


def test_connected(spark):
    images = [image(7, share=0.35), image(8, share=0.6), spiral()]
    got = R.connected(as_runs(spark, images), ["page"]).collect()
    for p, img in enumerate(images):
        want = labelled(img)
        mine = [r for r in got if r.page == p]
        assert sum(r.x1 - r.x0 + 1 for r in mine) == img.sum()
        for r in mine:
            for x in range(r.x0, r.x1 + 1):
                assert (r.component.y, r.component.x0) == want[r.y, x]


def test_dilated(spark):
    img = image(9, share=0.1)
    got = R.dilated(as_runs(spark, [img]), ["page"], 2, 1, 1).collect()
    want = {(y + dy, x + dx) for y, x in np.argwhere(img) for dy in range(-2, 2) for dx in (-1, 0, 1)}
    assert {(r.y, x) for r in got for x in range(r.x0, r.x1 + 1)} == want


def test_stroked(spark):
    lines = [(0, 0, 1, [(5, 5), (20, 5), (20, 15)]), (0, 1, 1, [(0, 0), (9, 3)]), (0, 2, 1, [(7, 7), (7, 7)])]
    got = R.stroked(frame(spark, lines), ["page", "ord"], 3).collect()
    mine = {(r.y, x) for r in got if r.ord == 0 for x in range(r.x0, r.x1 + 1)}
    assert mine == {(y, x) for y in (4, 5, 6) for x in range(5, 21)} | {(y, x) for y in range(5, 16) for x in (19, 20, 21)}
    thin = R.stroked(frame(spark, lines), ["page", "ord"]).collect()
    assert {(r.y, x) for r in thin if r.ord == 1 for x in range(r.x0, r.x1 + 1)} == {(int(np.floor(i / 3 + 0.5)), i) for i in range(10)}
    assert [(r.y, r.x0, r.x1) for r in thin if r.ord == 2] == [(7, 7, 7)]


def test_nothing(spark):
    none = frame(spark, [])
    runs = R.filled(none, ["page", "ord", "label"])
    assert runs.count() == 0 and R.overdrawn(runs, ["page"], "ord").count() == 0 and R.stroked(none, ["page"]).count() == 0
    assert R.connected(runs, ["page"]).count() == 0
    assert [(r.label, r.n) for r in R.label_counts(R.overdrawn(runs, ["page"], "ord"), pages(spark, 1), ["page"]).collect()] == [(0, W * H)]
