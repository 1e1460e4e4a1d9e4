"""Shapes that are drawn a batch of pages at once, against arrays of pixels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_runs import H, W, frame, of, painted, polygons

from folioflow.operators import runs as R
from folioflow.operators import shapes as S
from folioflow.operators import spans
from folioflow.operators.raster import fill_polygon
from folioflow.plans import registry


def sized(df):
    return df.withColumns({"width": F.lit(W), "height": F.lit(H)})


def drawing(shapes, page):
    want = np.zeros((H, W), np.uint8)
    for p, _, label, ps in shapes:
        if p == page and ps and len(ps) > 2:
            fill_polygon(want, np.array(ps), label)
    return want


def test_drawn_equals_painting(spark):
    for shapes in (polygons(60, 4), polygons(3, 5)):
        got = R.rows(R.drawn(sized(frame(spark, shapes)), ["page"], "ord"), ["page"]).cache()
        for p in (0, 1):
            assert (painted(of(got, page=p)) == drawing(shapes, p)).all()


def test_runs_drawn_one_by_one_give_the_same(spark):
    shapes = frame(spark, polygons(40, 6))
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(R.rows(R.drawn(shapes, ["page"], "ord"), ["page"]))
    by_hand = R.overdrawn(R.filled(shapes, ["page", "ord", "label"]), ["page"], "ord")
    assert rows(by_hand.select("page", "label", "y", "x0", "x1")) == want
    assert list(spans.pieces(np.array([3, 3, 9, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 5)]


def test_deep_stacks_show_the_highest():
    rng = np.random.default_rng(2)
    line, x0 = rng.integers(0, 3, 400), rng.integers(2, 200, 400)
    x1, rank = x0 + rng.integers(-2, 150, 400), rng.permutation(400)
    want = np.full((3, 400), -1)
    for i in np.argsort(rank):
        want[line[i], x0[i] : x1[i] + 1] = i
    got = np.full((3, 400), -1)
    for i, a, b in zip(*spans.shown(line, x0, x1, rank), strict=True):
        assert a <= b and (got[line[i], a : b + 1] == -1).all()
        got[line[i], a : b + 1] = i
    assert (got == want).all()


#: Exchanges and windows of a query's plan: pages' shapes meet in one grouping. Each had more before.
PLANS = {"mask_polygons": (1, 1), "uncertain_polygons": (2, 2), "baseline_targets": (5, 4), "region_slices": (3, 3), "masked_pages": (2, 4)}


@pytest.mark.parametrize("name", PLANS)
def test_pages_meet_once(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange "), plan.count("Window [")) <= PLANS[name]
    assert plan.count("Window [") <= PLANS[name][1]


def test_parts_are_counted_without_a_window(spark):
    boxes = [(0, i, 1 + i % 2, [(2 + 6 * (i % 5), 2 + 6 * (i // 5)), (5 + 6 * (i % 5), 2 + 6 * (i // 5)), (5 + 6 * (i % 5), 5 + 6 * (i // 5)), (2 + 6 * (i % 5), 5 + 6 * (i // 5))]) for i in range(20)]
    found = S.mask_polygons(R.drawn(frame(spark, boxes), ["page"], "ord"), None, 1)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(r.label, r.part, r.maxy, r.maxx) for r in found.collect()]
    for label in (1, 2):
        mine = sorted(g[1:] for g in got if g[0] == label)
        assert [m[0] for m in mine] == list(range(10))
        assert [m[1:] for m in mine] == sorted((m[1:] for m in mine), reverse=True)


def test_slices_take_the_rest_of_their_box(spark):
    rng = np.random.default_rng(8)
    shapes = [(p, i, 1 + i % 4, [(int(x), int(y)) for x, y in zip(rng.integers(3, W - 3, 5), rng.integers(3, H - 3, 5), strict=True)]) for i in range(12) for p in (0, 1)]
    image = R.drawn(sized(frame(spark, shapes[:8])), ["page"], "ord")
    for given in (image, R.rows(image, ["page"])):
        got = {(r.page, r.ord): (r.n, r.background) for r in R.slices(given, frame(spark, shapes), ["page"], ["page", "ord"], 2).collect()}
        for p, i, _, ps in shapes:
            mask = np.zeros((H, W), np.uint8)
            fill_polygon(mask, np.array(ps), 1)
            ys, xs = np.nonzero(mask)
            if not len(ys):
                assert (p, i) not in got
                continue
            a, b, c, d = ys.min() - 2, ys.max() + 2, xs.min() - 2, xs.max() + 2
            page = np.pad(drawing(shapes[:8], p), 9)
            total = page[a + 9 : b + 10, c + 9 : d + 10].sum() - (drawing(shapes[:8], p) * mask.astype(int)).sum()
            assert got[p, i] == (mask.sum(), pytest.approx(total / ((b - a + 1) * (d - c + 1) - mask.sum())))


def test_targets_against_pixels(spark):
    """Lines that share pixels: the highest column counts, and no channel leaves the page."""
    at = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    pts = lambda ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    rows = [(0, 0, at(4, 4, 30, 14), [(4, 10), (30, 10)], at(4, 4, 30, 10), at(4, 10, 30, 14)), (0, 1, at(20, 2, 80, 14), [(20, 10), (80, 10)], at(20, 2, 80, 10), at(20, 10, 80, 12)), (1, 0, at(0, 0, 9, 9), [(0, 0), (9, 9)], at(0, 0, 9, 5), at(3, 5, 9, 9))]
    kind = "array<struct<x:double,y:double>>"
    lines = spark.createDataFrame([(p, i, *map(pts, c)) for p, i, *c in rows], f"page int, line int, points {kind}, baseline {kind}, ascender {kind}, descender {kind}")
    regions = spark.createDataFrame([(p, i, pts(c[0])) for p, i, *c in rows], f"page int, region int, points {kind}")
    pages = spark.createDataFrame([(0, W, H), (1, W, H), (2, 5, 4)], "page int, width int, height int")
    got = R.baseline_targets(lines, regions, regions.where("page = 1"), pages, ["page"]).collect()
    channel = lambda name, p: {(r.y, x): r.value for r in got if (r.channel, r.page) == (name, p) for x in range(r.x0, r.x1 + 1)}
    assert channel("baseline", 0) == {(10, x): 1 for x in range(4, W)}
    assert channel("ascender", 0) == {(10, x): 9 if x >= 20 else 7 for x in range(4, W)}
    assert channel("descender", 0) == {(10, x): 5 if x <= 30 else 3 for x in range(4, W)}
    assert channel("descender", 1) == {(i, i): 5 for i in range(3, 10)}
    limits = {(y, x) for x0, a, b in ((4, 4, 14), (30, 4, 14), (20, 2, 14)) for y in range(a, b + 1) for x in range(x0 - 1, x0 + 2)}
    assert set(channel("limiter", 0)) == limits
    assert channel("mask", 2) == {(y, x): 1 for y in range(4) for x in range(5)}
    assert set(channel("mask", 1)) == {(y, x) for y in range(H) for x in range(W)} - {(y, x) for y in range(10) for x in range(10)}


def test_batches_in_pieces_give_the_same(spark, monkeypatch):
    """Large batches are worked on in pieces; here every row is one."""
    from pyspark.sql.classic.dataframe import DataFrame

    held, whole = [], spans.pieces
    real = DataFrame.mapInArrow

    def noted(df, f, schema, *more):
        held.append((df, f))
        return real(df, f, schema, *more)

    monkeypatch.setattr(DataFrame, "mapInArrow", noted)
    shapes = sized(frame(spark, [(p + 2 * k, *r) for k in range(6) for p, *r in polygons(9, k)]))
    key = ["page", "ord", "label"]
    image = R.drawn(shapes, ["page"], "ord")
    lines = shapes.select("page", F.col("ord").alias("line"), *[F.col("points").alias(c) for c in ("points", "baseline", "ascender", "descender")])
    pages = spark.createDataFrame([(p, W, H) for p in range(12)], "page int, width int, height int")
    R.overdrawn(R.filled(shapes, key), ["page"], "ord")
    R.slices(image, shapes, ["page"], ["page", "ord"], 1)
    R.baseline_targets(lines, shapes.select("page", F.col("ord").alias("region"), "points"), shapes.select("page", F.col("ord").alias("region"), "points"), pages, ["page"])
    S.mask_polygons(image, [0.8], 3)
    S.uncertain_polygons(R.drawn(shapes.withColumn("label", F.lit(1)), ["page"], "ord"))
    made = [(f, df.toArrow().combine_chunks().to_batches()) for df, f in held]
    assert len(made) >= 8 and all(len(b) for _, b in made)
    for f, batches in made:
        rows = lambda: [str(r) for b in f(iter(batches)) for r in b.to_pylist()]
        monkeypatch.setattr(spans, "pieces", whole)
        want = rows()
        monkeypatch.setattr(spans, "pieces", lambda cost: ((i, i + 1) for i in range(len(cost))))
        assert rows() == want and want
