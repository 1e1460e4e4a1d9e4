import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute_shapes import outlines

from folioflow.operators import matching, raster, runs, shapes, splits
from folioflow.sources import pagexml

GRID = st.tuples(st.integers(0, 12), st.integers(0, 12))
SHAPE = "array<struct<x:double,y:double>>"


def pts(rows):
    return [{"x": float(x), "y": float(y)} for x, y in rows]


def rasters(spark, img):
    img = np.array(img, np.uint8)
    return spark.createDataFrame([(1, img.shape[1], img.shape[0], bytearray(img.tobytes()))], "page int, width int, height int, raster binary")


@settings(max_examples=200, deadline=None)
@given(st.lists(GRID, min_size=3, max_size=7), st.lists(GRID, min_size=3, max_size=7))
def test_areas_add_up(a, b):
    a, b = np.array(a, float), np.array(b, float)
    own, other, both = shapes.areas(a, b)
    assert shapes.areas(b, a) == pytest.approx((other, own, both))
    assert shapes.areas(a, a)[2] == pytest.approx(own)
    assert -1e-9 <= both <= min(own, other) + 1e-9
    parts = [np.array([(x, -1), (x + w, -1), (x + w, 13), (x, 13)], float) for x, w in ((-1, 6.5), (5.5, 7.5))]
    assert sum(shapes.areas(a, p)[2] for p in parts) == pytest.approx(own)  # two halves of the plane share it


def test_areas_of_known_shapes():
    cross = np.array([(0, 0), (4, 4), (4, 0), (0, 4)], float)  # crosses itself: two triangles
    assert shapes.areas(cross, np.array([(0, 0), (2, 0), (2, 4), (0, 4)], float)) == pytest.approx((8, 8, 4))
    line = np.array([(0, 0), (4, 4), (2, 2)], float)
    assert shapes.areas(line, cross) == pytest.approx((0, 8, 0))


def test_polygon_pairs(spark):
    schema = f"page int, ord int, points {SHAPE}"
    a = spark.createDataFrame([(1, 0, pts([(0, 0), (4, 0), (0, 4)])), (1, 1, pts([(9, 9), (8, 8)])), (2, 0, None)], schema)
    b = spark.createDataFrame([(1, 0, pts([(0, 0), (4, 0), (4, 4), (0, 4)])), (1, 1, pts([(4, 4), (4, 3), (3, 4)]))], schema)
    got = shapes.polygon_pairs(a, b, ["page"]).collect()
    assert [(r.page, r.p, r.g, r.iou) for r in got] == [(1, 0, 0, pytest.approx(0.5))]  # the boxes of 0 and 1 overlap, the shapes do not


@settings(max_examples=200, deadline=None)
@given(st.lists(GRID, min_size=1, max_size=12))
def test_hull_holds_all_points(rows):
    h = shapes.hull(np.array(rows, float))
    assert {tuple(p) for p in h} <= {(float(x), float(y)) for x, y in rows}
    if len(h) > 2:
        d = np.roll(h, -1, 0) - h
        for x, y in rows:
            turn = d[:, 0] * (y - h[:, 1]) - d[:, 1] * (x - h[:, 0])
            assert (turn >= 0).all()
        assert (d[:, 0] * np.roll(d, -1, 0)[:, 1] > d[:, 1] * np.roll(d, -1, 0)[:, 0]).all()  # every corner bends


def test_hulls_by_page(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 4, 0), (1, 4, 4), (1, 2, 1), (1, 4, 4), (2, 5, 5), (2, None, 5)], "page int, x int, y int")
    got = {r.page: [(p.x, p.y) for p in r.hull] for r in shapes.hulls(df, ["page"]).collect()}
    assert got == {1: [(0, 0), (4, 0), (4, 4)], 2: [(5, 5)]}


def test_split_at_the_baseline(spark):
    box = pts([(10, 0), (30, 0), (30, 12), (10, 12)])
    rows = [(0, box, pts([(12, 8), (20, 10), (28, 8)])), (1, box, pts([(12, 50), (28, 50)])), (2, None, pts([(1, 1), (2, 2)])), (3, box, pts([(12, 8)]))]
    df = spark.createDataFrame(rows, f"line int, points {SHAPE}, baseline {SHAPE}")
    got = {r.line: r for r in shapes.split_lines(df, ["line"]).collect()}
    up, down = (np.array([(p.x, p.y) for p in x]) for x in (got[0].ascender, got[0].descender))
    assert shapes.areas(up, down) == pytest.approx((20 * 8 + 16, 20 * 4 - 16, 0))
    assert all(got[i].ascender is None and got[i].descender is None for i in (1, 2, 3))


def marks(spark, img):
    return runs.of_rasters(rasters(spark, img))


def test_outlines_run_between_pixels(spark):
    img = [[2, 0, 0, 0], [0, 2, 2, 2], [0, 2, 0, 2], [0, 2, 2, 2]]
    got = shapes.mask_polygons(marks(spark, img), None, 1).orderBy("part").collect()
    assert [(r.label, len(r.points), r.minx, r.miny, r.maxx, r.maxy) for r in got] == [(2, 12, 0.5, 0.5, 3.5, 3.5), (2, 4, 1.5, 1.5, 2.5, 2.5), (2, 4, -0.5, -0.5, 0.5, 0.5)]
    assert [(p.x, p.y) for p in got[2].points] == [(0, 0.5), (-0.5, 0), (0, -0.5), (0.5, 0)]
    assert shapes.mask_polygons(marks(spark, img), None, 2).count() == 1  # the sum of the sides must be over the limit
    assert shapes.mask_polygons(marks(spark, np.zeros((3, 3))), None, 0).count() == 0


def test_simplified_outlines(spark):
    got = shapes.mask_polygons(marks(spark, np.ones((6, 9))), [0.8], 1).first()
    assert [(p.x, p.y) for p in got.points] == [(8, 5.5), (0, 5.5), (-0.5, 0), (8, -0.5)]
    ring = np.array([(0, 0), (5, 1), (10, 0), (10, 10), (0, 10)], float)
    assert len(shapes.simplified(ring, 0.9)) == 5 and len(shapes.simplified(ring, 1.0)) == 4  # equality goes


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=6, max_size=6), min_size=1, max_size=6))
def test_outlines_enclose_the_mask(rows):
    m = np.array(rows)
    total = 0.0
    for r in outlines(m):
        q = np.roll(r, -1, 0)
        total += (r[:, 0] * q[:, 1] - q[:, 0] * r[:, 1]).sum() / 2
    # squares of pixel centres: what a pattern of corners marks of its square
    p = np.pad(m, 1).astype(int)
    n = p[:-1, :-1] + p[1:, :-1] + p[:-1, 1:] + p[1:, 1:]
    facing = (n == 2) & (p[:-1, :-1] == p[1:, 1:])
    assert total == pytest.approx(np.select([facing, n == 1, n == 2, n == 3, n == 4], [0.25, 0.125, 0.5, 0.875, 1.0]).sum())


def test_borders_of_marks_and_holes(spark):
    img = np.zeros((9, 11))
    img[1:8, 1:10] = 1
    img[3:6, 3:8] = 0
    img[4, 4:7] = 1  # a mark inside the hole
    img[0, 0] = 1
    got = sorted((r.label, len(r.points), r.minx, r.miny, r.maxx, r.maxy) for r in shapes.uncertain_polygons(marks(spark, img)).collect())
    assert got == [(1, 6, 0, 0, 9, 7), (2, 8, 2, 2, 8, 6)]  # the outer border comes by (1, 1) twice; the mark inside is a run of two ends: three corners at most


def test_page_border(spark):
    shape = lambda label, x0, y0, x1, y1: (label, [{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    df = spark.createDataFrame([(1, 200, 150, [shape(3, 40, 40, 90, 80), shape(2, 120, 60, 150, 100), shape(0, 0, 0, 9, 9)]), (2, 20, 20, [])], "page int, width int, height int, shapes array<struct<label:int,points:array<struct<x:int,y:int>>>>")
    got = {r.page: r for r in raster.drawn(df, border=True).collect()}
    img = np.frombuffer(got[1].raster, np.uint8).reshape(150, 200)
    assert img[5, 5] == 0 and img[5, 20] == 255 and img[60, 60] == 3 and img[80, 130] == 2 and img[140, 100] == 255
    corners = shapes.hull(np.array([(40, 40), (90, 40), (90, 80), (40, 80), (120, 60), (150, 60), (150, 100), (120, 100)]))
    ends, (y, x) = np.roll(corners, -1, 0), np.indices((150, 200))
    at = np.stack([x, y], -1).astype(float)
    inside, near = np.ones((150, 200), bool), np.full((150, 200), np.inf)
    for p, q in zip(corners, ends, strict=True):
        d = q - p
        inside &= d[0] * (y - p[1]) - d[1] * (x - p[0]) >= 0
        t = np.clip(((at - p) @ d) / (d @ d), 0, 1)
        near = np.minimum(near, np.hypot(*np.moveaxis(at - p - t[..., None] * d, -1, 0)))
    far = ~inside & (near > 3)  # 2 % of 150
    far[:10, :10] = False
    assert ((img == 255) == far).all()
    assert set(got[2].raster) == {0}


def test_baselines(spark):
    rows = [(1, 0, 0, x, 5 + x % 2, 3.0, -1.0) for x in range(40)] + [(1, 0, 0, 3, 9, 3.0, -1.0)]
    rows += [(1, 0, 1, 7 - 50, y, 1.0, 2.0) for y in range(6)] + [(1, 0, 2, x, 1, 1.0, 1.0) for x in range(5)]
    df = spark.createDataFrame(rows, "page int, region int, component int, x int, y int, up double, down double")
    got = {r.component: r for r in shapes.baselines(df, ["page", "region", "component"], 2.0).collect()}
    assert set(got) == {0, 1}  # five pixels are too few
    assert [(p.x, p.y) for p in got[0].points] == [(-4, 10), (26, 12), (52, 10), (82, 12)]
    assert (got[0].up, got[0].down, got[0].position) == (6, 0, 1)
    assert [(p.x, p.y) for p in got[1].points] == [(-90, 0), (-82, 0)] and got[1].position == 0  # upright: both ends of one x


def test_texts_of_matched_lines(spark):
    schema = "page int, ord int, minx int, miny int, maxx int, maxy int, text string"
    pred = spark.createDataFrame([(1, 0, 0, 0, 10, 10, "a"), (1, 1, 50, 0, 60, 10, "b")], schema)
    truth = spark.createDataFrame([(1, 0, 1, 0, 11, 10, "x"), (1, 1, 90, 0, 99, 10, "y"), (2, 0, 0, 0, 1, 1, None)], schema)
    got = sorted((r.page, r.truth, r.read) for r in matching.matched_texts(pred, truth, ["page"]).collect())
    assert got == [(1, "", "b"), (1, "x", "a"), (1, "y", ""), (2, "", "")]


def test_sizes_that_differ(spark):
    a = spark.createDataFrame([(1, 5, 5), (2, 5, 6), (3, 1, 1)], "page int, width int, height int")
    b = spark.createDataFrame([(1, 5, 5), (2, 5, 7)], "page int, width int, height int")
    assert [tuple(r) for r in splits.mismatched(a, b, "page").collect()] == [(2, 5, 6, 5, 7)]


def test_predicted_lines_and_new_order(spark):
    lines = spark.createDataFrame([("p", "r1", 0, [(0, 0), (5, 0), (5, 5)], [(0, 4), (5, 4)])], "page_id string, region_id string, position int, points array<struct<x:int,y:int>>, baseline array<struct<x:int,y:int>>")
    regions = spark.createDataFrame([("p", "r1", 0, "paragraph", [(0, 0), (9, 0), (9, 9)]), ("p", "r2", 1, "heading", [(0, 0), (9, 0), (9, 9)]), ("p", "r3", 2, "heading", [(0, 0), (9, 0), (9, 9)])], "page_id string, region_id string, position int, class string, points array<struct<x:int,y:int>>")
    order = spark.createDataFrame([("p", "r1", 1), ("p", "r2", 0)], "page_id string, region_id string, position int")
    pages = spark.createDataFrame([("p", "p.jpg", 10, 10)], "page_id string, image_filename string, width int, height int")
    xml = pagexml.page_xml(pages, pagexml.reordered(regions, order), pagexml.predicted_lines(lines)).first().xml
    assert 'TextLine id="r1_tl_0"' in xml and "r3" not in xml
    assert xml.index('id="r2"') < xml.index('id="r1"')
