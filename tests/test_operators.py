import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import matching, metrics, models, raster, splits, text_export
from folioflow.operators import reading_order as order
from folioflow.operators import regions as R

BOXES = "page int, ord int, label int, minx int, miny int, maxx int, maxy int"


def positions(df):
    return {r.ord: r.position for r in df.collect()}


def test_columns_read_left_to_right(spark):
    rows = [(1, 0, 3, 1000, 0, 1900, 100), (1, 1, 3, 0, 500, 900, 600), (1, 2, 3, 0, 0, 900, 100), (1, 3, 6, 940, 0, 960, 900), (1, 4, 3, 1000, 300, 1900, 400)]
    assert positions(order.reading_order(spark.createDataFrame(rows, BOXES))) == {2: 0, 1: 1, 3: 2, 0: 3, 4: 4}


def test_global_divider_splits_the_page(spark):
    rows = [(1, 0, 3, 0, 600, 900, 700), (1, 1, 3, 1000, 0, 1900, 100), (1, 2, 3, 0, 0, 900, 100), (1, 3, 7, 0, 300, 1900, 320), (1, 4, 3, 1000, 500, 1900, 550)]
    assert positions(order.reading_order(spark.createDataFrame(rows, BOXES))) == {2: 0, 1: 1, 3: 2, 0: 3, 4: 4}


def test_local_divider(spark):
    # a divider over the two left columns of three: what is above it and beside it comes first
    rows = [(1, 0, 3, 0, 0, 900, 100), (1, 1, 3, 1000, 0, 1900, 100), (1, 2, 7, 0, 300, 1900, 310), (1, 3, 3, 0, 400, 900, 500), (1, 4, 3, 1000, 400, 1900, 500), (1, 5, 3, 2000, 0, 2900, 500)]
    assert positions(order.reading_order(spark.createDataFrame(rows, BOXES))) == {0: 0, 1: 1, 5: 2, 2: 3, 3: 4, 4: 5}


def test_order_is_a_permutation(spark):
    rng = random.Random(5)
    rows = []
    for p in range(60):
        for i in range(rng.randint(1, 25)):
            x, y = rng.choice([0, 1000, 2000, 3000]) + rng.randint(0, 30), rng.randint(0, 4000)
            label = rng.randint(1, 9)
            w = rng.choice([1000, 2000, 4000]) if label in (4, 7) else 20 if label == 6 else 950
            rows.append((p, i, label, x, y, x + w, y + rng.randint(10, 400)))
    got = order.reading_order(spark.createDataFrame(rows, BOXES)).groupBy("page").agg(F.sort_array(F.collect_list("position")).alias("p"))
    n = {p: sum(r[0] == p for r in rows) for p in range(60)}
    assert {r.page: r.p for r in got.collect()} == {p: list(range(k)) for p, k in n.items()}


def test_line_order(spark):
    rows = [(1, 1, i, x, 400, x + 200, y) for i, (x, y) in enumerate([(500, 50.0), (0, 90.0), (0, 10.0), (510, 20.0)])]
    df = spark.createDataFrame(rows, "page int, region int, ord int, minx int, width int, cx int, cy double")
    assert positions(order.line_order(df)) == {2: 0, 1: 1, 3: 2, 0: 3}


def greedy(pairs, threshold):
    out, p_used, g_used = [], set(), set()
    for iou, p, g in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
        if iou >= threshold and p not in p_used and g not in g_used:
            out.append((p, g))
            p_used.add(p)
            g_used.add(g)
    return sorted(out)


def test_matching_is_greedy(spark):
    rng = random.Random(2)
    rows = [(page, p, g, rng.choice([0.2, 0.5, 0.5, 0.7, 0.9])) for page in range(40) for p in range(6) for g in range(5) if rng.random() < 0.6]
    got = matching.matched(spark.createDataFrame(rows, "page int, p int, g int, iou double"), ["page"], 0.5).collect()
    for page in range(40):
        assert sorted((r.p, r.g) for r in got if r.page == page) == greedy([(i, p, g) for q, p, g, i in rows if q == page], 0.5)


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, 0, 3, 0, 0, 10, 10)], BOXES)
    none = some.where("false")
    a = matching.counted(some, none, ["page"], 0.5).first()
    assert (a.tp, a.fp, a.fn, a.precision, a.recall) == (0, 1, 0, 0, 1)
    b = matching.counted(none, some, ["page"], 0.5).first()
    assert (b.tp, b.fn, b.precision, b.recall) == (0, 1, 1, 0)
    assert {(r.p, r.g) for r in matching.aligned(some, none, ["page"]).collect()} == {(0, None)}
    assert matching.compared(some, some).where("label is null").first().f1 == 1


def test_error_rates(spark):
    rows = [("ſtraße", "strasse"), ("", ""), ("abc", "abc"), ("abcd", "")]
    r = metrics.error_rates(spark.createDataFrame(rows, "truth string, read string"), []).first()
    assert (r.n_lines, r.n_scored, r.distance, r.length) == (4, 3, 7, 14)
    assert abs(r.line_score - (1 - (3 / 7 + 1) / 4)) < 1e-12 and r.char_ratio == 0.5  # all lines divide the sum
    empty = metrics.error_rates(spark.createDataFrame([], "truth string, read string"), []).first()
    assert empty.line_score == 0 and empty.char_ratio == 0


def test_absent_class_is_nan(spark):
    m = metrics.class_metrics(spark.createDataFrame([(0, 0, 5), (1, 0, 5)], "target int, pred int, n long"), 3)
    r = {x.label: x for x in m.collect()}
    assert r[0].csi == 0.5 and r[1].recall == 0 and r[2].csi != r[2].csi
    o = metrics.overall(m).first()
    assert o.accuracy == 0.5 and o.stop_score == 0.25 + 1 + 1


def test_splits(spark):
    df = spark.range(30).select(F.format_string("page_%02d", "id").alias("page_id"))
    out = splits.split_exact(df, "page_id", (0.5, 0.3, 0.2))
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"Training": 15, "Validation": 9, "Test": 6}
    with pytest.raises(ValueError):
        splits.split_exact(df, "page_id", (0.5, 0.5, 0.5))
    a, b = splits.sample(df, "page_id", 7)
    assert (a.count(), b.count(), a.join(b, "page_id").count()) == (7, 23, 0)
    assert splits.missing(df, a, "page_id") and not splits.missing(a, df, "page_id")


def test_orders_above_nine_are_numbers(spark):
    df = spark.createDataFrame([(1, i, f"readingOrder {{index:{k};}}") for i, k in enumerate([10, 9, 2])] + [(1, 3, "")], "page int, ord int, custom string")
    assert positions(text_export.ordered(df, ["page"])) == {2: 0, 1: 1, 0: 2}
    assert positions(text_export.ordered(df, ["page"], as_text=True)) == {0: 0, 2: 1, 1: 2}


def test_last_result_wins(spark):
    lines = spark.createDataFrame([(1, "a", "old"), (1, "b", "old")], "page int, line_id string, text string")
    res = spark.createDataFrame([(1, "a", 0, "x"), (1, "a", 1, " y ")], "page int, line_id string, ord int, text string")
    assert {r.line_id: r.text for r in text_export.attach_by_id(lines, res).collect()} == {"a": "y", "b": None}


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, 'say "x"; y')], "path string, region int, text string")
    text_export.write_csv(df.coalesce(1), str(tmp_path / "out"))
    body = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert body == '"path";"region";"text"\n"p";1;"say ""x""; y"\n'


def test_tiles_and_padding(spark):
    df = spark.createDataFrame([(1, 100, 101), (2, 10, 500)], "page int, width int, height int")
    got = [(r.page, r.y, r.x) for r in raster.tiles(df, 50).orderBy("page", "tile").collect()]
    assert got == [(1, 0, 0), (1, 0, 50), (1, 50, 0), (1, 50, 50)]
    pads = [tuple(r) for r in df.select(raster.padding(F.col("width"), 50), raster.padding(F.col("height"), 50)).collect()]
    assert pads == [(0, 49), (40, 0)]


def test_drawing_order(spark):
    shape = lambda label, x: (label, [{"x": x, "y": 1}, {"x": x + 3, "y": 1}, {"x": x + 3, "y": 3}, {"x": x, "y": 3}])
    df = spark.createDataFrame([(1, 8, 5, [shape(2, 0), shape(3, 2)])], "page int, width int, height int, shapes array<struct<label:int,points:array<struct<x:int,y:int>>>>")
    img = raster.drawn(df).first().raster
    assert list(img[8:16]) == [2, 2, 3, 3, 3, 3, 0, 0] and sum(img[:8]) == 0 and sum(img[32:]) == 0


def test_model_boundary(spark):
    df = spark.createDataFrame([(1, [0.1, 0.9]), (2, [0.4, 0.3]), (3, [])], "id int, score array<double>")
    out = {r.id: (r.label, r.status) for r in models.predicted(df, "threshold", "id int, score array<double>, label double").collect()}
    assert out[1] == (1, "done") and out[2] == (0, "done") and out[3] == (None, "failed")
    with pytest.raises(KeyError):
        models.predicted(df, "none", "id int")


def test_numbering_by_label_groups(spark):
    rows = [(1, i, label, 0, 0, 1, 1) for i, label in enumerate([3, 1, 8, 0, 3])]
    got = {r.ord: r.id for r in R.numbered(spark.createDataFrame(rows, BOXES)).collect()}
    assert got == {1: 0, 2: 1, 0: 2, 4: 3}
