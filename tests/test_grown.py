"""What must not grow faster than the tables: the plans and helpers of queries over many lines and regions."""

import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions import tokens as T
from folioflow.operators import matching, metrics, paged, shapes
from folioflow.operators import reading_order as order
from folioflow.plans import views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vocabulary_makes_no_row_for_each_character(spark):
    rows = [(3, 0, "cab"), (2, 1, "xb"), (2, 0, None), (1, 4, ""), (1, 3, "b\U0001f600b"), (None, 7, "zz")]
    got = metrics.vocabulary(spark.createDataFrame(rows, "page int, line int, text string").repartition(3), "text", ["page", "line"])
    assert [(r.char, r.n, r["rank"]) for r in got.orderBy("rank").collect()] == [("z", 2, 1), ("b", 4, 2), ("\U0001f600", 1, 3), ("x", 1, 4), ("c", 1, 5), ("a", 1, 6)]
    assert "Generate" not in plan(got)


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


TEXT = st.text("abcé\U0001f600", max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=6), st.lists(st.tuples(TEXT, st.integers(0, 12), st.integers(0, 12), st.text("abxyz", max_size=3)), max_size=6))
def test_bounds_that_meet_are_the_distance(pairs, changed):
    pairs = pairs + [(t, t[:i] + new + t[i + k :]) for t, i, k, new in changed]
    want = [table_distance(a, b) for a, b in pairs]
    a, b = (pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1))
    assert all(x in (-1, d) for x, d in zip(metrics.bounded_distances(a, b), want, strict=True))
    assert [metrics.bit_distance(x, y) for x, y in pairs] == want


def test_long_lines_fill_no_table(spark):
    g = "the quick line eis " * 3000
    rows = [(g, g.translate(str.maketrans("eis", "cl5"))), (g, g[:-1]), (g, g[1:] + "e"), (g, None), ("", "ab"), ("abc", "cab")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    began = time.perf_counter()
    got = [r.d for r in df.select(metrics.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [sum(g.count(c) for c in "eis"), 1, 2, None, 2, 2]
    assert time.perf_counter() - began < 10  # tables of 3e9 cells for each of the first three took far longer


def test_page_quality_settles_replaced_and_cut_lines_by_bounds():
    g = ["many letters, see this line is", "", "cut at its end", "moved"]
    o = ["many lcttcr5, 5cc thl5 llnc l5", "", "cut at its en", "ovedm"]
    assert list(metrics.bounded_distances(pa.array(g), pa.array(o))) == [table_distance(g[0], o[0]), 0, 1, -1]


def test_page_quality_compares_lines_side_by_side_in_little_memory():
    g = ["many letters, see this line is one of many in a text", "cut at its end, as the third of all lines are, or the fifth"] * 10000
    o = [g[0].translate(str.maketrans("eis", "cl5")), g[1][:-1]] * 10000
    a, b = pa.array(["é", *g], pa.string()).slice(1), pa.array(o, pa.large_string())
    tracemalloc.start()
    try:
        got = metrics.bounded_distances(a, b)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.tolist() == [sum(g[0].count(c) for c in "eis"), 1] * 10000
    assert peak < 30 * sum(map(len, g))  # bytes for each character: 90 before, when places were gathered one by one
    assert [c.tolist() for c in T.narrow_points(pa.array(["xx", None, "aé", "", "\U0001f600"]).slice(1))] == [[97, 233, 0x1F600], [0, 2, 2, 3]]
    assert [c.tolist() for c in T.narrow_points(pa.array([None, "", None], pa.large_string()))] == [[], [0, 0, 0]]


def test_characters_are_coded_in_batches(spark):
    letters = T.alphabet(128, ["ſ", "é"])
    rows = [(1, "aſ😀", [1, 101, 132, 2, 3, 101]), (2, None, None), (3, "", []), (4, "é" * 5, [3]), (5, "z", [9, -1, None, 999, 105, 0, 106])]
    df = spark.createDataFrame(rows, "k int, t string, ids array<int>").coalesce(1)
    got = df.select("k", T.tokenise(F.col("t"), 128, ["ſ", "é"]).alias("ids"), T.detokenise(F.col("ids"), letters).alias("text"), T.detokenise(F.col("ids"), letters, True).alias("every"))
    want = [(1, [1, 101, 132, 2, 3], "aſ", "aſ<NAN>"), (2, None, None, None), (3, [1, 3], "", ""), (4, [1, *[133] * 5, 3], "", ""), (5, [1, 126, 3], "ef", "e" + letters[0] + "f")]
    assert sorted(map(tuple, got.collect())) == want
    assert "lambdafunction" not in plan(got) and T._decoded(pa.array([[1, 101, 3]] * 9), letters, [], 4).to_pylist() == ["a"] * 9


def test_areas_of_many_pairs_at_once():
    rng = np.random.default_rng(1)
    of = lambda: [rng.integers(0, 9, (rng.integers(0, 7), 2)).astype(float) for _ in range(300)]
    a, b = of(), of()
    flat = lambda x: (np.concatenate(x), np.array([len(p) for p in x]))
    got = shapes.pair_areas(flat(a), flat(b), 400)
    assert np.allclose(got, [shapes.areas(x, y) for x, y in zip(a, b, strict=True)])
    many = [np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)] * 20000
    began = time.perf_counter()
    assert (shapes.pair_areas(flat(many), flat(many)) == 16).all()
    assert time.perf_counter() - began < 1.5  # one pair at a time took more than three seconds


def test_lines_of_all_kinds_are_split_in_one_batch(spark):
    box, wedge = [(0, 0), (10, 0), (10, 6), (0, 6)], [(0, 0), (12, 0), (6, 9)]
    rows = [(0, box, [(1, 4), (9, 4)]), (1, wedge, [(2, 3), (5, 3), (7, 3)]), (2, box, [(1, 40), (9, 40)]), (3, box, None), (4, box[:2], [(1, 4), (9, 4)]), (5, wedge, [(2, 3), (9, 3)]), (6, box, [(1, 2), (9, 2)])]
    point = "array<struct<x:double,y:double>>"
    rows = [(i, *[None if x is None else [(float(a), float(b)) for a, b in x] for x in r]) for i, *r in rows]
    df = spark.createDataFrame(rows, f"line int, points {point}, baseline {point}").coalesce(1)
    got = {r.line: (r.a, r.d) for r in shapes.split_lines(df, ["line"]).select("line", G.area(F.col("ascender")).alias("a"), G.area(F.col("descender")).alias("d")).collect()}
    assert got == {0: (40, 20), 1: (30, 24), 2: (None, None), 3: (None, None), 4: (None, None), 5: (30, 24), 6: (20, 40)}
    many, lines = np.tile(np.array(box, float), (20000, 1, 1)), np.tile(np.array([(1, 4), (9, 4)], float), (20000, 1, 1))
    began = time.perf_counter()
    assert shapes.splits_at(many, lines)[0].all()
    assert time.perf_counter() - began < 1  # one line at a time took more than two seconds


def test_lines_with_texts_are_dealt_out_by_page_only(spark):
    schema = "page int, ord int, minx int, miny int, maxx int, maxy int, text string"
    truth = [(1, 0, 0, 0, 10, 10, "a"), (1, 1, 0, 20, 10, 30, None), (1, 2, 50, 50, 60, 60, "c"), (2, 0, 0, 0, 5, 5, "d")]
    pred = [(1, 0, 0, 21, 10, 30, "B"), (1, 1, 1, 0, 10, 10, "A"), (1, 2, 90, 90, 95, 95, "X"), (1, 3, 96, 96, 99, 99, None), (3, 0, 0, 0, 5, 5, "Y")]
    side = lambda rows: spark.createDataFrame(rows, schema).repartition(4, "page")
    got = matching.matched_texts(side(pred), side(truth), ["page"])
    assert sorted(map(tuple, got.collect())) == [(1, "", ""), (1, "", "B"), (1, "", "X"), (1, "a", "A"), (1, "c", ""), (2, "d", ""), (3, "", "Y")]
    assert set(re.findall(r"hashpartitioning\((.*?)\)", plan(got).replace("#", ""))) <= {x for x in re.findall(r"hashpartitioning\((page\d+, 4)\)", plan(got).replace("#", ""))}


def test_reading_order_deals_pages_once_into_tasks_of_bounded_size(spark, monkeypatch):
    assert [paged.tasks(n, 48) for n in (0, 3_600_000, 36_000_000, 216_000_000)] == [48, 48, 144, 864]
    schema = "page int, ord int, label int, minx int, miny int, maxx int, maxy int"
    rows = [(p, i, 7 if i == 2 else 3, 0, 100 * i, 500, 100 * i + 40) for p in range(5) for i in (3, 0, 2, 1, 4)]
    got = order.reading_order(spark.createDataFrame(rows, schema).repartition(3))
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert sorted((r.page, r.position, r.ord) for r in got.collect()) == [(p, i, i) for p in range(5) for i in range(5)]
    monkeypatch.setattr(paged, "TASK_ROWS", 1000)
    assert views.regions(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 6  # 6,000 rows; shuffle.partitions (4) before
