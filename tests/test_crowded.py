"""Crowded pages: the grid join, matching in rounds, and edit distances."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import matching as A
from folioflow.operators import metrics as M

SCHEMA = "page int, ord int, minx int, miny int, maxx int, maxy int"


def boxes(n, seed, span=400, page=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = rng.randint(-20, span), rng.randint(-20, span), rng.randint(1, 30), rng.randint(1, 12)
        out.append((page, i, x, y, x + w, y + h))
    return [*out, (page, n, -50, -50, span + 90, span + 90)]


def test_pairs_of_a_grid_are_all_pairs(spark, monkeypatch):
    a, b = (spark.createDataFrame(boxes(150, s) + boxes(5, s + 9, page=2), SCHEMA) for s in (1, 2))
    plain = sorted(map(tuple, A.pairs(a, b, ["page"]).collect()))
    monkeypatch.setattr(A, "CROWD", 100)
    assert A.crowded(a, b, ["page"]).select("page").collect() == [(1,)]
    got = A.pairs(a, b, ["page"]).collect()
    assert sorted(map(tuple, got)) == plain and len(got) > 200


def test_a_crowded_page_tests_few_pairs(spark, monkeypatch):
    n = 20_000
    x, y = F.pmod(F.xxhash64("id"), F.lit(8000)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(8000)).cast("int")
    side = lambda d: spark.range(n).select(F.lit(1).alias("page"), F.col("id").cast("int").alias("ord"), (x + d).alias("minx"), y.alias("miny"), (x + d + 40).alias("maxx"), (y + 12).alias("maxy"))
    tested = []
    whole = A._met
    monkeypatch.setattr(A, "_met", lambda both, by: tested.append(both) or whole(both, by))
    got = A.pairs(side(0), side(5), ["page"])
    assert got.where("p = g").count() == n
    assert tested[-1].count() < 0.01 * n * n


@pytest.mark.parametrize("threshold", [0.0, 0.3])
def test_rounds_equal_the_fold(spark, monkeypatch, threshold):
    rng = random.Random(4)
    rows = [(p, i, j, rng.choice([0.1, 0.25, 0.3, 0.5, rng.random()])) for p in range(3) for i in range(40) for j in range(40) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "page int, p int, g int, iou double").repartition(3)
    want = sorted(map(tuple, A.matched(df, ["page"], threshold).collect()))
    monkeypatch.setattr(A, "FOLD", 600)
    mixed = sorted(map(tuple, A.matched(df, ["page"], threshold).collect()))
    monkeypatch.setattr(A, "FOLD", 0)
    assert sorted(map(tuple, A.matched(df, ["page"], threshold).collect())) == mixed == want
    assert A.matched(df.where("false"), ["page"]).count() == 0


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_edit_distances(spark):
    rng = random.Random(1)
    rows = [("", ""), ("", "abc"), ("é" * 40, "e" * 41)]
    for _ in range(80):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 200)))
        b = list(a)
        for _ in range(rng.choice([0, 1, 3, 6, 40, 300])):
            k, at = rng.randrange(3), rng.randrange(len(b) + 1)
            if k == 0:
                b.insert(at, rng.choice("xyz"))
            elif at < len(b):
                b[at : at + 1] = [] if k == 1 else ["q"]
        rows.append((a, "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", M.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [distance(a, b) for a, b in rows]
