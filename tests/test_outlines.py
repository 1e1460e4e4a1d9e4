"""Outlines of run tables against outlines followed pixel by pixel."""

import numpy as np
from brute_shapes import borders, outlines
from test_runs import as_runs, spiral

from folioflow.operators import outlines as O


def masks():
    rng = np.random.default_rng(3)
    out = [(rng.random((14, 17)) < p).astype(int) for p in (0.2, 0.5, 0.8)]
    ring = np.zeros((9, 9), int)
    ring[1:8, 1:8] = 1
    ring[3:6, 3:6] = 0
    diagonal = np.eye(6, dtype=int)
    return [*out, ring, diagonal, np.ones((3, 4), int), np.array([[1]]), spiral(16), np.zeros((3, 3), int)]


def turned(p):
    """A closed outline from its lowest, then rightmost point on."""
    p = [tuple(map(float, x)) for x in p]
    k = max(range(len(p)), key=lambda i: (p[i][1], p[i][0]))
    return tuple(p[k:] + p[:k])


def test_outlines(spark):
    got = O.outlines(as_runs(spark, masks()), ["page", "label"]).collect()
    for i, m in enumerate(masks()):
        mine = sorted(tuple((q.x, q.y) for q in r.points) for r in got if r.page == i)
        assert mine == sorted(tuple(map(tuple, p.tolist())) for p in outlines(m == 1)), i


def test_borders(spark):
    got = O.borders(as_runs(spark, masks()), ["page", "label"]).collect()
    for i, m in enumerate(masks()):
        mine = sorted((r.outer, sorted((q.x, q.y) for q in r.points), len(r.points)) for r in got if r.page == i and len(r.points) > 3)
        want = sorted((bool(o), sorted(tuple(map(float, x)) for x in p), len(p)) for o, p in borders(m == 1) if len(p) > 3)
        assert mine == want, i
