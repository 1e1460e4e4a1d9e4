"""Outlines of run tables as rows: border edges, the rings that they close, and each ring's points in order.

A border edge lies between a pixel of a label and one without it, directed so that the label is to its right: along the
top of a run from left to right, down its right end, along its bottom from right to left, up its left end. Top and
bottom edges are what a run does not share with the line above or below, so a straight side is one edge. An edge's
successor begins where it ends; where two begin, pixels that touch at a corner only are told apart or kept together.
A raster's runs are one row of a grouping, which needs no shuffle where they lie by raster; a batch of rasters becomes
edges, rings and points in numpy at once. Places along a ring come from list ranking: each round doubles the distance
that an edge knows to the ring's start, so rounds go with the logarithm of the longest ring and nothing follows an
outline step by step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import spans
from .runs import packed, touching, unpacked
from .spans import spread

TOP, RIGHT, BOTTOM, LEFT = range(4)


def _free(page: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of united runs, what none of the line above, and none of the line below, covers: run, first and last x."""
    lower, upper = touching(page, y, x0, x1, 0)

    def rest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """i ascends, and j with it in each i. A run's pieces begin with it and after each run beside it, and end before the next or with it."""
        own, k = np.arange(len(y)), np.arange(len(i))
        many = np.cumsum(np.bincount(i, minlength=len(y)))
        run, first, last = (np.empty(len(y) + len(i), np.int64) for _ in range(3))
        first[own + np.r_[0, many][:-1]], first[i + k + 1] = x0, x1[j] + 1
        last[i + k], last[own + many] = x0[j] - 1, x1
        run[own + many], run[i + k] = own, i
        some = first <= last
        return run[some], first[some], last[some]

    order = np.argsort(upper, kind="stable")
    return rest(lower, upper), rest(upper[order], lower[order])


def _edges(page: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> dict[str, np.ndarray]:
    """page, side, y, x0, x1 (the pixels along the edge), where it starts and ends (sx, sy, ex, ey), and its first half-way point (px, py; the lowest, then rightmost comes first in the order)."""
    (ti, ta, tb), (bi, ba, bb) = _free(page, y, x0, x1)
    own = np.arange(len(y))
    run = np.concatenate([ti, own, bi, own])
    side = np.repeat([TOP, RIGHT, BOTTOM, LEFT], [len(ti), len(own), len(bi), len(own)])
    a, b = np.concatenate([ta, x1, ba, x0]), np.concatenate([tb, x1, bb, x0])
    page, y = page[run], y[run]
    ends = np.cumsum([len(ti), len(own), len(bi)])

    def pick(*of: np.ndarray) -> np.ndarray:
        return np.concatenate([c[s] for c, s in zip(of, np.split(np.arange(len(run)), ends), strict=True)])

    e = {"page": page, "side": side, "y": y, "x0": a, "x1": b}
    e |= {"sx": pick(a, b + 1, b + 1, a), "sy": pick(y, y, y + 1, y + 1), "ex": pick(b + 1, b + 1, a, a), "ey": pick(y, y + 1, y + 1, y)}
    e |= {"px": pick(2 * a, 2 * a + 1, 2 * b, 2 * a - 1), "py": 2 * y + np.array([-1, 0, 1, 0])[side]}
    order = np.argsort(spans.coded(page, -e["py"], -e["px"]), kind="stable")
    return {k: v[order] for k, v in e.items()}


def _rings(e: dict[str, np.ndarray], together: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each edge its ring (the number of the ring's first edge), and how many pixels along the ring lie before it.

    together: whether pixels that touch at a corner only belong to one outline.
    """
    n = len(e["y"])
    code = spans.coded(np.concatenate([e["page"], e["page"]]), np.concatenate([e["sy"], e["ey"]]), np.concatenate([e["sx"], e["ex"]]))
    begin, end = code[:n], code[n:]
    order = np.argsort(begin, kind="stable")
    lo = np.searchsorted(begin[order], end, "left")
    # one edge begins in a corner, or two where pixels touch at it only
    hi = np.minimum(lo + 1, n - 1)
    one, two = order[lo], order[np.where(begin[order[hi]] == end, hi, lo)]
    first = np.where(e["side"] == BOTTOM, e["x1"], e["x0"])
    last = np.where(e["side"] == TOP, e["x1"], e["x0"])
    same = (last == first[one]) & (e["y"] == e["y"][one])
    after = np.where(same != together, one, two)
    ring, jump = np.arange(n), after
    while True:
        least = np.minimum(ring, ring[jump])
        if (least == ring).all():
            break
        ring, jump = least, jump[jump]
    back = np.empty(n, np.int64)
    back[after] = np.arange(n)
    length = e["x1"] - e["x0"] + 1
    start = ring == np.arange(n)
    before = np.where(start, 0, length[back])
    back = np.where(start, np.arange(n), back)
    while (back != ring).any():
        before, back = before + before[back], back[back]
    return ring, before


def _points(e: dict[str, np.ndarray], ring: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edge, x and y of a pixel for each place along the rings, by ring and place."""
    length = e["x1"] - e["x0"] + 1
    order = np.argsort(spans.coded(ring, before), kind="stable")
    i, step = spread(np.zeros(len(order), np.int64), length[order])
    i = order[i]
    x = np.where(e["side"][i] == BOTTOM, e["x1"][i] - step, e["x0"][i] + step)
    return i, x, e["y"][i]


def _neighbours(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of points that lie by ring, the place of the one before and of the one after each, round the ring."""
    n = np.arange(len(ring))
    new = np.r_[True, ring[1:] != ring[:-1]] if len(ring) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(ring)) - 1
    was, will = n - 1, n + 1
    was[starts], will[ends] = ends, starts
    return was, will


def _turned(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An order in which each ring begins with its lowest, then rightmost point (the first of them) and goes on from there."""
    n = np.arange(len(ring))
    new = np.r_[True, ring[1:] != ring[:-1]] if len(ring) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(ring)))
    if not len(starts):
        return n
    group = np.cumsum(new) - 1
    low = y == np.maximum.reduceat(y, starts)[group]
    right = np.where(low, x, -np.inf)
    best = np.minimum.reduceat(np.where(low & (right == np.maximum.reduceat(right, starts)[group]), n, len(n)), starts)
    return starts[group] + (n - starts[group] + (best - starts)[group]) % sizes[group]


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """b in slices whose outlines have a bounded number of points."""
    sizes = spans.counts(b.column("r"))
    _, x0, x1 = (c.to_numpy(zero_copy_only=False) for c in b.column("r").flatten().flatten())
    for i, j in spans.pieces(np.bincount(np.repeat(np.arange(len(sizes)), sizes), x1 - x0 + 2.0, len(sizes))):
        yield b.slice(i, j - i)


def _closed(b: pa.RecordBatch, made: Callable[..., tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...] | None:
    """Of each ring of b its row, py and px of its first edge, whether it is outer, and where its points begin (and the last end); and all points' x and y."""
    page, _, y, x0, x1 = unpacked(b.column("r"))
    at, x0, x1 = spans.united(spans.coded(page, y), x0, x1)
    if not len(at):
        return None
    e = _edges(page[at], y[at], x0, x1)
    ring, x, y, outer = made(e)
    starts = np.flatnonzero(spans.stretches(ring))
    first = ring[starts]
    return e["page"][first], e["py"][first], e["px"][first], outer[first], np.append(starts, len(ring)), x, y


def _lists(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> pa.Array:
    points = pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in (x, y)], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), points)


def _gathered(runs: DataFrame, by: list[str], made: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """by and a row for each ring: ring (py and px of its first edge, negative), points, and outer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (c for batch in batches for c in _pieces(batch)):
            if (found := _closed(b, made)) is None:
                continue
            page, py, px, outer, at, x, y = found
            keys = b.select(by).take(pa.array(page))
            key = pa.StructArray.from_arrays([pa.array(-c, pa.int64()) for c in (py, px)], names=["py", "px"])
            yield pa.RecordBatch.from_arrays([*keys.columns, key, pa.array(outer), _lists(x, y, at)], names=[*by, "ring", "outer", "points"])

    kinds = dict(runs.dtypes)
    return packed(runs, by).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", ring struct<py:bigint,px:bigint>, outer boolean, points array<struct<x:double,y:double>>")


def _numbered(runs: DataFrame, by: list[str], made: Callable[..., tuple[np.ndarray, ...]], corners: int, least: float | None, change: Callable[..., tuple[np.ndarray, ...]] | None, split: bool) -> DataFrame:
    """by, outer, part, points, minx, miny, maxx, maxy of rings with more than `corners` points, whose box's sides sum to more than `least`.

    A raster's rings are together in one row, so part, which counts them from the lowest, then rightmost first point on
    (with split, outer ones apart from holes), needs no window over all of them. change(labels, x, y, where points
    begin) gives other points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (c for batch in batches for c in _pieces(batch)):
            if (found := _closed(b, made)) is None:
                continue
            page, py, px, outer, at, x, y = found
            if change:
                x, y, at = change(b.column(by[-1]).take(pa.array(page)).to_pylist(), x, y, at)
            box = [f.reduceat(v, at[:-1]) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))]
            keep = np.diff(at) > corners
            if least is not None:
                keep &= box[2] - box[0] + box[3] - box[1] > least
            group = page * 2 + (~outer if split else 0)
            some = np.flatnonzero(keep)
            some = some[np.lexsort((-px[some], -py[some], -x[at[some]], -y[at[some]], group[some]))]
            starts = np.flatnonzero(spans.stretches(group[some]))
            part = np.arange(len(some)) - np.repeat(starts, np.diff(np.append(starts, len(some))))
            keys = b.select(by).take(pa.array(page[some]))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(outer[some]), pa.array(part, pa.int32()), _lists(x, y, at).take(pa.array(some)), *[pa.array(c[some]) for c in box]], names=[*by, "outer", "part", "points", "minx", "miny", "maxx", "maxy"])

    kinds = dict(runs.dtypes)
    return packed(runs, by).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", outer boolean, part int, points array<struct<x:double,y:double>>, minx double, miny double, maxx double, maxy double")


def _outer(e: dict[str, np.ndarray]) -> np.ndarray:
    """Whether a ring that begins with this edge, its lowest, is an outer one: the edge lies below its pixel; around a hole it lies above."""
    return 2 * e["y"] < e["py"]


def _half_way(e: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Points half way between a label's pixels and the others; pixels that touch at a corner only are apart."""
    ring, before = _rings(e, False)
    i, x, y = _points(e, ring, before)
    side = e["side"][i]
    x = x + np.array([0.0, 0.5, 0.0, -0.5])[side]
    y = y + np.array([-0.5, 0.0, 0.5, 0.0])[side]
    at = _turned(ring[i], x, y)
    return ring[i][at], x[at], y[at], _outer(e)


def _border(e: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Border pixels of what is connected, corners included, without those inside straight runs."""
    ring, before = _rings(e, True)
    i, x, y = _points(e, ring, before)
    r = ring[i]
    place = np.r_[True, r[1:] != r[:-1]]

    def keep(some: np.ndarray) -> None:
        nonlocal r, x, y, place
        r, x, y, place = r[some], x[some], y[some], place[some]

    equal = lambda at: (x[at] == x) & (y[at] == y)
    keep(~equal(_neighbours(r)[0]) | place)
    was, will = _neighbours(r)
    keep(~equal(was) | equal(will))  # the first pixel may equal the last, which came round to it
    was, will = _neighbours(r)
    keep((x[will] - x != x - x[was]) | (y[will] - y != y - y[was]))
    at = _turned(r, x, y)
    return r[at], x[at].astype(float), y[at].astype(float), _outer(e)


def outlines(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, ring, points: closed outlines half way between a label's pixels and the others; pixels that touch at a corner only are apart. by ends with the label."""
    return _gathered(runs, by, _half_way).drop("outer")


def borders(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, ring, outer, points: the border pixels of what is connected, corners included, without those inside straight runs. outer is false around a hole."""
    return _gathered(runs, by, _border)


def outline_parts(runs: DataFrame, by: list[str], corners: int, least: float, change: Callable[..., tuple[np.ndarray, ...]] | None = None) -> DataFrame:
    """outlines with part and boxes, as `_numbered` tells."""
    return _numbered(runs, by, _half_way, corners, least, change, False).drop("outer")


def border_parts(runs: DataFrame, by: list[str], corners: int) -> DataFrame:
    """borders with part and boxes, outer ones counted apart from those around holes."""
    return _numbered(runs, by, _border, corners, None, None, True)
