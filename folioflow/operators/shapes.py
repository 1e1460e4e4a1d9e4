"""General polygons: common areas, hulls, splitting at a baseline, outlines of rasters, and baselines from line pixels.

Pairs, filters and numbering are joins, windows and aggregations; what is left for Python is one shape at a time.
Polygons are array<struct<x, y>>, read by the even-odd rule, so crossing and doubled outlines need no repair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bbox
from .matching import BOX
from .outlines import border_parts, outline_parts
from .paged import Rows, per_key
from .spans import edges as _edges
from .spans import flat as _flat

POINT = "struct<x:double,y:double>"


def _points(a: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in a]


def crossings(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and height of the places where any two of a row's segments p[row, i] q[row, i] cross."""
    d = q - p
    i, j = np.triu_indices(p.shape[1], 1)
    turn = d[:, i, 0] * d[:, j, 1] - d[:, i, 1] * d[:, j, 0]
    row, at = np.nonzero(turn)
    turn, i, j = turn[row, at], i[at], j[at]
    gap, one, two = p[row, j] - p[row, i], d[row, i], d[row, j]
    s = (gap[:, 0] * two[:, 1] - gap[:, 1] * two[:, 0]) / turn
    t = (gap[:, 0] * one[:, 1] - gap[:, 1] * one[:, 0]) / turn
    on = (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
    return row[on], p[row[on], i[on], 1] + s[on] * one[on, 1]


def _slab_areas(p: np.ndarray, q: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Area of a, of b and of what they share, for rows of equally many rising sides p q, of which `own` belong to a.

    Between two neighbouring heights of corners and crossings all edges are straight and keep their order, so a width
    measured half way, times the distance, is the exact area of the slab.
    """
    n = len(p)
    row, y = crossings(p, q)
    count = np.bincount(row, minlength=n)
    more = np.repeat(p[:, :1, 1], count.max(initial=0), 1)
    more[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = y
    cuts = np.sort(np.concatenate([p[..., 1], q[..., 1], more], axis=1), axis=1)
    row, at = np.nonzero(np.diff(cuts, axis=1))
    mid, high = (cuts[row, at + 1] + cuts[row, at]) / 2, cuts[row, at + 1] - cuts[row, at]
    p, q, own = p[row], q[row], own[row]
    met = (np.minimum(p[..., 1], q[..., 1]) < mid[:, None]) & (mid[:, None] < np.maximum(p[..., 1], q[..., 1]))
    x = np.where(met, p[..., 0] + (mid[:, None] - p[..., 1]) * (q[..., 0] - p[..., 0]) / (q[..., 1] - p[..., 1]), np.inf)
    order = np.argsort(x, axis=1, kind="stable")
    x, own = np.take_along_axis(x, order, 1), np.take_along_axis(own, order, 1)
    in_a = np.cumsum(own, axis=1)[:, :-1] % 2 == 1
    in_b = np.cumsum(~own, axis=1)[:, :-1] % 2 == 1
    wide = np.where(np.isfinite(x[:, 1:]), x[:, 1:], 0) - np.where(np.isfinite(x[:, 1:]), x[:, :-1], 0)
    return np.stack([np.bincount(row, (wide * inside).sum(axis=1) * high, n) for inside in (in_a, in_b, in_a & in_b)], axis=1)


def pair_areas(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = 1 << 20) -> np.ndarray:
    """Area of a, of b and of what they share, as a row for each pair. Pairs with equally many rising sides are measured at once, as many as fill `cells`."""
    row, p, q = (np.concatenate(x) for x in zip(_edges(*a), _edges(*b), strict=True))
    own = np.arange(len(row)) < len(a[0])
    rises = np.flatnonzero(p[:, 1] != q[:, 1])
    rises = rises[np.argsort(row[rises], kind="stable")]
    sides = np.bincount(row[rises], minlength=len(a[1]))
    first = np.cumsum(sides) - sides
    out = np.zeros((len(sides), 3))
    for k in np.unique(sides[sides > 0]):
        some = np.flatnonzero(sides == k)
        step = max(1, cells // int(2 * k * k))
        for i in range(0, len(some), step):
            at = rises[first[some[i : i + step], None] + np.arange(k)]
            out[some[i : i + step]] = _slab_areas(p[at], q[at], own[at])
    return out


def areas(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Area of a, of b and of what they share."""
    one, two, both = pair_areas((a, np.array([len(a)])), (b, np.array([len(b)])))[0]
    return float(one), float(two), float(both)


def polygon_pairs(pred: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """by, p (ord of pred), g (ord of truth), iou > 0 of the polygons in `points`. Pairs whose boxes do not overlap never become rows."""
    parts = int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the join's own shuffle, but never gathered into few tasks
    side = lambda df, s: df.where(F.size("points") > 2).repartition(parts, *by).select(*by, F.col("ord").alias(s), F.col("points").alias(f"{s}_points"), *[v.alias(f"{s}_{k}") for k, v in bbox(F.col("points")).items()])
    near = (F.col("p_minx") < F.col("g_maxx")) & (F.col("g_minx") < F.col("p_maxx")) & (F.col("p_miny") < F.col("g_maxy")) & (F.col("g_miny") < F.col("p_maxy"))
    met = side(pred, "p").join(side(truth, "g"), by).where(near).drop(*[f"{s}_{c}" for s in "pg" for c in BOX])
    keys = [*by, "p", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, c = pair_areas(_flat(b.column("p_points")), _flat(b.column("g_points"))).T
            iou = np.divide(c, x + y - c, out=np.zeros(len(c)), where=c > 0)
            yield b.select(keys).append_column("iou", pa.array(iou, pa.float64()))

    kinds = dict(met.dtypes)
    return met.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", iou double").where("iou > 0")


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, without points inside its sides, from the leftmost (then topmost) one on; lower x first, then back."""
    rows = sorted({(float(x), float(y)) for x, y in points})
    if len(rows) < 3:
        return np.array(rows).reshape(-1, 2)

    def chain(of: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in of:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(rows) + chain(rows[::-1]))


def hulls(points: DataFrame, by: list[str]) -> DataFrame:
    """by, hull: the convex hull of each key's points. points: by, x, y. Equal points are sent once."""
    kinds = dict(points.dtypes)

    def helper(rows: Rows) -> Rows:
        return [{**{k: rows[0][k] for k in by}, "hull": _points(hull(np.array([(r["x"], r["y"]) for r in rows], dtype=float)))}]

    some = points.where("x is not null and y is not null").select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    return per_key(some, by, ["x", "y"], helper, ", ".join(f"{k} {kinds[k]}" for k in by) + f", hull array<{POINT}>")


def split_at(polygon: np.ndarray, baseline: np.ndarray, reach: float = 100.0) -> tuple[np.ndarray, np.ndarray] | None:
    """The parts of one line's polygon, as in `splits_at`; None where there are none."""
    found, points, parts = splits_at(polygon[None], baseline[None], reach)
    return (points[0, 0][parts[0, 0]], points[0, 1][parts[0, 1]]) if found[0] else None


def splits_at(polygon: np.ndarray, baseline: np.ndarray, reach: float = 100.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of lines' polygons above and below their baselines, a baseline running on level to x = -reach and by reach at its end.

    The cut goes from the first to the last place where the baseline meets the outline; there is none where it meets it
    less than twice. All polygons have n points, all baselines as many as each other. Returns which lines are cut, and for
    every line the points of both parts with marks of those that count: (lines), (lines, 2, places, 2), (lines, 2, places).
    """
    m, n = polygon.shape[:2]
    left, right = baseline[:, :1].copy(), baseline[:, -1:].copy()
    left[..., 0] = -reach
    right[..., 0] += reach
    line = np.concatenate([left, baseline, right], axis=1)
    d, e = np.diff(line, axis=1)[:, :, None], (np.roll(polygon, -1, 1) - polygon)[:, None]
    gap = polygon[:, None] - line[:, :-1, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
        s = (gap[..., 0] * e[..., 1] - gap[..., 1] * e[..., 0]) / turn
        t = (gap[..., 0] * d[..., 1] - gap[..., 1] * d[..., 0]) / turn
        on = (turn != 0) & (s >= 0) & (s <= 1) & (t >= 0) & (t < 1)
        point = line[:, :-1, None] + s[..., None] * d
    # place along the line, place along the outline; first and last by both
    along, around = np.arange(line.shape[1] - 1)[:, None] + s, np.arange(n) + t
    along, around, on, point = (x.reshape(m, -1, *x.shape[3:]) for x in (along, around, on, point))
    rows = np.arange(m)

    def end(sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by = np.where(on, sign * along, np.inf)
        at = np.argmin(np.where(by == by.min(axis=1, keepdims=True), np.where(on, sign * around, np.inf), np.inf), axis=1)
        return along[rows, at], around[rows, at], point[rows, at]

    (s0, t0, p0), (s1, t1, p1) = end(1), end(-1)
    found = (on.sum(axis=1) >= 2) & (t0 != t1)
    s0, t0, s1, t1 = (np.where(found, x, 0.0)[:, None] for x in (s0, t0, s1, t1))

    def corners(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corners from place a to place b."""
        k = np.floor(a).astype(int) + 1 + np.arange(n)
        return polygon[rows[:, None], k % n], k < np.ceil(b)

    there, on_there = corners(t0, np.where(t1 > t0, t1, t1 + n))
    back, on_back = corners(t1, np.where(t0 > t1, t0, t0 + n))
    i = np.arange(line.shape[1])
    inner = (s0 < i) & (i < s1)
    both = np.ones((m, 1), bool)
    ends = p0[:, None], p1[:, None]
    points = np.stack([np.concatenate([ends[0], there, ends[1], line[:, ::-1]], axis=1), np.concatenate([ends[1], back, ends[0], line], axis=1)], axis=1)
    parts = np.stack([np.concatenate([both, on_there, both, inner[:, ::-1]], axis=1), np.concatenate([both, on_back, both, inner], axis=1)], axis=1)
    parts &= found[:, None, None]
    low = _heights(points[parts], parts.sum(axis=2).ravel()).reshape(m, 2)
    swap = ~(low[:, 0] <= low[:, 1])
    points[swap], parts[swap] = points[swap, ::-1], parts[swap, ::-1]
    return found, points, parts


def _heights(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Heights of the outlines' centroids; the mean of the corners' where there is no area."""
    row, p, q = _edges(flat, sizes)
    c = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    total = lambda v: np.bincount(row, v, len(sizes))
    whole = total(c)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(whole != 0, total((p[:, 1] + q[:, 1]) * c) / (3 * whole), total(p[:, 1]) / sizes)


def split_lines(lines: DataFrame, keep: list[str]) -> DataFrame:
    """keep, ascender, descender of lines with points and baseline; both null where the baseline does not cut the outline."""
    kinds = dict(lines.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (p, n), (l, m) = _flat(b.column("points")), _flat(b.column("baseline"))
            p0, l0 = np.cumsum(n) - n, np.cumsum(m) - m
            # lines with as many points and as long baselines are split at once; what is left out has no parts
            good = np.flatnonzero((n > 2) & (m > 1))
            kinds_, kind = np.unique(np.stack([n[good], m[good]], axis=1), axis=0, return_inverse=True)
            made: list[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]] = []
            for g, (k, j) in enumerate(kinds_):
                every = good[kind.ravel() == g]
                step = max(1, (1 << 18) // int(k * (j + 1)))
                for some in (every[i : i + step] for i in range(0, len(every), step)):
                    found, points, parts = splits_at(p[p0[some, None] + np.arange(k)], l[l0[some, None] + np.arange(j)])
                    made.append((some[found], [points[found, s][parts[found, s]] for s in (0, 1)], [parts[found, s].sum(axis=1) for s in (0, 1)]))
            at = np.concatenate([np.zeros(0, int), *[x[0] for x in made]])
            order = np.argsort(at, kind="stable")
            out = b.select(keep)
            for s, name in enumerate(("ascender", "descender")):
                flat, sizes = (np.concatenate([zero, *[x[i][s] for x in made]]) for i, zero in ((1, np.zeros((0, 2))), (2, np.zeros(0, int))))
                whole = np.zeros(len(b), int)
                whole[at] = sizes
                from_ = np.repeat((np.cumsum(sizes) - sizes)[order], sizes[order])
                sorted_ = sizes[order]
                flat = flat[from_ + np.arange(len(flat)) - np.repeat(np.cumsum(sorted_) - sorted_, sorted_)]
                xy = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"])
                out = out.append_column(name, pa.ListArray.from_arrays(pa.array(np.cumsum([0, *whole]), pa.int32()), xy, mask=pa.array(whole == 0)))
            yield out

    return lines.select(*keep, "points", "baseline").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + f", ascender array<{POINT}>, descender array<{POINT}>")


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's simplification of a closed outline from its first point; the end is not repeated."""
    p = np.vstack([ring, ring[:1]])
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, gap = p[b] - p[a], p[a + 1 : b] - p[a]
        long = d @ d
        t = np.clip(gap @ d / long, 0, 1)[:, None] if long else np.zeros((len(gap), 1))
        far = np.hypot(*(gap - t * d).T)
        at = int(np.argmax(far))
        if far[at] > tolerance:
            keep[a + 1 + at] = True
            todo += [(a, a + 1 + at), (a + 1 + at, b)]
    return p[:-1][keep[:-1]]


def mask_polygons(runs: DataFrame, tolerance: list[float] | None, least: float) -> DataFrame:
    """page, label, part, points, minx, miny, maxx, maxy: outlines of every label as polygons. runs: page, label, y, x0, x1.

    With tolerance, the label's tolerance (labels above the list take its last) simplifies its outlines. Outlines of
    holes are polygons too; those of less than three corners, or whose box's width and height do not sum to more than
    `least`, are left out. part counts on within a label, from the lowest, then rightmost outline on. runs may be packed.
    """

    def change(labels: list[int], x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        made = [simplified(p, tolerance[min(k, len(tolerance)) - 1]) for k, p in zip(labels, np.split(np.stack([x, y], axis=1), at[1:-1]), strict=True)]
        flat = np.concatenate(made)
        return flat[:, 0], flat[:, 1], np.cumsum([0, *map(len, made)])

    return outline_parts(runs, ["page", "label"], 2, least, change if tolerance else None)


def uncertain_polygons(runs: DataFrame) -> DataFrame:
    """The same columns for the borders of marked pixels (page, y, x0, x1): label 1 for outer borders, 2 for those around holes; borders of up to three corners are left out."""
    found = border_parts(runs, ["page"], 3)
    return found.select("page", F.when(F.col("outer"), 1).otherwise(2).alias("label"), "part", "points", *BOX)


def beyond_hull(shape: tuple[int, int], corners: np.ndarray, margin: float) -> np.ndarray:
    """Pixels farther than margin from a convex polygon. A row of the widened polygon is one run, found from its corners' discs and its moved sides."""
    h, w = shape
    y = np.arange(h, dtype=float)
    lo, hi = np.full(h, np.inf), np.full(h, -np.inf)

    def widen(x: np.ndarray, on: np.ndarray) -> None:
        np.minimum(lo, np.where(on, x, np.inf), out=lo)
        np.maximum(hi, np.where(on, x, -np.inf), out=hi)

    ends = np.roll(corners, -1, 0)
    for (cx, cy), (ex, ey) in zip(corners, ends, strict=True):
        on = np.abs(y - cy) <= margin
        half = np.sqrt(np.maximum(margin**2 - (y - cy) ** 2, 0))
        widen(cx - half, on)
        widen(cx + half, on)
        long = np.hypot(ex - cx, ey - cy)
        for turn in (1, -1):
            nx, ny = (turn * margin * (ey - cy) / long, turn * margin * (cx - ex) / long) if long else (0.0, 0.0)
            a, b = cy + ny, ey + ny
            if a != b:
                widen(cx + nx + (y - a) * (ex - cx) / (b - a), (np.minimum(a, b) <= y) & (y <= np.maximum(a, b)))
    x = np.arange(w)
    return (x < lo[:, None]) | (x > hi[:, None])


def baselines(pixels: DataFrame, by: list[str], downsample: float = 1.0, least: int = 5, most_points: int = 10) -> DataFrame:
    """by, points, up, down, position of every connected line with more than `least` pixels. pixels: page, region and component in by, x, y, up, down.

    Of each x the topmost pixel counts; of n of them, n / 10 (2 to most_points) at even distances make the baseline, whose
    ends move out by two pixels. up and down are middle heights of all pixels, negative ones counting as 0. position
    counts lines from left to right within by but its last column. All of it is windows and aggregations.
    """
    w = Window.partitionBy(*by)
    heights = pixels.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[(F.lit(downsample) * F.median(F.greatest(F.col(c).cast("double"), F.lit(0.0)))).alias(c) for c in ("up", "down")]).where(F.col("n") > least)
    tops = pixels.groupBy(*by, "x").agg(F.min("y").alias("y"))
    placed = tops.withColumns({"i": F.row_number().over(w.orderBy("x")) - 1, "m": F.count(F.lit(1)).over(w)})
    k = F.greatest(F.least(F.floor(F.col("m") / 10), F.lit(most_points)), F.lit(2)).cast("int")
    at = lambda j: F.when(j == F.col("k") - 1, F.col("m") - 1).otherwise(F.floor(j * ((F.col("m") - 1) / (F.col("k") - 1)))).cast("int")
    picked = placed.withColumn("k", k).withColumn("picked", F.exists(F.sequence(F.lit(0), F.col("k") - 1), lambda j: at(j) == F.col("i")))
    point = lambda dx: F.struct((F.lit(downsample) * (F.col("x") + dx)).alias("x"), (F.lit(downsample) * F.col("y")).alias("y"))
    dx = F.when(F.col("i") == 0, -2).when(F.col("i") == F.col("m") - 1, 2).otherwise(0)
    ends = F.when(F.col("m") == 1, F.array(point(F.lit(-2)), point(F.lit(2)))).otherwise(F.array(point(dx)))
    lines = picked.where("picked").groupBy(*by).agg(F.sort_array(F.flatten(F.collect_list(ends))).alias("points"))
    order = Window.partitionBy(*by[:-1]).orderBy(F.get("points", F.lit(0))["x"], by[-1])
    return heights.join(lines, by).select(*by, "points", "up", "down").withColumn("position", F.row_number().over(order) - 1)

