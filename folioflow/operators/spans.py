"""Numpy on the runs of a batch of rasters at once: filling, uniting, drawing over each other, strokes, column heights.

A run is a line's number, x0 and x1 (included). Everything is sorting, binary search and differences: no step depends on
how many runs a line has but by a logarithm, and nothing is as large as a raster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: About how many runs are made at once; a larger raster is taken alone.
MOST = 4_000_000


def coded(*columns: np.ndarray) -> np.ndarray:
    """A number for each row that sorts as the columns do, in their order."""
    out = np.zeros(len(columns[0]), np.int64)
    if not len(out):
        return out
    top = 1
    for c in columns:
        low = int(c.min())
        span = int(c.max()) - low + 1
        if top * span >= 1 << 62:
            out, c = numbered(out), numbered(c)
            low, span, top = 0, int(c.max()) + 1, int(out.max()) + 1
        out = out * span + (c - low)
        top *= span
    return out


def numbered(values: np.ndarray) -> np.ndarray:
    """The place of each value among all different ones."""
    order = np.argsort(values, kind="stable")
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(stretches(values[order])) - 1
    return out


def stretches(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every i with every number of lo[i] to hi[i] - 1."""
    n = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' points as (x, y) one after the other, and how many each row has; null rows have none."""
    x, y = column.flatten().flatten()
    both = np.stack([x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)], axis=1).astype(float)
    return both, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def counts(column: pa.Array) -> np.ndarray:
    """How many elements each row's list has; null rows have none."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def edges(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every side of the closed outlines."""
    after = np.arange(1, len(points) + 1)
    ends = np.cumsum(sizes)[sizes > 0]
    after[ends - 1] = ends - sizes[sizes > 0]
    return np.repeat(np.arange(len(sizes)), sizes), points, points[after]


def sides(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of lines that are not closed."""
    row, p, q = edges(points, sizes)
    last = np.zeros(len(points), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    return row[~last], p[~last], q[~last]


def lines_made(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many lines the sides of each row cross, at most: what filling costs."""
    row, p, q = edges(points, sizes)
    high = np.abs(q[:, 1] - p[:, 1])
    return np.bincount(row, np.where(np.isfinite(high), high, 0) + 1, len(sizes))


def pieces(cost: np.ndarray, most: int = MOST) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose costs sum to `most` or less; a row that costs more is a stretch of its own."""
    done, upto = 0, np.cumsum(cost)
    while done < len(cost):
        before = upto[done - 1] if done else 0
        end = max(done + 1, int(np.searchsorted(upto, before + most, "right")))
        yield done, end
        done = end


def united(line: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and adjacent runs of a line made one: the place of its first run, x0 and x1, by line and place."""
    some = np.flatnonzero(x0 <= x1)
    if not len(some):
        return some, x0[some], x1[some]
    key = coded(line[some], x0[some])
    if (key[1:] < key[:-1]).any():
        some = some[np.argsort(key, kind="stable")]
    line, x0, x1 = line[some], x0[some], x1[some]
    wide = int(x1.max()) - int(x0.min()) + 3
    shift = (np.cumsum(stretches(line)) - 1) * wide
    reach = np.maximum.accumulate(shift + x1)
    new = np.r_[True, (shift + x0)[1:] > reach[:-1] + 1]
    at = np.flatnonzero(new)
    return some[at], x0[at], reach[np.append(at[1:], len(x0)) - 1] - shift[at]


def filled(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Polygon, y, x0, x1 of the pixels whose centre is in it, edges included, by even-odd crossing of scan lines.

    A side crosses the lines from its upper end on and without its lower one; a line's crossings are paired in order.
    Level sides are runs of their own. Sides with an unknown height cross nothing.
    """
    row, p, q = edges(points, sizes)
    ok = (sizes[row] > 2) & np.isfinite(p[:, 1]) & np.isfinite(q[:, 1])
    row, p, q = row[ok], p[ok], q[ok]
    low, high = (np.ceil(f(p[:, 1], q[:, 1])).astype(np.int64) for f in (np.minimum, np.maximum))
    i, y = spread(low, high)
    d = q - p
    with np.errstate(invalid="ignore"):
        x = p[i, 0] + (y - p[i, 1]) * d[i, 0] / d[i, 1]
    of, x = row[i], np.where(np.isnan(x), -np.inf, x)
    line = coded(of, y)
    order = np.argsort(line, kind="stable")
    on = line[order]
    if len(on) % 2 == 0 and (on[::2] == on[1::2]).all() and (on[1:-1:2] != on[2::2]).all():
        one, two = x[order[::2]], x[order[1::2]]
        a, b, at = np.minimum(one, two), np.maximum(one, two), order[::2]
    else:
        order = np.lexsort((x, line))
        on = line[order]
        starts = np.flatnonzero(stretches(on))
        place = np.arange(len(on)) - np.repeat(starts, np.diff(np.append(starts, len(on))))
        first = np.flatnonzero((place[:-1] % 2 == 0) & (on[1:] == on[:-1]))
        a, b, at = x[order[first]], x[order[first + 1]], order[first]
    good = np.isfinite(a) & np.isfinite(b)
    a, b, at = a[good], b[good], at[good]
    level = (p[:, 1] == q[:, 1]) & (p[:, 1] == np.floor(p[:, 1])) & np.isfinite(p[:, 0]) & np.isfinite(q[:, 0])
    p, q = p[level], q[level]
    of = np.concatenate([of[at], row[level]])
    y = np.concatenate([y[at], p[:, 1].astype(np.int64)])
    x0 = np.ceil(np.concatenate([a, np.minimum(p[:, 0], q[:, 0])])).astype(np.int64)
    x1 = np.floor(np.concatenate([b, np.maximum(p[:, 0], q[:, 0])])).astype(np.int64)
    at, x0, x1 = united(coded(of, y), x0, x1)
    return of[at], y[at], x0, x1


def stroked(points: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line, y, x0, x1 of polylines of `width` pixels. Of each side every step along its longer axis is a pixel, widened across that axis. Not united."""
    row, p, q = sides(points, sizes)
    ok = np.isfinite(p).all(axis=1) & np.isfinite(q).all(axis=1)
    row, p, q = row[ok], p[ok], q[ok]
    d = q - p
    level = np.abs(d[:, 0]) >= np.abs(d[:, 1])
    back, on = (width - 1) // 2, width // 2
    # level sides between whole places are one run each
    whole = (d[:, 1] == 0) & (p[:, 0] == np.floor(p[:, 0])) & (q[:, 0] == np.floor(q[:, 0]))
    some = np.flatnonzero(~whole)
    steps = np.floor(np.abs(d[some]).max(axis=1, initial=0) + 0.5).astype(np.int64)
    i, step = spread(np.zeros(len(some), np.int64), steps + 1)
    t = np.where(steps[i] > 0, step / np.maximum(steps[i], 1), 0.0)
    i = some[i]
    x, y = (np.floor(p[i, c] + t * d[i, c] + 0.5).astype(np.int64) for c in (0, 1))
    at = lambda v: np.floor(v + 0.5).astype(np.int64)
    wide = level[i]
    p, q = p[whole], q[whole]
    runs = [(row[whole], at(p[:, 1]) + k, at(np.minimum(p[:, 0], q[:, 0])), at(np.maximum(p[:, 0], q[:, 0]))) for k in range(-back, on + 1)]
    runs += [(row[i[wide]], y[wide] + k, x[wide], x[wide]) for k in range(-back, on + 1)]
    runs.append((row[i[~wide]], y[~wide], x[~wide] - back, x[~wide] + on))
    return tuple(np.concatenate(c) for c in zip(*runs, strict=True))


def shown(line: np.ndarray, x0: np.ndarray, x1: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs drawn over each other, the run that each piece of a line shows, and the piece's x0 and x1, by line and place. The highest rank shows.

    Lines are cut wherever a run begins or ends. A run covers its pieces as two blocks of a power of two; the highest
    rank of a block is handed down to its halves.
    """
    some = np.flatnonzero(x0 <= x1)
    if not len(some):
        return some, x0[some], x1[some]
    some = some[np.argsort(coded(line[some], x0[some]), kind="stable")]
    line, x0, x1, rank = line[some], x0[some], x1[some], rank[some]
    low = int(x0.min())
    shift = (np.cumsum(stretches(line)) - 1) * (int(x1.max()) - low + 2) - low
    a, b = shift + x0, shift + x1 + 1
    if (b[:-1] <= a[1:]).all():
        return some, x0, x1
    cuts = np.sort(np.concatenate([a, b]), kind="stable")
    cuts = cuts[stretches(cuts)]
    first, end = np.searchsorted(cuts, a), np.searchsorted(cuts, b)
    order = np.argsort(rank, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    size = np.frexp(end - first)[1] - 1
    top = np.full(len(cuts), -1)
    for k in range(int(size.max()), -1, -1):
        own = np.flatnonzero(size == k)
        np.maximum.at(top, first[own], place[own])
        np.maximum.at(top, end[own] - (1 << k), place[own])
        if k:
            half = 1 << (k - 1)
            down = top.copy()
            down[half:] = np.maximum(down[half:], top[:-half])
            top = down
    at = np.flatnonzero(top >= 0)
    run = order[top[at]]
    return some[run], cuts[at] - shift[run], cuts[at + 1] - shift[run] - 1


def drawn(line: np.ndarray, x0: np.ndarray, x1: np.ndarray, rank: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, with adjacent pieces of one label made one and label 0 left out."""
    at, x0, x1 = shown(line, x0, x1, rank)
    some = label[at] != 0
    at, x0, x1 = at[some], x0[some], x1[some]
    new = stretches(line[at], label[at])
    new[1:] |= x0[1:] != x1[:-1] + 1
    starts = np.flatnonzero(new)
    return at[starts], x0[starts], x1[np.append(starts[1:], len(x1)) - 1] if len(x1) else x1


def heights(of: np.ndarray, x0: np.ndarray, x1: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many pixels each column of n shapes has, from their runs: where each shape's columns begin among all counts, its first column, and the counts."""
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, of, x0)
    np.maximum.at(high, of, x1)
    some = low <= high
    wide = np.where(some, high - np.where(some, low, high) + 2, 0)
    starts = np.r_[0, np.cumsum(wide)]
    change = np.bincount(starts[of] + x0 - low[of], minlength=starts[-1]) - np.bincount(starts[of] + x1 + 1 - low[of], minlength=starts[-1])
    return starts, np.where(some, low, 0), np.cumsum(change)
