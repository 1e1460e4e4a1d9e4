"""Outlines and borders of a mask, followed step by step: what the joins of run tables are held against."""

from __future__ import annotations

import numpy as np

#: Half-way points of a square's top, right, bottom and left, as (y, x) on a grid of half pixels.
SIDES = np.array([(0, 1), (1, 2), (2, 1), (1, 0)])


def _step(pattern: int) -> list[int]:
    """Sides from which and to which an outline crosses a square whose marked corners are the pattern's bits, clockwise from the upper left; then the second crossing, if any."""
    marked = [bool(pattern >> i & 1) for i in range(4)]
    # side i lies between corners i and i + 1; marked pixels are to the right, so a step comes in where marks end clockwise
    comes = [i for i in range(4) if marked[i] and not marked[(i + 1) % 4]]
    goes = {i: next(j % 4 for j in range(i + 3, i - 1, -1) if not marked[j % 4] and marked[(j + 1) % 4]) for i in comes}
    return ([x for i in comes for x in (i, goes[i])] + [0] * 4)[:4]


STEPS = np.array([_step(p) for p in range(16)])


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """Closed outlines of a mask half way between its pixels and the others, marked pixels to the right; pixels that touch at a corner only are apart.

    Each starts at its lowest, then rightmost point. Every square of four pixel centres adds the steps that the pattern
    of its corners asks for; each half-way point is left by one step, so following them closes every outline.
    """
    m = np.pad(mask.astype(np.uint8), 1)
    wide = 2 * m.shape[1]
    pattern = m[:-1, :-1] | m[:-1, 1:] << 1 | m[1:, 1:] << 2 | m[1:, :-1] << 3
    ys, xs = np.nonzero((pattern > 0) & (pattern < 15))
    kind = pattern[ys, xs]
    at = lambda side, y, x: (2 * y + SIDES[side, 0]) * wide + 2 * x + SIDES[side, 1]
    twice = (kind == 5) | (kind == 10)  # marked at two facing corners: two steps
    a = np.concatenate([at(STEPS[kind, 0], ys, xs), at(STEPS[kind, 2], ys, xs)[twice]])
    b = np.concatenate([at(STEPS[kind, 1], ys, xs), at(STEPS[kind, 3], ys, xs)[twice]])
    order = np.argsort(a)
    a, b = a[order], b[order]
    after = np.searchsorted(a, b)
    seen = np.zeros(len(a), bool)
    out = []
    for start in range(len(a) - 1, -1, -1):
        if seen[start]:
            continue
        ring, i = [], start
        while not seen[i]:
            seen[i] = True
            ring.append(i)
            i = after[i]
        code = a[ring]
        out.append(np.stack([code % wide / 2 - 1, code // wide / 2 - 1], axis=1))
    return out


#: Neighbours of a pixel (dy, dx), clockwise from the left.
AROUND = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def borders(mask: np.ndarray) -> list[tuple[bool, np.ndarray]]:
    """(is outer, pixels) of every border by Suzuki and Abe's border following, pixels inside straight runs left out."""
    f = np.pad(mask.astype(bool), 1).astype(np.int64)
    out: list[tuple[bool, np.ndarray]] = []
    edge = (f != 0) & ((np.roll(f, 1, 1) == 0) | (np.roll(f, -1, 1) == 0))
    mark = 1
    for y, x in zip(*np.nonzero(edge), strict=True):
        if f[y, x] == 1 and f[y, x - 1] == 0:
            outer, towards = True, 0
        elif f[y, x] >= 1 and f[y, x + 1] == 0:
            outer, towards = False, 4
        else:
            continue
        mark += 1
        first = next((k % 8 for k in range(towards, towards + 8) if f[y + AROUND[k % 8][0], x + AROUND[k % 8][1]]), None)
        if first is None:
            f[y, x] = -mark
            out.append((outer, np.array([[x - 1, y - 1]])))
            continue
        ring = []
        begin, came = (y + AROUND[first][0], x + AROUND[first][1]), first
        cy, cx = y, x
        while True:
            right_open = False
            for k in range(came - 1, came - 9, -1):
                dy, dx = AROUND[k % 8]
                if f[cy + dy, cx + dx]:
                    break
                right_open |= k % 8 == 4
            if right_open:
                f[cy, cx] = -mark
            elif f[cy, cx] == 1:
                f[cy, cx] = mark
            ring.append((cx - 1, cy - 1))
            ny, nx = cy + dy, cx + dx
            if (ny, nx) == (y, x) and (cy, cx) == begin:
                break
            came, cy, cx = (k + 4) % 8, ny, nx
        r = np.array(ring)
        bends = (np.roll(r, -1, 0) - r != r - np.roll(r, 1, 0)).any(axis=1)
        out.append((outer, r[bends]))
    return out
