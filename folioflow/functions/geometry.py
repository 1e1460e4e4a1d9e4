"""Geometry of points, boxes and lines as column expressions: no Python runs on the rows.

Points are array<struct<x:int,y:int>>; boxes are four columns.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_points(s: Column) -> Column:
    """"x,y x,y ..." to points; null for null, no points for blank text."""
    pairs = F.filter(F.split(F.trim(s), "\\s+"), lambda p: p != "")
    parts = F.transform(pairs, lambda p: F.split(p, ","))  # cut once for both numbers
    return F.transform(parts, lambda p: F.struct(p.getItem(0).cast("int").alias("x"), p.getItem(1).cast("int").alias("y")))


def format_points(points: Column, scale: float | Column = 1.0) -> Column:
    """Points to text, each coordinate scaled and cut toward zero."""
    if isinstance(scale, Column) or scale != 1:
        by = scale if isinstance(scale, Column) else F.lit(float(scale))
        cut = lambda v: (v * by).cast("int").cast("string")
    else:
        cut = lambda v: v.cast("int").cast("string")
    return F.array_join(F.transform(points, lambda p: F.concat(cut(p["x"]), F.lit(","), cut(p["y"]))), " ")


def xs(points: Column) -> Column:
    return F.transform(points, lambda p: p["x"])


def ys(points: Column) -> Column:
    return F.transform(points, lambda p: p["y"])


def bbox(points: Column) -> dict[str, Column]:
    """minx, miny, maxx, maxy; null without points."""
    return {"minx": F.array_min(xs(points)), "miny": F.array_min(ys(points)), "maxx": F.array_max(xs(points)), "maxy": F.array_max(ys(points))}


def moved(points: Column, dx: int, dy: int) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def scaled(points: Column, scale: float | Column) -> Column:
    by = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.transform(points, lambda p: F.struct((p["x"] * by).cast("int").alias("x"), (p["y"] * by).cast("int").alias("y")))


def clipped(points: Column, width: Column, height: Column) -> Column:
    """Points held inside [0, width] x [0, height], both ends included."""
    hold = lambda v, top: F.least(F.greatest(v, F.lit(0)), top)
    return F.transform(points, lambda p: F.struct(hold(p["x"], width).alias("x"), hold(p["y"], height).alias("y")))


def distinct_points(points: Column) -> Column:
    return F.array_distinct(points)


def perimeter_over(box: dict[str, Column], size: float, x_only: bool = False) -> Column:
    """Half the perimeter (or the width) is over size; equality fails."""
    w, h = box["maxx"] - box["minx"], box["maxy"] - box["miny"]
    return (w if x_only else w + h) > size


def area_over(box: dict[str, Column], size: float) -> Column:
    return (box["maxx"] - box["minx"]).cast("double") * (box["maxy"] - box["miny"]) > size


def is_box(box: dict[str, Column]) -> Column:
    return (box["maxx"] > box["minx"]) & (box["maxy"] > box["miny"])


def center_x(box: dict[str, Column]) -> Column:
    return box["minx"] + F.abs(box["maxx"] - box["minx"]) / 2


def _edges(points: Column, f) -> Column:
    """Sum of f(p, q) over the edges of the closed polygon."""
    n = F.size(points)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: f(F.get(points, i), F.get(points, (i + 1) % n)))
    return F.when(n > 0, F.aggregate(terms, F.lit(0.0), lambda a, t: a + t))


def cross(p: Column, q: Column) -> Column:
    return p["x"].cast("double") * q["y"] - q["x"].cast("double") * p["y"]


def area(points: Column) -> Column:
    """Area of a simple polygon."""
    return F.abs(_edges(points, cross)) / 2


def centroid(points: Column) -> tuple[Column, Column]:
    """Centroid of a simple polygon; the mean of its points where it has no area."""
    double = _edges(points, cross)
    sums = [_edges(points, lambda p, q, c=c: (p[c] + q[c]) * cross(p, q)) for c in ("x", "y")]
    mean = [F.aggregate(v(points), F.lit(0.0), lambda a, t: a + t) / F.size(points) for v in (xs, ys)]
    return tuple(F.when(double != 0, s / (3 * double)).otherwise(m) for s, m in zip(sums, mean, strict=True))


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Common area of two boxes."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0)).cast("double")
    return side("minx", "maxx") * side("miny", "maxy")


def box_area(a: dict[str, Column]) -> Column:
    return (a["maxx"] - a["minx"]).cast("double") * (a["maxy"] - a["miny"])


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes, 0 where there is no area."""
    both = overlap(a, b)
    whole = box_area(a) + box_area(b) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def yolo_box(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """Centre and size as shares of the page."""
    mid = lambda lo, hi, of: (box[lo] + box[hi]) / 2 / of
    return {"xc": mid("minx", "maxx", width), "yc": mid("miny", "maxy", height), "w": (box["maxx"] - box["minx"]) / width, "h": (box["maxy"] - box["miny"]) / height}


def line_polygon(baseline: Column, up: Column, down: Column) -> Column:
    """Polygon around a baseline: its points moved along their normals by the heights (1 at least), there and back.

    A point's direction is that of the step to the next point; the last point takes the step before it.
    """
    n = F.size(baseline)
    up, down = F.greatest(up, F.lit(1.0)), F.greatest(down, F.lit(1.0))
    at = lambda i: F.get(baseline, F.least(i, n - 2))
    nxt = lambda i: F.get(baseline, F.least(i, n - 2) + 1)
    angle = lambda i: F.atan2((nxt(i)["y"] - at(i)["y"]).cast("double"), (nxt(i)["x"] - at(i)["x"]).cast("double")) + F.lit(1.5707963267948966)

    def side(sign: int, height: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((F.get(baseline, i)["x"] + sign * F.cos(angle(i)) * height).alias("x"), (F.get(baseline, i)["y"] + sign * F.sin(angle(i)) * height).alias("y")))

    return F.when(n >= 2, F.concat(side(-1, up), F.reverse(side(1, down))))
