"""Reading order of a page's regions, and of a region's lines.

Sections come from windows (see regions.py). What remains depends on the data at every step: splitting a section at
its local dividers and walking its columns; that runs on a section's few rows inside the tasks. Lines need no walk.
"""

from __future__ import annotations

from itertools import groupby
from statistics import fmean

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .paged import Rows, per_key
from .regions import in_columns, properties, sectioned, with_dividers


def sorted_column(rows: Rows) -> Rows:
    """Vertical separators left of the column by x, the rest from top to bottom, those right of it by x."""
    inside = [r["meanx"] for r in rows if r["label"] != 6] or [r["meanx"] for r in rows]
    middle = fmean(inside)
    upright = [r for r in rows if r["label"] == 6 and r["width"] < r["height"]]
    left = [r for r in upright if r["maxx"] < middle]
    right = [r for r in upright if r["minx"] > middle]
    border = {r["id"] for r in left + right}
    rest = [r for r in rows if r["id"] not in border]
    return [*sorted(left, key=lambda r: (r["meanx"], r["id"])), *sorted(rest, key=lambda r: (r["meany"], r["id"])), *sorted(right, key=lambda r: (r["meanx"], r["id"]))]


def by_columns(rows: Rows) -> Rows:
    """Column by column from the left: a region is in the column if it begins before its middle or its centre is left of its border."""
    out: Rows = []
    if not rows:
        return out
    step = rows[0]["x_median"] if rows[0]["x_median"] > 0 else 1.0
    border = rows[0]["page_minx"] + step
    while rows:
        here = [r for r in rows if r["minx"] < border - step / 2 or r["meanx"] < border]
        if not here:
            # the next border that lets anything in, in whole steps
            need = min(min(r["minx"] + step / 2, r["meanx"]) for r in rows)
            border += step * max(1, int((need - border) // step))
            continue
        column = sorted_column(here)
        out += column
        edges = [r["maxx"] for r in column if r["label"] in (2, 3, 4, 5)]
        border = (fmean(edges) if edges else border) + step
        taken = {r["id"] for r in here}
        rows = [r for r in rows if r["id"] not in taken]
    return out


def by_dividers(rows: Rows) -> Rows:
    """Splits at the topmost local divider until none is left. With regions beside the divider on both sides those not above it come first with them, else those above it."""
    out: Rows = []
    waiting = [rows]  # groups in falling order: the last is next
    while waiting:
        here = waiting.pop()
        dividers = [r for r in here if r["is_local"]]
        if not dividers:
            out += by_columns(here)
            continue
        at = min(dividers, key=lambda r: (r["meany"], r["id"]))
        rest = [r for r in here if r["id"] != at["id"]]
        left = {r["id"] for r in rest if r["meanx"] < at["minx"]}
        right = {r["id"] for r in rest if r["meanx"] > at["maxx"]}
        above = {r["id"] for r in rest if r["meany"] < at["meany"]}
        first = left | right | ({r["id"] for r in rest} - above if left and right else above)
        waiting += [[r for r in rest if r["id"] not in first], [{**at, "is_local": False}], [r for r in rest if r["id"] in first]]
    return out


def _page(rows: Rows) -> Rows:
    """A page's rows, ordered by section: each section's walk, then the dividers that end it in falling order of place."""
    out: Rows = []
    for _, section in groupby(rows, key=lambda r: r["section"]):
        here = list(section)
        out += by_dividers([r for r in here if not r["is_global"]])
        out += [r for r in reversed(here) if r["is_global"]]
    return [{**r, "position": i} for i, r in enumerate(out)]


def reading_order(regions: DataFrame) -> DataFrame:
    """page, ord, id, position of every labelled region. Windows and walks use the one shuffle by page."""
    parts = sectioned(with_dividers(in_columns(properties(regions))))
    keep = ["page", "ord", "id", "label", "minx", "maxx", "meanx", "meany", "width", "height", "is_local", "is_global", "x_median", "page_minx", "section"]
    cast = parts.select(*[F.col(c).cast("double") if c in ("minx", "maxx", "page_minx") else F.col(c) for c in keep])
    return per_key(cast, ["page"], ["section", "id"], _page, f"page {dict(cast.dtypes)['page']}, ord int, id int, position int", laid=True)


def line_order(lines: DataFrame) -> DataFrame:
    """page, region, ord, position. lines: page, region, ord, minx, width, cx, cy (centroid).

    A border starts one middle width right of the leftmost line and moves on in such steps; a line belongs to the first
    border that is right of its centre, or right of its left edge by more than half a step. Within a border lines go by
    height. Which border takes a line is arithmetic, so all of it is windows.
    """
    w = Window.partitionBy("page", "region")
    step = F.coalesce(F.nullif(F.median(F.col("width").cast("double")).over(w), F.lit(0.0)), F.lit(1.0))
    df = lines.withColumns({"__step": step, "__from": F.min(F.col("minx").cast("double")).over(w) + step})
    reach = F.least(F.col("minx") + F.col("__step") / 2, F.col("cx"))
    column = F.greatest(F.floor((reach - F.col("__from")) / F.col("__step")) + 1, F.lit(0))
    return df.select("page", "region", "ord", (F.row_number().over(w.orderBy(column, "cy", "ord")) - 1).alias("position"))


def lines_by_first_point(lines: DataFrame) -> DataFrame:
    """page, region, ord, position by the height of a line's first point. lines: page, region, ord, y."""
    w = Window.partitionBy("page", "region").orderBy("y", "ord")
    return lines.select("page", "region", "ord", (F.row_number().over(w) - 1).alias("position"))


def lines_by_height(lines: DataFrame) -> DataFrame:
    """page, region, ord, position by the whole part of the centroid's height."""
    w = Window.partitionBy("page", "region").orderBy(F.col("cy").cast("int"), "ord")
    return lines.select("page", "region", "ord", (F.row_number().over(w) - 1).alias("position"))
