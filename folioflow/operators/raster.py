"""Raster arithmetic: padding, tiles, crops, suppression, drawing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PADDING_LABEL

def padding(d: Column, size: int, factor: float = 1.0) -> Column:
    """Pixels to add to an axis of length d for tiles of `size` at steps of size // factor."""
    step = int(size // factor)
    return F.when(d < size, F.lit(size) - d).otherwise((F.lit(step) - d % step) % step)


def tile_count(d: Column, size: int, factor: float = 1.0) -> Column:
    step = int(size // factor)
    return F.when(d < size, F.lit(0)).otherwise(F.floor((d - size) / step).cast("int") + 1)


def tiles(pages: DataFrame, size: int, factor: float = 1.0) -> DataFrame:
    """pages with tile (row by row), y, x: the origins of the tiles."""
    step = int(size // factor)
    ny, nx = tile_count(F.col("height"), size, factor), tile_count(F.col("width"), size, factor)
    some = pages.withColumns({"__ny": ny, "__nx": nx}).where("__ny > 0 and __nx > 0")
    each = some.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("__ny") * F.col("__nx") - 1)))
    y, x = F.floor(F.col("tile") / F.col("__nx")).cast("int") * step, (F.col("tile") % F.col("__nx")) * step
    return each.withColumns({"y": y, "x": x}).drop("__ny", "__nx")


def crop_size(width: Column, height: Column, to: int) -> Column:
    """Width of a line crop scaled to height `to`; null where it is narrower than high and so dropped."""
    w = F.floor(width * to / height).cast("int")
    return F.when((height > 0) & (w >= to), w)


def vertical_maxima(pixels: DataFrame, by: list[str], x: str = "x", y: str = "y", value: str = "value", size: int = 7) -> DataFrame:
    """pixels whose value is below the highest of its column's window of `size` become 0. Pixel columns are dense in y."""
    half = size // 2
    w = Window.partitionBy(*by, x).orderBy(y).rowsBetween(-half, half)
    return pixels.withColumn(value, F.when(F.col(value) == F.max(value).over(w), F.col(value)).otherwise(F.lit(0).cast(dict(pixels.dtypes)[value])))


def batches_by_width(crops: DataFrame, size: int, by: list[str], span: int = 100_000) -> DataFrame:
    """crops with batch: runs of `size` crops of like width within each key, equal widths by their whole-number id.

    Keys and widths are few, so no window spans a key: a crop's place is that of its width, of its stretch of `span` ids
    among those of its width, and its own in the stretch.
    """
    df = crops.withColumn("__s", F.floor(F.col("id") / span))
    n = df.groupBy(*by, "width", "__s").agg(F.count(F.lit(1)).alias("__n"))
    upto = lambda c, w: F.sum(c).over(w) - F.col(c)
    before = n.withColumn("__a", upto("__n", Window.partitionBy(*by, "width").orderBy("__s"))).drop("__n")
    widths = n.groupBy(*by, "width").agg(F.sum("__n").alias("__n"))
    widths = widths.withColumn("__b", upto("__n", Window.partitionBy(*by).orderBy("width"))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*by, "width", "__s").orderBy("id")) - 1
    placed = df.withColumn("__c", own).join(before, [*by, "width", "__s"]).join(widths, [*by, "width"])
    return placed.withColumn("batch", F.floor((F.col("__a") + F.col("__b") + F.col("__c")) / size).cast("int")).drop("__a", "__b", "__c", "__s")


def fill_polygon(raster: np.ndarray, points: np.ndarray, value: int) -> None:
    """Sets the pixels whose centre is in the polygon, edges included, by even-odd crossing of scan lines."""
    h, w = raster.shape
    xs, ys = points[:, 0].astype(float), points[:, 1].astype(float)
    x2, y2 = np.roll(xs, -1), np.roll(ys, -1)
    for y in range(max(0, int(np.ceil(ys.min()))), min(h - 1, int(np.floor(ys.max()))) + 1):
        cut = (np.minimum(ys, y2) <= y) & (y < np.maximum(ys, y2))
        at = np.sort(xs[cut] + (y - ys[cut]) * (x2[cut] - xs[cut]) / (y2[cut] - ys[cut]))
        flat = (ys == y) & (y2 == y)
        runs = [*zip(at[::2], at[1::2], strict=False), *zip(np.minimum(xs, x2)[flat], np.maximum(xs, x2)[flat], strict=True)]
        for a, b in runs:
            raster[y, max(0, int(np.ceil(a))) : max(0, min(w, int(np.floor(b)) + 1))] = value


def drawn(pages: DataFrame, border: bool = False) -> DataFrame:
    """page, width, height, raster: a byte for each pixel. pages: page, width, height, shapes array<struct<label, points>> in drawing order.

    With border, pixels outside the convex hull of all shapes, widened by 2 % of the page's shorter side, get the padding
    label, and shapes of label 0 are drawn again over it.
    """
    from .shapes import beyond_hull, hull

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, h, shapes in zip(b.column("width").to_pylist(), b.column("height").to_pylist(), b.column("shapes").to_pylist(), strict=True):
                img = np.zeros((h, w), np.uint8)
                some = [(s["label"], np.array([[p["x"], p["y"]] for p in s["points"]])) for s in shapes or [] if len(s["points"]) > 2]
                for label, points in some:
                    fill_polygon(img, points, label)
                counted = [points for label, points in some if label]
                if border and counted:
                    img[beyond_hull(img.shape, hull(np.vstack(counted)), int(0.02 * min(w, h)))] = PADDING_LABEL
                    for label, points in some:
                        if not label:
                            fill_polygon(img, points, 0)
                out.append(img.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("page"), b.column("width"), b.column("height"), pa.array(out, pa.binary())], names=["page", "width", "height", "raster"])

    kinds = dict(pages.dtypes)
    return pages.select("page", F.col("width").cast("int"), F.col("height").cast("int"), "shapes").mapInArrow(run, f"page {kinds['page']}, width int, height int, raster binary")
