"""Whole pages from file to file: reading order written back, and annotations drawn as rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import bbox, format_points, parse_points, scaled
from ..functions.layout import draw_rank, label_of
from ..schema import REGION_KINDS
from ..sources import pagexml
from . import raster, runs
from .linked import kept
from .reading_order import reading_order


def in_reading_order(nested: DataFrame) -> DataFrame:
    """page_id, xml of pages in their reading order. Regions without a label get no place and are lost; lines keep theirs."""
    nested = kept(nested)  # used twice, and reading it again means parsing it again
    regions = pagexml.region_table(nested)
    b = bbox(F.col("points"))
    boxes = regions.where(F.size("points") > 0).select(F.col("page_id").alias("page"), "ord", label_of(F.coalesce("tag", F.lit(""))).alias("label"), *[v.cast("int").alias(k) for k, v in b.items()])
    order = reading_order(boxes).groupBy(F.col("page").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("ord", "position"))).alias("o"))
    once = F.filter("o", lambda x, i: (i == 0) | (x["ord"] != F.get("o", i - 1)["ord"]))
    order = order.select("page_id", F.map_from_entries(once).alias("__order"))
    places = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("__order"))), lambda i: F.try_element_at("__order", i))
    return pagexml.nested_xml(nested.join(order, "page_id", "left").withColumn("__order", F.coalesce(places, F.array().cast("array<int>"))), F.col("__order"))


def apply_reading_order(spark: SparkSession, path: str, out: str) -> None:
    """Reads a folder of page files, and writes the pages in their reading order."""
    pagexml.write_pages(in_reading_order(pagexml.read_pages(spark, path)), out)


def annotation_rasters(nested: DataFrame, border: bool = False) -> DataFrame:
    """page, width, height, raster of annotated pages: regions are drawn by the rank of their labels, later ones over earlier ones."""
    regions = pagexml.region_table(nested)
    shape = F.struct(draw_rank(F.col("label")).alias("rank"), "ord", F.col("label"), F.col("points"))
    shapes = regions.withColumn("label", label_of(F.coalesce("tag", F.lit("")))).groupBy("page_id").agg(F.sort_array(F.collect_list(shape)).alias("s"))
    listed = F.transform("s", lambda s: F.struct(s["label"].alias("label"), s["points"].alias("points")))
    pages = pagexml.page_table(nested).join(shapes, "page_id", "left")
    return raster.drawn(pages.select(F.col("page_id").alias("page"), "width", "height", listed.alias("shapes")), border)


def annotation_runs(nested: DataFrame) -> DataFrame:
    """page_id, label, r: the same rasters, without a border, as a packed run table; a page never exists as bytes."""
    regions = pagexml.region_table(nested, sizes=True).withColumn("label", label_of(F.coalesce("tag", F.lit(""))))
    # sizes go with the shapes: reading them apart would mean parsing the pages again
    shapes = regions.select("page_id", "width", "height", F.struct(draw_rank(F.col("label")).alias("rank"), "ord").alias("z"), "label", "points")
    return runs.drawn(shapes, ["page_id"], "z")


def scaled_pages(nested: DataFrame, scale: float | Column) -> DataFrame:
    """nested pages with their sizes, the outlines of regions and lines, and the lines' baselines scaled; each number is cut toward zero. It is a projection: nothing else of a page changes."""
    by = scale if isinstance(scale, Column) else F.lit(float(scale))
    size = {c: (F.col(c) * by).cast("int") for c in ("_imageWidth", "_imageHeight")}
    return nested.withColumns({**size, **{k: F.transform(F.col(k), lambda r: _scaled_region(r, by)) for k in REGION_KINDS if k in nested.columns}})


def _moved(e: Column, by: Column, *parts: str) -> Column:
    """e with the points of some of its parts scaled."""
    text = lambda s: F.when(s.isNotNull(), format_points(parse_points(s), by))
    for c in parts:
        e = e.withField(c, e[c].withField("_points", text(e[c]["_points"])))
    return e


def _scaled_region(r: Column, by: Column) -> Column:
    return _moved(r, by, "Coords").withField("TextLine", F.transform(r["TextLine"], lambda x: _moved(x, by, "Coords", "Baseline")))


def scaled_regions(regions: DataFrame, scale: Column) -> DataFrame:
    """The region table (with sizes) of the scaled pages, from that of the pages: the same numbers are scaled and cut, but no text is written and read for it."""
    points = F.col("points")
    cut = {c: (F.col(c) * scale).cast("int") for c in ("width", "height") if c in regions.columns}
    lines = F.transform("lines", lambda x: _moved(x, scale, "Coords", "Baseline"))
    return regions.withColumns({**cut, "points": scaled(points, scale), "lines": lines})


def _copies(pages: DataFrame, scale: float, rounds: int, seed: int) -> DataFrame:
    """rounds + 1 copies of rows with a page_id, named `<page_id>_<round>`, with the page's own __scale.

    The scales come from md5 of seed, round and page, so they do not depend on how pages lie or on retries.
    """

    def chance(name: str, i: int) -> Column:
        said = F.concat_ws(":", F.lit(name), F.lit(seed), F.lit(i), F.col("page_id"))
        return F.conv(F.substring(F.md5(said.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))

    def copy(i: int) -> Column:
        drawn = 1 + chance("scale", i) * F.lit(float(scale) - 1)
        return F.struct(F.lit(i).alias("__round"), F.when(chance("way", i) < 0.5, drawn).otherwise(1 / drawn).alias("__scale"))

    each = pages.select("*", F.inline(F.array(*[copy(i) for i in range(rounds + 1)])))
    return each.withColumn("page_id", F.concat_ws("_", "page_id", "__round")).drop("__round")


def randomly_scaled(nested: DataFrame, scale: float, rounds: int, seed: int) -> DataFrame:
    """rounds + 1 copies of every page, named `<page_id>_<round>`, each at a scale of its own between 1 and `scale` or, every second time, at the inverse of one."""
    return scaled_pages(_copies(nested, scale, rounds, seed), F.col("__scale")).drop("__scale")


def randomly_scaled_regions(regions: DataFrame, scale: float, rounds: int, seed: int) -> DataFrame:
    """The region table of the same copies, from that of the pages."""
    return scaled_regions(_copies(regions, scale, rounds, seed), F.col("__scale")).drop("__scale")


def scale_pages(spark: SparkSession, path: str, out: str, scale: float, rounds: int = 0, seed: int = 42) -> None:
    """Reads a folder of page files and writes them scaled; with rounds, as randomly scaled copies."""
    nested = pagexml.read_pages(spark, path)
    made = randomly_scaled(nested, scale, rounds, seed) if rounds else scaled_pages(nested, scale)
    pagexml.write_pages(rewritten(made), out)


def rewritten(nested: DataFrame) -> DataFrame:
    """page_id, xml of nested pages: regions and lines in the order that they name, else in that of the file."""
    return pagexml.nested_xml(nested)


def convert_annotations(spark: SparkSession, path: str, out: str, border: bool = False) -> None:
    """Reads a folder of page files, and writes their rasters as Parquet."""
    annotation_rasters(pagexml.read_pages(spark, path), border).write.mode("overwrite").parquet(out)
