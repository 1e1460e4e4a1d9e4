"""Page annotations in two XML dialects, as flat tables, and back.

The first dialect (PAGE) has region elements of five kinds with `custom` attributes and coordinate strings; the second
(HLNA) has `type` attributes and Point children. Pages are read once with a fixed schema; land the tables in Parquet
before analysing them, XML cannot be filtered at the source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import bbox, format_points, moved, parse_points
from ..functions.layout import class_tag, order_index, region_class
from ..schema import ELEMENTS, REGION_KINDS, TEXT_CLASSES

LINE = "struct<_id:string,_custom:string,Coords:struct<_points:string>,Baseline:struct<_points:string>,TextEquiv:struct<_conf:string,Unicode:string>>"
REGION = f"struct<_id:string,_custom:string,Coords:struct<_points:string>,TextLine:array<{LINE}>>"
PAGE_SCHEMA = "_imageFilename string, _imageWidth int, _imageHeight int, " + ", ".join(f"{k} array<{REGION}>" for k in REGION_KINDS)
HLNA_SHAPE = "struct<_id:string,_type:string,Coords:struct<Point:array<struct<_x:int,_y:int>>>>"
HLNA_SCHEMA = f"_imageFilename string, _imageWidth int, _imageHeight int, TextRegion array<{HLNA_SHAPE}>, SeparatorRegion array<{HLNA_SHAPE}>"


def _stem() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), "\\.[^.]*$", "")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id (file stem) and the nested page of each file."""
    return spark.read.format("xml").option("rowTag", "Page").schema(PAGE_SCHEMA).load(path).select(_stem().alias("page_id"), "*")


def parse_pages(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """The same from a string column, one Page element each; pages keep their page_id."""
    df = pages.select("page_id", F.from_xml(F.col(xml), PAGE_SCHEMA).alias("x"))
    return df.select("page_id", "x.*")


def page_body(xml: Column) -> Column:
    """The Page element of a document."""
    return F.regexp_extract(xml, "(?s)(<Page[ >].*</Page>)", 1)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """The same of what write_pages wrote."""
    return parse_pages(spark.read.parquet(path).select("page_id", page_body(F.col("xml")).alias("xml")))


def page_table(nested: DataFrame) -> DataFrame:
    return nested.select("page_id", F.col("_imageFilename").alias("image_filename"), F.col("_imageWidth").alias("width"), F.col("_imageHeight").alias("height"))


def _kinds() -> Column:
    """The regions of a nested page, kind by kind in one array."""

    def tagged(kind: str) -> Column:
        some = F.coalesce(F.col(kind), F.array().cast(f"array<{REGION}>"))
        return F.transform(some, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("r")))

    return F.concat(*[tagged(k) for k in REGION_KINDS])


def region_table(nested: DataFrame, sizes: bool = False) -> DataFrame:
    """page_id, region_id, ord (in kind order), kind, class, tag, reading_order, points, custom, lines, and with sizes the page's width and height. One pass over the page: the kinds are one array before they are rows."""
    page = [F.col("_imageWidth").alias("width"), F.col("_imageHeight").alias("height")] if sizes else []
    df = nested.select("page_id", *page, F.posexplode(_kinds()).alias("ord", "x"))
    c = F.col("x.r._custom")
    return df.select("page_id", *(["width", "height"] if sizes else []), F.col("x.r._id").alias("region_id"), "ord", F.col("x.kind").alias("kind"), region_class(c, F.col("x.kind")).alias("class"), class_tag(c).alias("tag"), order_index(c).alias("reading_order"), parse_points(F.col("x.r.Coords._points")).alias("points"), c.alias("custom"), F.col("x.r.TextLine").alias("lines"))


def line_table(regions: DataFrame) -> DataFrame:
    """page_id, region_id, class, region_ord, line_id, ord, reading_order, points, baseline, text, conf of the lines of text regions."""
    df = regions.where("kind = 'TextRegion'").select("page_id", "region_id", F.coalesce("tag", F.lit("UnknownRegion")).alias("class"), F.col("ord").alias("region_ord"), F.posexplode("lines").alias("ord", "l"))
    points = lambda c: parse_points(F.col(f"l.{c}._points"))
    return df.select("page_id", "region_id", "class", "region_ord", F.col("l._id").alias("line_id"), "ord", order_index(F.col("l._custom")).alias("reading_order"), points("Coords").alias("points"), points("Baseline").alias("baseline"), F.nullif(F.col("l.TextEquiv.Unicode"), F.lit("")).alias("text"), F.col("l.TextEquiv._conf").cast("double").alias("conf"))


def baseline_scan(regions: DataFrame) -> DataFrame:
    """page_id, region_id, ord, is_mask, points, lines: what baseline detection learns from. Text regions with a box of some size and a line or more, and table regions as masks; points as (y, x)."""
    b = bbox(F.col("points"))
    sized = (F.size("points") > 0) & (b["minx"] < b["maxx"]) & (b["miny"] < b["maxy"])
    table = F.col("kind") == "TableRegion"
    df = regions.where(sized & (table | ((F.col("kind") == "TextRegion") & (F.size("lines") > 0))))
    flipped = F.transform("points", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))
    return df.select("page_id", "region_id", "ord", table.alias("is_mask"), flipped.alias("points"), F.when(~table, F.col("lines")).alias("lines"))


def layout_masks(regions: DataFrame) -> DataFrame:
    """page_id, masks, rois: a page's table polygons, which hide pixels, and its text polygons, which are looked at, each in order."""
    item = F.struct("ord", "points")
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, item))), lambda x: x["points"])
    return regions.where(F.size("points") > 0).groupBy("page_id").agg(of("TableRegion").alias("masks"), of("TextRegion").alias("rois"))


def padded_baselines(lines: DataFrame, margin: int) -> DataFrame:
    """lines without their texts, points and baselines moved by the margin that pads the page's image on each side."""
    move = lambda c: moved(F.col(c), margin, margin).alias(c)
    return lines.where(F.size("baseline") > 0).drop("text", "conf").select(*[move(c) if c in ("points", "baseline") else F.col(c) for c in lines.columns if c not in ("text", "conf")])


def polygons(regions: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Regions with more than two points, of the classes given, with their boxes."""
    df = regions.where(F.size("points") > 2)
    df = df if classes is None else df.where(F.col("class").isin(classes))
    return df.select("page_id", "region_id", "ord", "class", "points", *[v.alias(k) for k, v in bbox(F.col("points")).items()])


def text_polygons(lines: DataFrame, with_text: bool = False) -> DataFrame:
    """Lines of text classes; `with_text` leaves those without out."""
    df = lines.where(F.col("class").isin(TEXT_CLASSES))
    return df.where("text is not null") if with_text else df


def parse_hlna(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """hlna_table of a string column, one Page element each."""
    return hlna_table(pages.select("page_id", F.from_xml(F.col(xml), HLNA_SCHEMA).alias("x")).select("page_id", "x.*"))


def read_hlna(spark: SparkSession, path: str) -> DataFrame:
    """hlna_table of a folder of files."""
    return hlna_table(spark.read.format("xml").option("rowTag", "Page").schema(HLNA_SCHEMA).load(path).select(_stem().alias("page_id"), "*"))


def hlna_table(df: DataFrame) -> DataFrame:
    """page_id, width, height, region_id, ord, class, points of the second dialect. Every separator counts as vertical."""
    none = F.array().cast(f"array<{HLNA_SHAPE}>")
    # The dialect's types.
    known = F.create_map(F.lit("heading"), F.lit("heading"), F.lit("paragraph"), F.lit("article"), F.lit("header"), F.lit("header"))
    text = F.transform(F.coalesce("TextRegion", none), lambda r: F.struct(F.coalesce(F.try_element_at(known, r["_type"]), F.lit("UnknownRegion")).alias("class"), r.alias("r")))
    lines = F.transform(F.coalesce("SeparatorRegion", none), lambda r: F.struct(F.lit("separator_vertical").alias("class"), r.alias("r")))
    df = df.select("page_id", F.col("_imageWidth").alias("width"), F.col("_imageHeight").alias("height"), F.posexplode(F.concat(text, lines)).alias("ord", "x"))
    return df.select("page_id", "width", "height", F.col("x.r._id").alias("region_id"), "ord", F.col("x.class").alias("class"), F.transform("x.r.Coords.Point", lambda p: F.struct(p["_x"].alias("x"), p["_y"].alias("y"))).alias("points"))


def predicted_lines(lines: DataFrame) -> DataFrame:
    """lines as page_xml takes them, with ids "<region>_tl_<i>" by position: they take the place of a region's own lines. lines: page_id, region_id, position, points, baseline."""
    return lines.select("page_id", "region_id", F.format_string("%s_tl_%d", "region_id", "position").alias("line_id"), "position", "points", "baseline", F.lit(None).cast("string").alias("text"))


def reordered(regions: DataFrame, order: DataFrame) -> DataFrame:
    """regions with the position that order (page_id, region_id, position) gives them; regions outside the order are lost."""
    return regions.drop("position").join(order.select("page_id", "region_id", "position"), ["page_id", "region_id"])


def _escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _attr(name: str, v: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), _escaped(v), F.lit('"'))


def _line_xml(get: Callable[[str], Column]) -> Column:
    """The element of a line; get gives its line_id, position, points, baseline and text."""
    base = F.when(get("baseline").isNotNull(), F.concat(F.lit("<Baseline"), _attr("points", format_points(get("baseline"))), F.lit("/>"))).otherwise("")
    text = F.when(get("text").isNotNull(), F.concat(F.lit("<TextEquiv><Unicode>"), _escaped(get("text")), F.lit("</Unicode></TextEquiv>"))).otherwise("")
    order = F.concat(F.lit("readingOrder {index:"), get("position").cast("string"), F.lit(";}"))
    return F.concat(F.lit("<TextLine"), _attr("id", get("line_id")), _attr("custom", order), F.lit("><Coords"), _attr("points", format_points(get("points"))), F.lit("/>"), base, text, F.lit("</TextLine>"))


def _joined(items: Column, part: str) -> Column:
    """The parts of items in their order."""
    return F.array_join(F.transform(items, lambda x: x[part]), "")


def _inner(lines: Column) -> Column:
    """The elements of an array of lines, by position; none for null."""
    made = F.transform(lines, lambda x: F.struct(x["position"].alias("position"), _line_xml(lambda c: x[c]).alias("x")))
    return F.coalesce(_joined(F.sort_array(made), "x"), F.lit(""))


def _region_item(get: Callable[[str], Column], kind: Column, inner: Column) -> Column:
    """position, ref and body of a region; get gives its region_id, position, class and points."""
    position = get("position").cast("string")
    custom = F.concat(F.lit("readingOrder {index:"), position, F.lit(";} structure {type:"), F.coalesce(get("class"), F.lit("null")), F.lit(";}"))
    body = F.concat(F.lit("<"), kind, _attr("id", get("region_id")), _attr("custom", custom), F.lit("><Coords"), _attr("points", format_points(get("points"))), F.lit("/>"), inner, F.lit("</"), kind, F.lit(">"))
    ref = F.concat(F.lit("<RegionRefIndexed"), _attr("index", position), _attr("regionRef", get("region_id")), F.lit("/>"))
    return F.struct(get("position").alias("position"), ref.alias("ref"), body.alias("body"))


def _element(name: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in ELEMENTS.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, name), F.lit("UnknownRegion"))


def _document(image: Column, width: Column, height: Column, items: Column) -> Column:
    """A document of region items in their order; a column, as it is named three times."""
    order = F.when(F.size(items) > 0, F.concat(F.lit('<ReadingOrder><OrderedGroup id="ro">'), _joined(items, "ref"), F.lit("</OrderedGroup></ReadingOrder>"), _joined(items, "body"))).otherwise("")
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"><Page'), _attr("imageFilename", image), _attr("imageWidth", width.cast("string")), _attr("imageHeight", height.cast("string")), F.lit(">"))
    return F.concat(head, order, F.lit("</Page></PcGts>"))


def page_xml(pages: DataFrame, regions: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """page_id, xml: a document for each page, reading order first, regions by position. regions: page_id, region_id, position, class, points and, to keep an element, kind; lines: page_id, region_id, line_id, position, points, baseline, text, or a column of regions, lines, as an array of the same.

    Regions and lines meet in groupings by page, so nothing is shuffled that lies by page.
    """
    kind = _element(F.col("class"))
    kind = F.coalesce("kind", kind) if "kind" in regions.columns else kind
    inner = _inner(F.col("lines")) if "lines" in regions.columns and lines is None else F.lit("")
    if lines is not None:
        own = F.struct(F.col("position").alias("position"), F.col("class").alias("class"), F.col("points").alias("points"), kind.alias("kind"))
        fields = F.struct(*[F.col(c).alias(c) for c in ("line_id", "position", "points", "baseline", "text")])
        none = lambda df, c: F.lit(None).cast(df.select(c.alias("s")).schema["s"].dataType)
        one = regions.select("page_id", "region_id", own.alias("own"), none(lines, fields).alias("line"))
        two = lines.where("page_id is not null and region_id is not null").select("page_id", "region_id", none(regions, own).alias("own"), fields.alias("line"))
        met = one.unionByName(two).groupBy("page_id", "region_id").agg(F.collect_list("own").alias("own"), F.collect_list("line").alias("lines"))
        # apart from the explode: beside a generator, fields named in functions of arrays lose their names
        met = met.select("page_id", "region_id", _inner(F.col("lines")).alias("inner"), "own")
        regions = met.select("page_id", "region_id", "inner", F.explode("own").alias("own")).select("page_id", "region_id", "inner", "own.*")
        kind, inner = F.col("kind"), F.col("inner")
    rows = regions.groupBy("page_id").agg(F.sort_array(F.collect_list(_region_item(F.col, kind, inner))).alias("x"))
    full = pages.join(rows, "page_id", "left")
    return full.select("page_id", _document(F.col("image_filename"), F.col("width"), F.col("height"), F.col("x")).alias("xml"))


def nested_xml(nested: DataFrame, positions: Column | None = None) -> DataFrame:
    """page_id, xml of nested pages. It is a projection: no region or line becomes a row.

    positions: each region's position by its place among all of the page's (the ord of region_table); regions with none
    are lost. Without it, and for lines, the index that they name, else the place in the file.
    """
    place = lambda index, i: F.when(index >= 0, index).otherwise(i)
    # in steps: what a function of arrays names twice, it works out twice

    def line(x: Column, i: Column) -> Column:
        said = F.nullif(x["TextEquiv"]["Unicode"], F.lit(""))
        return F.struct(order_index(x["_custom"]).alias("index"), i.alias("i"), x["_id"].alias("line_id"), parse_points(x["Coords"]["_points"]).alias("points"), parse_points(x["Baseline"]["_points"]).alias("baseline"), said.alias("text"))

    def placed(x: Column) -> Column:
        return F.struct(place(x["index"], x["i"]).alias("position"), *[x[c].alias(c) for c in ("line_id", "points", "baseline", "text")])

    def region(x: Column, i: Column) -> Column:
        r, c = x["r"], x["r"]["_custom"]
        index = order_index(c) if positions is None else F.get(positions, i)
        lines = F.when(x["kind"] == "TextRegion", F.transform(F.transform(r["TextLine"], line), placed))
        return F.struct(index.alias("index"), i.alias("i"), x["kind"].alias("kind"), r["_id"].alias("region_id"), F.coalesce(class_tag(c), region_class(c, x["kind"])).alias("class"), parse_points(r["Coords"]["_points"]).alias("points"), lines.alias("lines"))

    def item(x: Column) -> Column:
        parts = {"position": place(x["index"], x["i"]) if positions is None else x["index"], **{c: x[c] for c in ("region_id", "class", "points")}}
        return _region_item(parts.__getitem__, x["kind"], _inner(x["lines"]))

    page = ["page_id", "_imageFilename", "_imageWidth", "_imageHeight"]
    some = nested.select(*page, F.transform(_kinds(), region).alias("x"))
    if positions is not None:
        some = some.withColumn("x", F.filter("x", lambda x: x["index"].isNotNull()))
    items = some.select(*page, F.sort_array(F.transform("x", item)).alias("x"))
    return items.select("page_id", _document(F.col("_imageFilename"), F.col("_imageWidth"), F.col("_imageHeight"), F.col("x")).alias("xml"))


def write_pages(xml: DataFrame, path: str, folders: int = 256) -> None:
    """page_id and xml as Parquet in a bounded number of folders by the id's hash, so that a page is found in one of them."""
    folder = F.pmod(F.xxhash64("page_id"), F.lit(folders)).cast("int")
    xml.select("page_id", "xml", folder.alias("folder")).repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(path)
