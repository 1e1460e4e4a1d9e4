"""File lists, splits, boxes and metric series."""

from __future__ import annotations

from pyspark.sql import Window, Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layout import alias_of
from ..functions.tokens import stem

# The suffixes of each data source's images and targets.
SUFFIXES = {"transkribus": (".jpg", ".npz"), "HLNA2013": (".tif", ".npz"), "other": (".png", ".npz")}


def stems(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """path, stem of the files with an extension; contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", "true").load(path)
    return df.select("path", stem(F.col("path"), len(extension)).alias("stem"))


def suffixes(source: str) -> tuple[str, str]:
    return SUFFIXES.get(source, SUFFIXES["other"])


def file_names(source: Column, page_id: Column) -> dict[str, Column]:
    """image and target file names of a page by the source of its data; one source has a prefix before its targets."""
    table = F.create_map(*[F.lit(x) for k, v in SUFFIXES.items() if k != "other" for x in (k, F.array(*map(F.lit, v)))])
    own = F.coalesce(F.try_element_at(table, source), F.array(*map(F.lit, SUFFIXES["other"])))
    prefix = F.when(source == "HLNA2013", "pc-").otherwise("")
    return {"image": F.concat(page_id, own[0]), "target": F.concat(prefix, page_id, own[1])}


def parse_split(df: DataFrame, value: str = "value") -> DataFrame:
    """split, page_id, and the other columns of df, of JSON objects {split: [stem, ...]}."""
    others = [c for c in df.columns if c != value]
    df = df.select(*others, F.explode(F.from_json(value, "map<string,array<string>>")).alias("split", "ids"))
    return df.select(*others, "split", F.explode("ids").alias("page_id"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """split, page_id of a file with such an object."""
    return parse_split(spark.read.text(path, wholetext=True))


def split_json(splits: DataFrame) -> DataFrame:
    """One row: the JSON object of split, page_id rows, ids in order."""
    ids = splits.groupBy("split").agg(F.sort_array(F.collect_list("page_id")).alias("ids"))
    return ids.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "ids"))))).alias("json"))


BOXES = "bboxes array<struct<id:string,class:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"


def box_rows(df: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """page_id, class (by its alias; others leave, and those not among `classes`), minx, miny, maxx, maxy. df: page_id and bboxes."""
    df = df.select("page_id", F.explode("bboxes").alias("b"))
    df = df.select("page_id", alias_of(F.col("b.class")).alias("class"), F.col("b.bbox.x0").alias("minx"), F.col("b.bbox.y0").alias("miny"), F.col("b.bbox.x1").alias("maxx"), F.col("b.bbox.y1").alias("maxy"))
    return df.where(F.col("class").isin(classes) if classes else F.col("class").isNotNull())


def parse_boxes(df: DataFrame, value: str = "value", classes: list[str] | None = None) -> DataFrame:
    """The same of JSON texts beside their page_id."""
    return box_rows(df.select("page_id", F.from_json(value, BOXES).alias("j")).select("page_id", "j.bboxes"), classes)


def read_boxes(spark: SparkSession, path: str, classes: list[str] | None = None) -> DataFrame:
    """The same of files named by page."""
    df = spark.read.option("multiLine", True).schema(BOXES).json(path)
    return box_rows(df.select(F.regexp_replace(F.col("_metadata.file_name"), "\\.json$", "").alias("page_id"), "bboxes"), classes)


def boxes_json(boxes: DataFrame) -> DataFrame:
    """page_id, value: a page's boxes as such a text, in order. boxes: page_id, ord, class, minx, miny, maxx, maxy."""
    corner = F.struct(*[F.col(c).alias(k) for c, k in zip(("minx", "miny", "maxx", "maxy"), ("x0", "y0", "x1", "y1"), strict=True)])
    one = F.struct(F.col("ord").cast("string").alias("id"), "class", corner.alias("bbox"))
    rows = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ord", one.alias("b")))).alias("x"))
    return rows.select("page_id", F.to_json(F.struct(F.transform("x", lambda x: x["b"]).alias("bboxes"))).alias("value"))


def label_files(boxes: DataFrame) -> DataFrame:
    """page_id, value: a page's label file, a line for each box in order. boxes: page_id, ord, line."""
    rows = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("x"))
    return rows.select("page_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("value"))


def dataset_yaml(boxes: DataFrame, root: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """line, value: the description of a data set of label files. boxes: id and name of each box's class; classes are few."""
    head = [f"path: {root}", *(f"{s}: images/{s}" for s in splits), "names:"]
    top = boxes.sparkSession.createDataFrame(list(enumerate(head)), "line int, value string")
    names = boxes.select("id", "name").distinct()
    line = F.row_number().over(Window.orderBy("id")) + len(head) - 1
    return top.unionByName(names.select(line.alias("line"), F.format_string("  %d: %s", "id", "name").alias("value")))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """run, tag (from the folders run=.../tag=...), wall, step, value."""
    return spark.read.schema("wall double, step long, value double, run string, tag string").option("header", True).csv(path)


def read_throughput(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """name, duration, per_second of JSON lists of durations."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.explode(F.from_json("value", "array<double>")).alias("duration"))
    return df.select("name", "duration", (F.lit(batches) / F.col("duration")).alias("per_second"))


def images_only(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value names a jpg or jpeg."""
    return df.where(F.col(value).rlike("\\.jpe?g$"))


def image_list(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file list that name a jpg or jpeg."""
    return images_only(spark.read.text(path)).select(F.col("value").alias("path"))


def images_with_lines(images: DataFrame, lines: DataFrame) -> DataFrame:
    """lines, each with its page's image content, by the stem of the image file. images: path, content, as the binaryFile source gives them."""
    of = F.regexp_replace(F.substring_index("path", "/", -1), "\\.[^.]*$", "")
    return lines.join(images.select(of.alias("page_id"), "content"), "page_id")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
