"""Text of pages in reading order: by region, by line, as CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import ORDER


def ordered(df: DataFrame, by: list[str], custom: str = "custom", as_text: bool = False) -> DataFrame:
    """df without rows that have no reading order, with position from 0 by that order; `as_text` orders indices as strings."""
    idx = F.nullif(F.regexp_extract(custom, ORDER, 1), F.lit(""))
    key = idx if as_text else idx.cast("int")
    some = df.where(idx.isNotNull())
    return some.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(key, "ord")) - 1)


def region_rows(lines: DataFrame) -> DataFrame:
    """page, region, class, confidence (mean, null without lines), text (lines by position, joined by line ends). lines: page, region, class, position, conf, text."""
    parts = F.sort_array(F.collect_list(F.when(F.length("text") > 0, F.struct("position", "text"))))
    joined = F.array_join(F.transform(parts, lambda x: x["text"]), "\n")
    conf = F.avg(F.when(F.length("text") > 0, F.col("conf")))
    return lines.groupBy("page", "region", "class").agg(conf.alias("confidence"), joined.alias("text"))


def line_rows(lines: DataFrame) -> DataFrame:
    """page, region, line (from 1 among lines with text), class, confidence, text."""
    some = lines.where(F.length("text") > 0)
    n = F.row_number().over(Window.partitionBy("page", "region").orderBy("position"))
    return some.select("page", "region", n.alias("line"), "class", F.col("conf").alias("confidence"), "text")


def page_json(lines: DataFrame, by_line: bool = False) -> DataFrame:
    """page, json: a list of {class, text or lines} in region order."""
    parts = F.sort_array(F.collect_list(F.struct("position", "text")))
    r = lines.where(F.length("text") > 0).groupBy("page", "region", "class").agg(F.transform(parts, lambda x: x["text"]).alias("t"))
    name = "lines" if by_line else "text"
    items = F.sort_array(F.collect_list(F.struct("region", F.struct("class", F.col("t").alias(name)).alias("x"))))
    return r.groupBy("page").agg(F.to_json(F.transform(items, lambda x: x["x"])).alias("json"))


def csv_rows(rows: DataFrame) -> DataFrame:
    """value: a line of CSV for each row. Semicolons; texts are quoted, with quotes doubled, and numbers are not; null is an empty text."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    one = [quoted(F.col(f"`{c}`")) if kind == "string" else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit('""')) for c, kind in rows.dtypes]
    return rows.select(F.concat_ws(";", *one).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    """csv_rows, after a header that is the first part file."""
    head = ";".join(f'"{c}"' for c in rows.columns)
    rows.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).unionByName(csv_rows(rows)).write.mode("overwrite").text(path)


def stacked(files: dict[str, DataFrame]) -> DataFrame:
    """The rows of several exports under each other, by column name, with the name of the file that each is from."""
    out: DataFrame | None = None
    for name, rows in files.items():
        own = rows.select(F.lit(name).alias("file"), "*")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no files")
    return out


def attach_by_id(lines: DataFrame, results: DataFrame) -> DataFrame:
    """lines with the trimmed text of the last result for their id; old texts are dropped. results: page, line_id, ord, text."""
    last = results.groupBy("page", "line_id").agg(F.max_by("text", "ord").alias("__new"))
    return lines.drop("text").join(last, ["page", "line_id"], "left").withColumn("text", F.trim("__new")).drop("__new")


def attach_by_place(lines: DataFrame, results: DataFrame) -> DataFrame:
    """lines with text and the least character confidence (0 without), by region and place. results: page, region, ord, text, confs."""
    r = results.select("page", "region", "ord", F.col("text").alias("__t"), F.coalesce(F.array_min("confs"), F.lit(0.0)).alias("__c"))
    return lines.drop("text", "conf").join(r, ["page", "region", "ord"], "left").withColumnsRenamed({"__t": "text", "__c": "conf"})


def replace_text(lines: DataFrame, results: DataFrame) -> DataFrame:
    """lines whose text is replaced where the result is not empty."""
    r = results.select("page", "line_id", F.col("text").alias("__t"))
    new = F.when(F.length("__t") > 0, F.col("__t")).otherwise(F.col("text"))
    return lines.join(r, ["page", "line_id"], "left").withColumn("text", new).drop("__t")
