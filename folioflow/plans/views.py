"""Adapter views: the sample tables dressed as page annotations, in Spark and in DuckDB SQL.

A page is an order, a region an order's line; coordinates are whole-number arithmetic on its keys, so both engines
agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.paged import tasks


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it comes in few partitions (a small file is one): for costly expressions on small inputs. Large inputs are not shuffled."""
    cores = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


ORD = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, ord, label, minx, miny, maxx, maxy, partkey."""
    # named before the window, so that Spark knows that what comes out lies by page: later windows and groups need no shuffle
    df = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if (n := tasks(df.count(), parts)) > parts:  # counted from the files' footers
        df = df.repartition(n, "page")
    ord_ = F.row_number().over(Window.partitionBy("page").orderBy(*ORD)) - 1
    label = (F.col("l_partkey") % 9 + 1).cast("int")
    df = df.select("page", ord_.alias("ord"), label.alias("label"), F.expr("int(1000 * (l_suppkey % 4) + l_partkey % 40)").alias("minx"), F.expr("int(37 * (l_partkey % 97))").alias("miny"), F.when(label == 7, F.expr("int(1000 * (1 + l_linenumber % 4))")).otherwise(F.expr("int(900 + l_partkey % 150)")).alias("w"), F.expr("20 + int(l_quantity) * 10").alias("h"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"))
    return df.select("page", "ord", "label", "minx", "miny", (F.col("minx") + F.col("w")).alias("maxx"), (F.col("miny") + F.col("h")).alias("maxy"), "partkey", "suppkey")


REGIONS = f"""regions AS (SELECT page, ord, label, minx, miny, minx + w AS maxx, miny + h AS maxy, partkey, suppkey FROM (
 SELECT l_orderkey AS page, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORD)}) - 1)::INT AS ord, (1 + l_partkey % 9)::INT AS label,
 (1000 * (l_suppkey % 4) + l_partkey % 40)::INT AS minx, (37 * (l_partkey % 97))::INT AS miny,
 (CASE WHEN 1 + l_partkey % 9 = 7 THEN 1000 * (1 + l_linenumber % 4) ELSE 900 + l_partkey % 150 END)::INT AS w, (20 + l_quantity::INT * 10)::INT AS h, l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem))"""


def predicted(regs: DataFrame, *more: str) -> DataFrame:
    """Regions as a model might find them: moved, some missing, some of another class; and more columns as they are."""
    dx, dy = F.expr("int((suppkey % 7 - 3) * 10)"), F.expr("int((partkey % 5 - 2) * 8)")
    label = F.when(F.col("partkey") % 13 == 0, F.col("label") % 9 + 1).otherwise(F.col("label"))
    return regs.where("partkey % 11 <> 0").select("page", "ord", label.alias("label"), (F.col("minx") + dx).alias("minx"), (F.col("miny") + dy).alias("miny"), (F.col("maxx") + dx).alias("maxx"), (F.col("maxy") + dy).alias("maxy"), *more)


PREDICTED = """predicted AS (SELECT page, ord, CASE WHEN partkey % 13 = 0 THEN label % 9 + 1 ELSE label END AS label,
 minx + ((suppkey % 7 - 3) * 10)::INT AS minx, miny + ((partkey % 5 - 2) * 8)::INT AS miny, maxx + ((suppkey % 7 - 3) * 10)::INT AS maxx, maxy + ((partkey % 5 - 2) * 8)::INT AS maxy
 FROM regions WHERE partkey % 11 <> 0)"""


def point_strings(regs: DataFrame) -> DataFrame:
    """page, ord, points: the corners as the page format writes them."""
    c = lambda x, y: F.concat(F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"))
    return regs.select("page", "ord", "label", F.concat_ws(" ", c("minx", "miny"), c("maxx", "miny"), c("maxx", "maxy"), c("minx", "maxy")).alias("points"))


POINTS = "points AS (SELECT page, ord, label, concat_ws(' ', minx || ',' || miny, maxx || ',' || miny, maxx || ',' || maxy, minx || ',' || maxy) AS points FROM regions)"


def customs(regs: DataFrame) -> DataFrame:
    """page, ord, kind, custom: annotations with and without order and class."""
    names = F.array(*[F.lit(x) for x in ("paragraph", "heading", "separator_vertical", "article", "unskd", "caption", "image")])
    cls = F.get(names, (F.col("partkey") % 7).cast("int"))
    custom = F.when(F.col("partkey") % 5 == 0, F.format_string("structure {type:%s;}", cls)).when(F.col("partkey") % 5 == 1, F.format_string("readingOrder {index:%d;}", F.col("ord"))).otherwise(F.format_string("readingOrder {index:%d;} structure {type:%s;}", F.col("ord"), cls))
    kind = F.get(F.array(*[F.lit(x) for x in ("TextRegion", "GraphicRegion", "SeparatorRegion", "ImageRegion")]), (F.col("suppkey") % 4).cast("int"))
    return regs.select("page", "ord", kind.alias("kind"), custom.alias("custom"))


CUSTOMS = """customs AS (SELECT page, ord, ['TextRegion', 'GraphicRegion', 'SeparatorRegion', 'ImageRegion'][1 + suppkey % 4] AS kind,
 CASE WHEN partkey % 5 = 0 THEN 'structure {type:' || c || ';}' WHEN partkey % 5 = 1 THEN 'readingOrder {index:' || ord || ';}' ELSE 'readingOrder {index:' || ord || ';} structure {type:' || c || ';}' END AS custom
 FROM (SELECT *, ['paragraph', 'heading', 'separator_vertical', 'article', 'unskd', 'caption', 'image'][1 + partkey % 7] AS c FROM regions))"""


def whole_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line, g (a line), o (what a recogniser might read), for whole texts."""
    df = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "g"))
    n = F.length("g")
    o = F.when(n % 3 == 0, F.translate("g", "eis", "cl5")).when((n % 5 == 0) & (n > 0), F.expr("substring(g, 1, length(g) - 1)")).otherwise(F.col("g"))
    return df.withColumn("o", o)


WHOLE_LINES = r"""tl AS (SELECT doc_id, line, g, CASE WHEN length(g) % 3 = 0 THEN translate(g, 'eis', 'cl5') WHEN length(g) % 5 = 0 AND length(g) > 0 THEN g[1:length(g) - 1] ELSE g END AS o FROM (
 SELECT doc_id, (i - 1)::INT AS line, t[i] AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, target, score: ten class scores for each vector."""
    df = read(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("target"), F.slice("embedding", 1, 10).cast("array<double>").alias("score"))


SCORES = "scores AS (SELECT vec_id AS id, label::INT AS target, embedding[1:10]::DOUBLE[] AS score FROM embeddings)"
