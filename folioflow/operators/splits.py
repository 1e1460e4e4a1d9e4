"""Splits, samples and unfinished work.

Keys are ordered by their md5, which is the same everywhere and at any size. Exact cut points need ranks, not one
sorted task: keys are counted by the md5's first bytes, and only keys of the byte range that a cut falls into are
ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("Training", "Validation", "Test")


def ranked(df: DataFrame, key: str) -> DataFrame:
    """df with rank from 1 by md5 of the key, ties by the key. Buckets of four hex digits are counted, then ranked each by itself."""
    h = F.md5(F.col(key).cast("string").cast("binary"))
    df = df.withColumns({"__h": h, "__b": F.substring(h, 1, 4)})
    n = df.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))  # at most 65536 rows
    before = n.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    return df.withColumn("__i", inside).join(F.broadcast(before), "__b").withColumn("rank", F.col("__before") + F.col("__i")).drop("__h", "__b", "__n", "__before", "__i")


def split_exact(df: DataFrame, key: str, ratio: tuple[float, float, float] = (0.85, 0.05, 0.10)) -> DataFrame:
    """df with split: int(r0 n) keys, then int(r1 n), then the rest."""
    if abs(sum(ratio) - 1) > 1e-9 or min(ratio) <= 0:
        raise ValueError("ratios are positive and add up to one")
    n = df.count()
    a, b = int(ratio[0] * n), int(ratio[0] * n) + int(ratio[1] * n)
    r = F.col("rank")
    return ranked(df, key).withColumn("split", F.when(r <= a, NAMES[0]).when(r <= b, NAMES[1]).otherwise(NAMES[2])).drop("rank")


def sample(df: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """n rows without replacement, and the rest."""
    taken = ranked(df, key).where(F.col("rank") <= n).drop("rank")
    return taken, df.join(taken.select(key), key, "left_anti")


def draw(df: DataFrame, key: str, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """draw, key of n draws with replacement, each made by md5 of the seed and its number; and the rows that were never drawn."""
    total = df.count()
    h = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("draw")).cast("binary")), 1, 12)
    draws = df.sparkSession.range(n if total else 0).select(F.col("id").cast("int").alias("draw"))
    draws = draws.withColumn("rank", F.conv(h, 16, 10).cast("long") % F.lit(max(total, 1)) + 1)
    taken = draws.join(ranked(df.select(key), key), "rank").select("draw", key)
    return taken, df.join(taken.select(key).distinct(), key, "left_anti")


def fetch_commands(taken: DataFrame, key: str) -> DataFrame:
    """draw, command: the line that fetches each drawn file."""
    return taken.select("draw", F.concat(F.lit("get "), F.col(key).cast("string")).alias("command"))


def todo(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Files without a finished output; only names are compared."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def missing(files: DataFrame, targets: DataFrame, key: str) -> bool:
    return not files.join(targets, key, "left_anti").limit(1).isEmpty()


def limited(df: DataFrame, key: str, n: int | None) -> DataFrame:
    """The first n rows by key; without n all."""
    return df if n is None else df.orderBy(key).limit(n)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def log_rows(results: DataFrame, stage: str) -> DataFrame:
    """stage, page_id, status, error of one run: a page with an error has failed. results: page_id, error."""
    return results.select(F.lit(stage).alias("stage"), "page_id", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error")


def log_work(rows: DataFrame, path: str) -> None:
    """Appends (stage, page_id, status, error) rows to the work log."""
    rows.select("stage", "page_id", "status", "error").write.mode("append").parquet(path)


def logged(log: DataFrame) -> DataFrame:
    """stage, status, n of the log: a page that was done in any run is done."""
    each = log.groupBy("stage", "page_id").agg(F.min("status").alias("status"))  # done comes before failed
    return each.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"))


def mismatched(images: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """key, width, height, target_width, target_height of the pairs whose sizes differ. Both sides: key, width, height."""
    other = targets.select(key, F.col("width").alias("target_width"), F.col("height").alias("target_height"))
    return images.select(key, "width", "height").join(other, key).where("width <> target_width or height <> target_height")
