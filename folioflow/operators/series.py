"""Scalar series of training runs: last values, averages over repeats, throughput, re-based steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def final_values(series: DataFrame) -> DataFrame:
    """run, tag, last value by step."""
    return series.groupBy("run", "tag").agg(F.max_by("value", F.struct("step", "value")).alias("value"))


def over_runs(series: DataFrame) -> DataFrame:
    """tag, n, mean and population deviation of the runs' last values."""
    return final_values(series).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def throughput(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, mean and population deviation of batches a second."""
    return runs.withColumn("__r", F.col("batches") / F.col("duration")).groupBy(*by).agg(F.avg("__r").alias("mean"), F.stddev_pop("__r").alias("std"))


def rebased(series: DataFrame, after: int = 200) -> DataFrame:
    """series with step_new: from epoch `after` on, increments of the step count half."""
    w = Window.partitionBy("run", "tag").orderBy("step")
    inc = F.col("step") - F.coalesce(F.lag("step").over(w), F.lit(0))
    part = F.when(F.col("epoch") > after, inc / 2.0).otherwise(inc.cast("double"))
    return series.withColumn("__i", part).withColumn("step_new", F.sum("__i").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__i")
