"""A session for local work; on a cluster the session comes from outside and is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("folioflow")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
