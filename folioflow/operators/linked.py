"""Connected components of links between any ordered ids, and tables kept in the shared folder to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Where each table that kept returned lies, as long as it is in use.
_WRITTEN: dict[int, tuple[str, weakref.finalize]] = {}


def kept(df: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """df, computed once, written as Parquet to the folder that spark.checkpoint.dir names, and read back; only a session of one JVM may do without.

    gone: a table of an earlier round that kept returned and that nothing needs once df is written; it is removed.
    """
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioflow-"))
        found = spark.sparkContext.getCheckpointDir()
    path = f"{found.rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if gone is not None and (old := _WRITTEN.pop(id(gone), None)):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old[0])
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (path, weakref.finalize(out, _WRITTEN.pop, id(out), None))
    return out


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every id that links a, b join to another.

    In each round an id and the id that labels it take the least label among the id's neighbours, and then the label of
    that label, so what is known of a component travels twice as far each time. A round is two joins and an aggregation,
    is written, and the last one changes nothing.
    """
    sides = links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.*").distinct()
    sides = kept(sides)
    table = now = kept(sides.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        lower = now.withColumnRenamed("id", "b").withColumnRenamed("component", "c")
        near = sides.join(lower, "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("least"))
        own = now.join(near, "id").select("id", "component", F.least("component", "least").alias("least"))
        told = own.select("id", "least").unionByName(own.select(F.col("component").alias("id"), "least"))
        mid = now.join(told.groupBy("id").agg(F.min("least").alias("mid")), "id").select("id", F.col("component").alias("was"), F.least("component", "mid").alias("mid"))
        beyond = now.select(F.col("id").alias("mid"), F.col("component").alias("beyond"))
        table = kept(mid.join(beyond, "mid").select("id", "was", F.least("mid", "beyond").alias("component")), gone=table)
        now = table.select("id", "component")
        if table.where("component <> was").isEmpty():
            return now
