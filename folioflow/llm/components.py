"""Connected components of a link table, by alternating large and small stars over DataFrames, and roots of a forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear, mark, staged


def roots(parents: DataFrame) -> DataFrame:
    """id, component (the root of its tree) of every id in a forest: rows (a, b), b's one parent is a, a < b.

    Pointer jumping: each round every id takes its parent's parent, so rounds go with the logarithm of the depth; a
    round is one join, whose hot side (the children of one parent) adaptive execution splits. Roots are not returned.
    """
    spark = parents.sparkSession
    e = staged(parents.select(F.col("b").alias("id"), F.col("a").alias("component"), F.lit(True).alias("open")), "forest")
    while True:
        up = e.select(F.col("id").alias("of"), F.col("component").alias("next"))
        at = mark(spark)
        met = e.where("open").join(up, F.col("component") == F.col("of"), "left")
        now = met.select("id", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("open"))
        e = staged(now.unionByName(e.where("not open")), "forest")
        if e.where("open").isEmpty():
            clear(spark, at - 1, keep=1)
            return e.select("id", "component")
        clear(spark, at - 1, keep=1)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (smallest id reachable) of every id with a link to another.

    Each round points every id at the smallest id among its neighbours: first its larger neighbours, then its smaller
    ones. Rounds go with the logarithm of the longest path; each is written to the shared folder, so lineage stays
    short, and the round before is removed. Neighbour lists are never gathered: a round is a minimum by id and a join,
    which splits hot ids. Self-links, nulls and repeated links change nothing.
    """
    spark = links.sparkSession
    e = links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x <> y").distinct()
    e = staged(e, "links")
    was = None
    while True:
        at = mark(spark)
        # large star: every larger neighbour of u points at the least of u's neighbours and u
        both = e.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("y").alias("v")), F.struct(F.col("y").alias("u"), F.col("x").alias("v")))).alias("p")).select("p.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        # small star: u and its smaller neighbours point at the least of them
        low = big.groupBy("x").agg(F.min("y").alias("m"))
        small = big.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y")
        e = staged(small.unionByName(low.select("x", F.col("m").alias("y"))).distinct(), "stars")
        clear(spark, at - 1, keep=1)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == was:
            return e.select(F.col("x").alias("id"), F.col("y").alias("component")).unionByName(e.select(F.col("y").alias("id"), F.col("y").alias("component")).distinct())
        was = now
