"""Line dedup by site-relative frequency: a line goes when more than `ratio` of its host's pages contain it.

DataFrame expressions only. Each page sends a 96-bit fingerprint of each of its distinct lines, never the text; counts
are added up before and after the shuffle, so a hot host or a line on every page costs one row for each task. A host's
boilerplate lines number at most (lines of its pages) / (ratio * pages), so their list for a host is short whatever
the host's size; the lists join the pages by host. They are measured first and broadcast only while they are small,
so texts are not shuffled; beyond that the join is by host, and Spark's adaptive skew join splits hot hosts. A list is
kept in `PARTS` parts by hash, so a page's line is compared with a 64th of it.

Defined cases: a null text stays null and an empty one empty; lines without a word are kept and never counted; a null
host is a host of its own; hosts with fewer than `min_pages` pages lose nothing; a line must be on `min_pages` pages;
repeated rows are pages each; a page whose lines all go keeps an empty text; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, small, staged


PARTS = 64


def fingerprint(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.crc32(line.cast("binary")).alias("c"))


def part(fp: Column) -> Column:
    return F.pmod(fp["h"], F.lit(PARTS)).cast("int")


def in_parts(fps: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.filter(fps, lambda x: part(x) == i))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.08, min_pages: int = 5) -> DataFrame:
    """__host, __lines: the fingerprints of each host's boilerplate lines in PARTS lists by hash, for hosts that have any."""
    h = F.col(f"`{host}`").alias("__host")
    pages = docs.groupBy(h).agg(F.count(F.lit(1)).alias("__pages")).where(F.col("__pages") >= min_pages)
    own = F.array_distinct(F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x: x.rlike(WORD)))
    lines = docs.select(h, F.explode(F.transform(own, fingerprint)).alias("__line"))
    on = lines.groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__on")).where(F.col("__on") >= min_pages)
    met = on.join(pages.withColumnRenamed("__host", "__of"), F.col("__host").eqNullSafe(F.col("__of")))
    return met.where(F.col("__on") > F.col("__pages") * ratio).groupBy("__host").agg(F.collect_list("__line").alias("__all")).select("__host", in_parts(F.col("__all")).alias("__lines"))


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.08, min_pages: int = 5) -> DataFrame:
    """docs with its texts freed of boilerplate lines; columns and rows stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))  # names cannot clash
    found = staged(boilerplate(docs.select(F.col(f"`{host}`").alias("h"), F.col(f"`{text}`").alias("t")), "h", "t", ratio, min_pages), "boilerplate")
    size = F.aggregate("__lines", F.lit(64 + 16 * PARTS), lambda n, x: n + 16 * F.size(x)) + F.coalesce(F.octet_length("__host"), F.lit(0))
    met = rows.join(small(found, size), F.col("__row")[host].eqNullSafe(F.col("__host")), "left")
    t = F.col("__row")[text]
    keep = F.filter(F.split(t, "\n"), lambda x: ~F.coalesce(F.array_contains(F.get("__lines", part(fingerprint(x))), fingerprint(x)), F.lit(False)))
    clean = F.when(F.col("__lines").isNull(), t).otherwise(F.array_join(keep, "\n"))
    return met.select(*[clean.alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns])
