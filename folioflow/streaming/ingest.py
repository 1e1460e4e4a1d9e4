"""Incremental ingestion: new page files become table rows exactly once.

The stream's checkpoint is the log of finished files; a run takes what is new and stops.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pagexml import page_body, page_table, parse_pages, region_table


def new_pages(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    """page_id, xml of page files as they come."""
    df = spark.readStream.format("text").schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(path)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), "\\.xml$", "").alias("page_id"), page_body(F.col("value")).alias("xml"))


def _put(out: str, each: Callable[[DataFrame], DataFrame] | None) -> Callable[[DataFrame, int], None]:
    def put(batch: DataFrame, epoch: int) -> None:
        nested = parse_pages(batch)
        good = nested.where("_imageWidth is not null")
        regions = region_table(good).drop("lines")
        (each(regions) if each else regions).write.mode("overwrite").parquet(f"{out}/regions/epoch={epoch}")
        page_table(good).write.mode("overwrite").parquet(f"{out}/pages/epoch={epoch}")
        status = F.when(F.col("_imageWidth").isNull(), "failed").otherwise("done")
        log = nested.select(F.lit("ingest").alias("stage"), "page_id", status.alias("status"), F.when(status == "failed", "no page element").alias("error"))
        log.write.mode("overwrite").parquet(f"{out}/work_log/epoch={epoch}")

    return put


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Appends the regions of new pages to `out`/regions, their sizes to `out`/pages and a row for each page to `out`/work_log; pages that do not parse are logged as failed."""
    q = new_pages(spark, path).writeStream.foreachBatch(_put(out, each)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


class OutOfTime(Exception):
    """The next batch would not end in time."""


@dataclass
class Run:
    """What a timed run did: the seconds of each batch, and whether it took all that was new."""

    seconds: list[float] = field(default_factory=list)
    finished: bool = False


def ingest_for(spark: SparkSession, path: str, out: str, checkpoint: str, limit: float, files_per_batch: int, each: Callable[[DataFrame], DataFrame] | None = None, clock: Callable[[], float] = time.monotonic) -> Run:
    """As ingest, in batches of `files_per_batch` files, but it begins no batch that the longest so far says would end after `limit` seconds.

    The first batch is always taken. A batch that is not begun has written nothing; its files are in the stream's
    checkpoint as planned, and the next run takes them first, under the same number, so no page is read twice or lost.
    """
    began, done, put = clock(), Run(), _put(out, each)

    def timed(batch: DataFrame, epoch: int) -> None:
        at = clock()
        if done.seconds and at - began + max(done.seconds) > limit:
            raise OutOfTime
        put(batch, epoch)
        done.seconds.append(clock() - at)

    q = new_pages(spark, path, files_per_batch).writeStream.foreachBatch(timed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except StreamingQueryException as e:
        if OutOfTime.__name__ not in str(e):
            raise
    else:
        done.finished = True
    return done
