"""Training samples: what a data set takes of each page, extracted once, stored, and read in batches."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Samples(ABC):
    """A data set says which pages it takes and what it makes of a batch of them; Spark does the rest."""

    #: The columns that `extract` returns, `page_id string` and `n int` (a page's samples from 0) among them.
    schema: str

    @abstractmethod
    def pages(self, spark: SparkSession) -> DataFrame:
        """The pages with what `extract` needs of them."""

    @abstractmethod
    def extract(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The samples of some pages."""

    def table(self, spark: SparkSession) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return map(self.extract, batches)

        return self.pages(spark).mapInArrow(run, self.schema)

    def store(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Samples that were extracted before; images and targets are columns of one row, so they cannot come apart."""
    return spark.read.parquet(path)


def joined_by_place(images: DataFrame, targets: DataFrame) -> DataFrame:
    """Images and targets that were stored apart, by page and place; both sides: page_id, n."""
    return images.join(targets, ["page_id", "n"])


def split_sizes(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """split, n: how many samples each split has."""
    return samples.join(splits, "page_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
