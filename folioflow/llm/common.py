"""What the operators share: the word pattern, staged tables and crc32 folds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and U+0009 to U+000D. Everything else belongs to a word.
SPACE = "[ \\t-\\r]"
WORD = "[^ \\t-\\r]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session of one JVM may do without: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioflow-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: What each application has staged, in order: a path, and the name of its table in the catalog if it has one.
_STAGED: dict[str, list[tuple[str, str | None]]] = {}


def _noted(spark: SparkSession) -> list[tuple[str, str | None]]:
    return _STAGED.setdefault(spark.sparkContext.applicationId, [])


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut, and a lost executor loses nothing.

    The session's reader returns the table with the schema that df has, empty tables included.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _noted(spark).append((path, None))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As staged, with rows in `buckets` buckets by key: grouping by the key needs no shuffle of this table."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{table}"
    _noted(spark).append((path, table))
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def mark(spark: SparkSession) -> int:
    """A point in the list of staged tables, for `clear`."""
    return len(_noted(spark))


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Removes what was staged after `since`, all but the last `keep` tables. Call it when the results that read these tables are written."""
    noted = _noted(spark)
    gone = noted[since : len(noted) - keep]
    del noted[since : len(noted) - keep]
    for path, name in gone:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def words(text: Column) -> Column:
    """The words of a text in order, as array<string>."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes up to which a table that has been measured is broadcast.
BROADCAST = 8_000_000


def small(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """df, marked for broadcast if it measures below BROADCAST; else as it is, and the join shuffles.

    row_bytes: the most that a row can take, or an expression for what each takes. Measuring reads df, so give it a
    written table.
    """
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST else df
