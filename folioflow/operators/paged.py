"""Runs a small Python helper on each page's rows without a group's overhead: one Arrow stream for each partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Rows = list[dict]


#: Rows that a task is to hold at most, on average, where tables are dealt by page.
TASK_ROWS = 250_000


def tasks(rows: int, parts: int) -> int:
    """Into how many partitions so many rows go: more than `parts` if tasks would hold over TASK_ROWS, so that a task's memory does not grow with the table."""
    return max(parts, -(-rows // TASK_ROWS))


def per_key(df: DataFrame, key: list[str], order: list, helper: Callable[[Rows], Rows], schema: str, laid: bool = False) -> DataFrame:
    """helper(rows of one key, in order) for every key. Rows of a key share a partition; keys are small by nature (a page's regions or lines).

    laid: they share one already, as after a window by the key, and are not dealt out again.
    """
    cols = df.columns
    at = [cols.index(k) for k in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Rows = []
        last: tuple | None = None

        def out(rows: Rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in want}, schema=arrow)

        for b in batches:
            values = [c.to_pylist() for c in b.columns]
            done: Rows = []
            for row in zip(*values, strict=True):
                k = tuple(row[i] for i in at)
                if k != last and held:
                    done += helper(held)
                    held = []
                last = k
                held.append(dict(zip(cols, row, strict=True)))
            yield out(done)
        if held:
            yield out(helper(held))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow, want = to_arrow_schema(kind), kind.names
    if laid:
        return df.sortWithinPartitions(*key, *order).mapInArrow(run, schema)
    # a stated number of partitions: small rows with costly work are not gathered into one task
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
