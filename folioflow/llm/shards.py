"""Sharding by longest processing time: groups of equal texts, largest first, go to the least-loaded shard through a heap.

The heap sees a bounded number of parcels, whatever the number of groups. A group above `1 / (shards * HEAVY)` of all
bytes is a parcel of its own, so there are at most shards * HEAVY of them; the other groups are gathered by hash into
at most `BUNDLES` parcels. Only parcels and their sizes reach the driver. Texts are never shuffled, only their hashes.
Slots count on within chunks of about `CHUNK` rows, so no shard is ever numbered in one task; rows that are equal in
all that shows are counted first and dealt over chunks copy by copy.

Defined cases: a null text is an empty one (16 bytes, crc32 0) and stays with empty texts; a group larger than a
shard's even share stays whole, and the other shards share the rest; repeated rows count each time and get slots of
their own; ties of size go by the parcel's key, ties of load to the smaller shard; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

HEAVY = 64
BUNDLES = 16384
CHUNK = 4096


def lpt(parcels: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """parcel -> shard: largest first, each to the least-loaded shard."""
    loads = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(parcels, key=lambda p: (-p[1], p[0])):
        load, s = loads[0]
        out[key] = s
        heapq.heapreplace(loads, (load + size, s))
    return out


def assign_shards(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: the law is not 'key')."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    raw = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(t).cast("long") + 16).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("group"))
    rows = staged(raw, "shard-sizes")
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    big = total / (shards * HEAVY)
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    heavy = groups.where(F.col("bytes") > F.lit(big)).select("group", F.hex("group").alias("own"))
    bundle = F.format_string("bundle %05d", F.pmod(F.xxhash64("group"), F.lit(BUNDLES)))
    # at most shards * HEAVY rows of 100 bytes by the choice of `big`
    parcel = rows.join(F.broadcast(heavy), "group", "left").select("doc_id", "size", "text_crc32", F.coalesce("own", bundle).alias("parcel"))
    sizes = [(r.parcel, r.bytes) for r in parcel.groupBy("parcel").agg(F.sum("size").alias("bytes")).collect()]  # at most BUNDLES + shards * HEAVY
    plan = spark.createDataFrame(sorted(lpt(sizes, shards).items()), "parcel string, shard int")
    chunks = 1 + n // (shards * CHUNK)
    put = parcel.join(F.broadcast(plan), "parcel").groupBy("doc_id", "size", "text_crc32", "shard").agg(F.count(F.lit(1)).alias("copies"))
    put = put.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    put = staged(put.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(chunks))), "shard-rows")
    before = put.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("shard").orderBy("chunk")
    before = before.select("shard", "chunk", (F.sum("n").over(w) - F.col("n")).alias("base"))
    inside = put.withColumn("at", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size", "copy")))
    out = inside.join(before, ["shard", "chunk"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
