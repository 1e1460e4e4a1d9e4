"""Variable-capacity best-fit packing of documents into training sequences.

Documents become pieces of at most the largest capacity. Pieces are dealt by a hash of id, piece number and copy into
stretches of about `STRETCH` pieces, and each stretch is packed alone, so no task sees more than a bounded share; the
only loss against one global packing is a few half-filled bins for each stretch. In a stretch, pieces go in order of
size, largest first, to the open bin with the least room that fits. When none fits, a bin is opened. The permitted
capacities are optimised jointly: for every non-empty subset of capacities that may be opened (always with the
largest, so that everything fits) the stretch is packed with the smallest such capacity that holds the piece or the
one that holds it at the least cost for each token, and the cheapest outcome stays. At the end each bin shrinks to the
smallest permitted capacity that holds its contents.

Cost of a bin of capacity c: c + c^2 / (6 * width) + overhead, in whole numbers. A transformer layer of model width w
spends about 24 w^2 operations on a token and 4 w c on its attention to a sequence of c tokens, so a long sequence
costs more for each of its tokens, and short documents are cheaper in short bins. `overhead` stands for what a
sequence costs whatever its length.

A piece's tokens are those that `tokenizer` gives its text, or its words where no tokenizer is named, or the numbers
in the column `size`; a document's last piece has one end mark more.

Defined cases: a null or empty text is one piece with the end mark only; longer texts than the largest capacity are cut
into full pieces and a rest, never dropped; ties of size go by id, piece and copy; repeated rows are copies and packed
each time, wherever their hashes fall; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import staged, words

CAPACITIES = (512, 1024, 2048, 4096)
STRETCH = 20_000


def bin_cost(capacity: int, width: int, overhead: int) -> int:
    return capacity + capacity * capacity // (6 * width) + overhead


def _pack(sizes: list[int], may_open: tuple[int, ...], costs: dict[int, int]) -> tuple[int, list[int], list[int]]:
    """Cost, each piece's bin, each bin's capacity. sizes: largest first; costs: of every permitted capacity, in order."""
    capacities = list(costs)
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    used: list[int] = []
    of: list[int] = []
    for n in sizes:
        i = bisect_left(rooms, (n, -1))
        if i < len(rooms):
            room, b = rooms.pop(i)
        else:
            # the least cost for each token of what such a bin is sure to hold: whole copies of this piece
            room = min((c for c in may_open if c >= n), key=lambda c: (costs[c] / (n * (c // n) if n else 1), c))
            b = len(used)
            used.append(0)
        used[b] += n
        of.append(b)
        if room > n:
            insort(rooms, (room - n, b))
    caps = [capacities[bisect_left(capacities, u)] for u in used]  # downsizing
    return sum(costs[c] for c in caps), of, caps


def pack_stretch(sizes: list[int], capacities: tuple[int, ...], width: int, overhead: int) -> tuple[int, list[int], list[int]]:
    """The cheapest packing over the subsets of capacities that may be opened."""
    small, top = capacities[:-1], capacities[-1]
    costs = {c: bin_cost(c, width, overhead) for c in capacities}
    subsets = [(*some, top) for r in range(len(small) + 1) for some in combinations(small, r)]
    return min((_pack(sizes, s, costs) for s in subsets), key=lambda x: x[0])


def best_fit_packing(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, width: int = 1024, overhead: int = 16, tokenizer: str | None = None, size: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, copy, start (the piece's first token in its document), n_tokens, stretch, bin, bin_capacity, bin_offset: where every piece of every document goes. copy counts rows of equal id and size."""
    capacities = tuple(sorted(set(capacities)))
    top = capacities[-1]
    if capacities[0] < 1:
        raise ValueError("capacities are positive")
    kind = docs.schema[doc_id].dataType.simpleString()
    if size:
        sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("size"))
    elif tokenizer:
        sized = bpe.bpe_lengths(docs, tokenizer, text, doc_id).withColumnRenamed("n_tokens", "size")
    else:
        sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.size(words(F.coalesce(F.col(f"`{text}`"), F.lit("")))).cast("long").alias("size"))
    sized = staged(sized.groupBy("doc_id", F.col("size") + 1).agg(F.count(F.lit(1)).alias("copies")).toDF("doc_id", "size", "copies"), "sizes")
    stretches = 1 + (sized.agg(F.sum(F.ceil(F.col("size") / top) * F.col("copies"))).first()[0] or 0) // STRETCH
    each = sized.select("doc_id", "size", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy"))
    pieces = each.select("doc_id", "size", "copy", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / top).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * top
    pieces = pieces.select("doc_id", "piece", "copy", start.alias("start"), F.least(F.lit(top), F.col("size") - start).cast("int").alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(stretches)).cast("int").alias("stretch"))
    names = ["doc_id", "piece", "copy", "start", "n_tokens", "stretch"]

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("copy", "ascending")])
        sizes = t.column("n_tokens").to_pylist()
        _, of, caps = pack_stretch(sizes, capacities, width, overhead)
        at, offsets = [0] * len(caps), []
        for n, b in zip(sizes, of, strict=True):
            offsets.append(at[b])
            at[b] += n
        put = {"bin": of, "bin_capacity": [caps[b] for b in of], "bin_offset": offsets}
        for k, v in put.items():
            t = t.append_column(k, pa.array(v, pa.int32()))
        return t.select([*names, *put])

    return pieces.groupBy("stretch").applyInArrow(pack, f"doc_id {kind}, piece int, copy int, start long, n_tokens int, stretch int, bin int, bin_capacity int, bin_offset int")
