"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a Hamming distance by pigeonring filtering.

A fingerprint's bit is set where over half of the document's shingle hashes (repeats included) have it set. The bits
are cut into distance + 1 segments that stand in a ring. If two fingerprints differ in at most `distance` bits, the
pigeonring principle says that some segment i starts a chain of which every prefix stays within its share: the first l
segments from i on differ in at most floor(l * distance / segments) bits, for every l. So segment i is equal, the
second differs in at most one bit, the first three in at most two, and so on.

How it runs: equal fingerprints are merged first, whatever the number of copies. Each distinct fingerprint goes to one
bucket for each segment, named by the segment's place and bits. Buckets with more than `BLOCK` members first compare
all members with `HUBS` of them; this links most of a large group of near copies, so what is left to compare is small:
in every bucket, members outside its largest component with all members, in tiles of two blocks. Where that would be
more than `PAIRS` pairs, the bucket is cut along its chain: its next segment may differ in at most l - 1 bits, so of l
parts of it one is equal, and members go to l smaller buckets named by the part and its bits as well; this is repeated
along the ring and loses no pair at any step. In a tile, a pair's differences are added up segment by segment along the
chain and the pair is dropped as soon as they pass their share; what is left at the chain's end is within the distance.
A task returns links that join what it has not linked yet (a forest), never all pairs of a group of near copies. Which
way a bucket takes follows from its rows alone, and every way finds every pair.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other; fewer words than `width`
make one shingle; repeated rows are copies; rows that share an id but not their text are linked with each other; a row
with a null id has a fingerprint, links nothing and has a null component; extra columns are ignored. doc_id is a whole
number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, staged
from .components import components

BITS = 64
#: Members of a block, hubs of a large bucket, and pairs beyond which a bucket is cut along its chain.
BLOCK, HUBS, PAIRS = 2048, 32, 1 << 26
SEED = 42
U = np.uint64


def fingerprint(text: bytes | None, width: int) -> int:
    """The fingerprint of a UTF-8 text."""
    ws = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not ws:
        return 0
    joined = b" ".join(ws)
    n = min(width, len(ws))
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = (ends[: len(ws) - n + 1] - np.fromiter(map(len, ws[: len(ws) - n + 1]), np.int64) - 1).tolist()
    hash64 = xxhash.xxh64_intdigest
    h = np.array([hash64(joined[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)], U)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have set."""
    seen = np.zeros(BITS, np.int64)
    for part in (h[i : i + 65_536] for i in range(0, len(h), 65_536)):
        seen += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * seen > len(h)).astype(object)).sum()) if (2 * seen > len(h)).any() else 0


def fingerprints(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], U)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], names=["doc_id", "bits"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(run, "doc_id long, bits long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment of the ring."""
    m = distance + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def part_masks(distance: int) -> list[list[list[int]]]:
    """[ring place i][step][part]: the masks of the parts of the chain's segment i + step, one of which is equal if the chain's sum so far keeps its share."""
    ring = segments(distance)
    out = []
    for i in range(len(ring)):
        steps = []
        for step in range(len(ring)):
            first, n = ring[(i + step) % len(ring)]
            parts = (step + 1) * distance // len(ring) + 1
            cuts = [n * j // parts for j in range(parts + 1)]
            steps.append([((1 << (b - a)) - 1) << (first + a) for a, b in zip(cuts, cuts[1:], strict=False)])
        out.append(steps)
    return out


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _placed(rows: DataFrame, masks: list[list[list[int]]], step: int) -> DataFrame:
    """rows in the buckets of the chain's next step: ring, key and their other columns; after the first step they have a ring and a key before."""
    others = [c for c in rows.columns if c not in ("ring", "key")]
    before = [F.col("key")] if step else []

    def buckets(i: int) -> Column:
        keys = [F.xxhash64(*before, F.lit(i), F.lit(j), F.col("bits").bitwiseAND(F.lit(_signed(mask)))) for j, mask in enumerate(masks[i][step])]
        return F.array(*[F.struct(F.lit(i).alias("ring"), key.alias("key")) for key in keys])

    each = [buckets(i) for i in range(len(masks))]
    some = F.coalesce(*[F.when(F.col("ring") == i, x) for i, x in enumerate(each)]) if step else F.concat(*each)
    return rows.select(*others, F.explode(some).alias("b")).select("b.*", *others)


def star(classes: DataFrame, distance: int) -> DataFrame:
    """a, b: members of large buckets and those of the bucket's HUBS hubs that are within the distance."""
    rows = _placed(classes, part_masks(distance), 0)
    large = rows.groupBy("ring", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    large = staged(large.select("ring", "key"), "large-buckets")
    rows = rows.join(small(large, 24), ["ring", "key"])
    one = F.struct(F.xxhash64("id"), "bits", "id")
    hubs = rows.groupBy("ring", "key", F.pmod(F.xxhash64("bits"), F.lit(HUBS))).agg(F.min(one).alias("h")).groupBy("ring", "key").agg(F.collect_list(F.struct("h.bits", "h.id")).alias("hubs"))
    met = rows.join(small(staged(hubs, "hubs"), 48 + 24 * HUBS), ["ring", "key"])
    near = F.filter("hubs", lambda h: F.bit_count(h.bits.bitwiseXOR(F.col("bits"))) <= distance)
    met = met.select("id", F.transform(near, lambda h: h.id).alias("near")).where(F.size("near") > 0)
    first = F.col("near")[0]
    # the member with the first hub, and the first hub with the others that the member joins to it
    met = met.select(F.explode(F.concat(F.array(F.struct(F.col("id").alias("a"), first.alias("b"))), F.transform(F.slice("near", 2, HUBS), lambda x: F.struct(first.alias("a"), x.alias("b"))))).alias("p"))
    return met.select("p.*").where("a <> b").distinct()


def tiles(classes: DataFrame, distance: int) -> DataFrame:
    """ring, key, tile, part, bits, component: which fingerprints are compared with which. Rows of one (ring, key, tile) meet in one task; part is 0 and 1 for the two blocks of a tile, and 2 where it compares one block with itself.

    classes: bits, id, component.
    """
    masks = part_masks(distance)
    done = []
    rows = _placed(classes, masks, 0)
    for step in range(1, distance + 2):
        rows = staged(rows, "chain-buckets")
        parts = rows.groupBy("ring", "key", "component").agg(F.count(F.lit(1)).alias("n"))
        sizes = parts.groupBy("ring", "key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("m")).where("parts > 1")
        sizes = sizes.select("ring", "key", F.col("m.component").alias("main"), "n", (F.col("n") - F.col("m.n")).alias("others"))
        sizes = staged(sizes, "bucket-sizes")
        crowded = (F.col("n") * F.col("others") > PAIRS) & F.lit(step <= distance)
        met = rows.join(small(sizes.where(~crowded), 56), ["ring", "key"])
        done.append(_tiled(met))
        left = staged(sizes.where(crowded).select("ring", "key"), "crowded")
        if left.isEmpty():
            break
        rows = _placed(rows.join(small(left, 24), ["ring", "key"]), masks, step)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _tiled(met: DataFrame) -> DataFrame:
    """Buckets in tiles: a small one is one tile; of others, each block of members outside the main component meets each block of all."""
    names = ["ring", "key", "tile", "part", "bits", "component"]
    alone = met.where(F.col("n") <= BLOCK).select("ring", "key", F.lit(0).alias("tile"), F.lit(2).alias("part"), "bits", "component")
    met = met.where(F.col("n") > BLOCK).withColumn("xs", F.ceil(F.col("others") / BLOCK).cast("int")).withColumn("ys", F.ceil(F.col("n") / BLOCK).cast("int"))

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("bits"), F.col(n)).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    x = met.where("component <> main").withColumn("x", block("xs")).withColumn("y", each("ys")).withColumn("part", F.lit(0))
    y = met.withColumn("y", block("ys")).withColumn("x", each("xs")).withColumn("part", F.lit(1))
    both = x.unionByName(y).withColumn("tile", F.col("x") * F.col("ys") + F.col("y"))
    return alone.unionByName(both.select(*names))


class Parts(dict):
    """A union-find over ids: what has been linked so far. It forgets all when it holds many; then links repeat."""

    def top(self, c: int) -> int:
        while (up := self.get(c, c)) != c:
            self[c] = self.get(up, up)
            c = up
        return c

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.top(a), self.top(b)
        if a != b:
            if len(self) > 500_000:
                self.clear()
            self[max(a, b)] = min(a, b)
        return a != b


def near(bits: np.ndarray, comp: np.ndarray, part: np.ndarray, ring: int, distance: int, parts: Parts) -> list[tuple[int, int]]:
    """Pairs of components with members of a tile within the distance that join different parts, found by walking the chain from `ring`."""
    cut = segments(distance)
    own = [U(((1 << n) - 1) << a) for a, n in (cut[(ring + i) % len(cut)] for i in range(len(cut)))]
    left, right = np.flatnonzero(part != 1), np.flatnonzero(part != 0)
    same = bool((part == 2).all())
    links = []
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        x, y = np.divmod(np.arange(len(rows) * len(right)), len(right)) if not same else _below(at, len(rows), len(right))
        some = comp[rows[x]] != comp[right[y]]
        x, y = x[some], y[some]
        diff = bits[rows[x]] ^ bits[right[y]]
        total = np.zeros(len(diff), np.uint8)
        for step, mask in enumerate(own, 1):
            total += np.bitwise_count(diff & mask)
            keep = total <= step * distance // len(own)
            x, y, diff, total = x[keep], y[keep], diff[keep], total[keep]
        links += [p for p in zip(comp[rows[x]].tolist(), comp[right[y]].tolist(), strict=True) if parts.join(*p)]
    return links


def _below(at: int, n: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """Each unordered pair once: rows at..at+n against the rows after each."""
    x, y = np.divmod(np.arange(n * of), of)
    later = y > x + at
    return x[later], y[later]


def links(classes: DataFrame, distance: int) -> DataFrame:
    """a, b: components of fingerprints (bits, id, component) with members within the distance; those that the tiles need to join what is near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = pa.table({}), Parts()
        for b in (*batches, None):
            t = pa.Table.from_batches([b]) if b is not None else None
            t = pa.concat_tables([held, t]) if held.num_rows and t is not None else held if t is None else t
            if not t.num_rows:
                continue
            ring, key, tile, part, bits, comp = (t.column(c).to_numpy() for c in ("ring", "key", "tile", "part", "bits", "component"))
            new = np.flatnonzero(np.r_[True, (np.diff(ring) != 0) | (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
            ends = np.append(new[1:], t.num_rows)
            if b is not None:  # the last tile may go on
                held, ends = t.slice(new[-1]), ends[:-1]
            found = [p for a, e in zip(new, ends, strict=False) if e - a > 1 for p in near(bits[a:e].view(U), comp[a:e], part[a:e], int(ring[a]), distance, parts)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = tiles(classes, distance).repartition("ring", "key", "tile").sortWithinPartitions("ring", "key", "tile")
    return rows.mapInArrow(run, "a long, b long").distinct()


def relabelled(rows: DataFrame, label: str, comp: DataFrame) -> DataFrame:
    """rows with the component of what `label` names; what comp lacks is its own."""
    now = small(comp.select(F.col("id").alias("__id"), F.col("component").alias("__to")), 16)
    out = rows.join(now, F.col(label) == F.col("__id"), "left").withColumn("__to", F.coalesce("__to", label))
    return out.drop("__id", "component").withColumnRenamed("__to", "component")


def near_classes(classes: DataFrame, distance: int, more: DataFrame | None = None) -> DataFrame:
    """bits, id, component (smallest id reachable) of distinct fingerprints. classes: a written table of bits and id; more: further links of ids."""
    first = components(star(classes, distance) if more is None else star(classes, distance).unionByName(more))
    of = staged(relabelled(classes, "id", staged(first, "star-components")), "star-classes")
    again = staged(components(links(of, distance)), "fingerprint-components")
    return relabelled(of, "component", again)


def near_fingerprints(docs: DataFrame, width: int = 5, distance: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable) of every document."""
    if not 0 <= distance < 8:
        raise ValueError("the distance is 0 to 7: a segment has at least as many bits as parts")
    rows = staged(fingerprints(docs, width, doc_id, text), "fingerprints")
    classes = staged(rows.where("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("id")), "fingerprint-classes")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("bits").alias("lo"), F.max("bits").alias("hi")).where("lo < hi").select("doc_id")
    several = staged(several, "ids-of-several-texts")
    more = None
    if not several.isEmpty():
        of = rows.join(several, "doc_id", "left_semi").join(classes, "bits").select("doc_id", "id").distinct()
        more = of.select(F.min("id").over(Window.partitionBy("doc_id")).alias("a"), F.col("id").alias("b"))
    of = near_classes(classes, distance, more).select("bits", "component")
    out = rows.join(small(staged(of, "fingerprint-roots"), 16), "bits", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
