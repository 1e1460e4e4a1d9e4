"""MinHash near-dedup with fast similarity sketching, banding and exact verification.

A document's set holds 64-bit fingerprints of its distinct word shingles (`width` words, A-Z lower-cased, ASCII white
space between words). Fast similarity sketching fills the sketch's `BANDS * ROWS` coordinates in rounds: round i < t
hashes every element into one of t bins with a value that grows with i; round t + j puts every element into bin j; so
after at most 2t rounds each coordinate is filled, mostly after t ln t / n of them, and equal coordinates concentrate
around the similarity as with independent hashes. Rounds run for all unfinished documents of a batch at once.

Documents with equal sets are merged first: one row of each class goes on, and no copies are paired. Bands of ROWS
coordinates propose pairs; a pair of similarity 0.8 escapes all 56 bands with probability 4e-8. Linking in two steps:
first every member is compared with the first member of a bucket, of the one that shares most buckets with it (again
with the first of the members left over, while large buckets have many and this links them); these links are a forest,
whose roots are the components so far. Then, in each bucket that still holds several components, every member outside
the largest of them meets all members of other components that its sketch does not rule out, in blocks of bounded
members and bytes on both sides. Pairs inside a component are not compared, they cannot change it, and the second
step's pairs are never made rows. What it links are components, so only these, not documents, are connected again.
Every comparison counts the common shingles of the two whole texts by their fingerprints: two different shingles share
one with a probability of 2^-64, so a pair of texts of 100,000 words is misjudged with one below 1e-9.

Defined cases: null and wordless texts have empty sets, stand alone and are kept; fewer words than `width` make one
shingle; repeated rows are copies; rows that share an id but not their text are linked with each other, and with
whatever one of them is like; a row with a null id stands alone, is kept, and has a null component; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, staged
from .components import components, roots

BANDS, ROWS = 56, 6
COORDS = BANDS * ROWS
#: Coordinates of which a byte is kept to compare members of a bucket, and by how much their share of equal ones may
#: fall below the similarity: 5.5 standard deviations at 0.8, so a link escapes with a probability of 2e-8.
MARKS, SLACK = COORDS, 0.12
BLOCK = 512
#: Words whose hashes a worker holds.
WORDS = 100_000
#: Bytes of sets in a block.
BLOCK_BYTES = 16_000_000
U = np.uint64


class WordHash(dict):
    """word -> 64-bit hash, for a bounded number of words."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (two multiply and shift steps)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, width: int, known: WordHash) -> np.ndarray:
    """Sorted distinct fingerprints of a text's word shingles."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not ws:
        return np.zeros(0, U)
    h = np.fromiter(map(known.__getitem__, ws), U, len(ws))
    n = min(width, len(h))
    s = np.full(len(h) - n + 1, U(n))
    for i in range(n):
        s = mix(s + h[i : len(h) - n + 1 + i])
    return np.unique(s)


def sketch(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """One row of `coords` values for each set that is not empty."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), n)
    out = np.full((len(sets), coords), U(0xFFFFFFFFFFFFFFFF))
    cells = out.reshape(-1)
    low = U((1 << 48) - 1)
    for i in range(2 * coords):
        if not len(flat):
            break
        h = mix(flat + U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> U(48)) * U(coords) >> U(16)).astype(np.int64) if i < coords else np.full(len(flat), i - coords)
        np.minimum.at(cells, owner * coords + bins, (h & low) | U(i) << U(48))
        if i < 8 or i % 8 == 0:
            open_ = (out == U(0xFFFFFFFFFFFFFFFF)).any(axis=1)
            some = open_[owner]
            flat, owner = flat[some], owner[some]
    return out


def band_keys(sk: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.broadcast_to(np.arange(bands, dtype=U) * U(0x9E3779B97F4A7C15), (len(sk), bands)).copy()
    for r in range(rows):
        key = mix(key + sk.reshape(len(sk), bands, rows)[:, :, r])
    return key


def sketches(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128 bits of the set), keys (one for each band), marks and tags (parts of the sketch and of the keys); these are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash(WORDS)
        for whole in batches:
            for b in (whole.slice(i, 250) for i in range(0, whole.num_rows, 250)):
                sets = [shingles(t.as_py(), width, known) for t in b.column(1)]
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                sk = sketch([sets[i] for i in full])
                lists: list[np.ndarray | None] = [None] * len(sets)
                marks: list[bytes | None] = [None] * len(sets)
                tags: list[bytes | None] = [None] * len(sets)
                for row, mark, i in zip(band_keys(sk), mix(sk[:, :MARKS]).astype(np.uint8), full, strict=True):
                    lists[i], marks[i], tags[i] = row.view(np.int64), mark.tobytes(), row.astype(np.uint16).tobytes()
                ends = [np.array([f(s) for s in sets], dtype=U).view(np.int64) for f in (lambda s: mix(s + U(1)).sum(dtype=U), lambda s: mix(s + U(2)).sum(dtype=U))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ends[0]), pa.array(ends[1]), pa.array(lists, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(tags, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "keys", "marks", "tags"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, marks binary, tags binary")


def texts_of(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, repeats: bool) -> DataFrame:
    """id, text of the documents in ids (a written table of one column, id), each text of an id once; other texts are not shuffled while ids are few. repeats: whether an id may have several rows."""
    t = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    t = t.join(small(ids, 16), "id", "left_semi")
    return t.withColumn("__h", F.xxhash64("text")).dropDuplicates(["id", "__h"]).drop("__h") if repeats else t


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str, repeats: bool) -> DataFrame:
    """The rows of pairs (a, b and more) whose whole shingle sets are similar enough. Only texts in a pair are shuffled, once for each side."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    t = texts_of(docs, staged(ids, "tried-ids"), doc_id, text, repeats)
    names = pairs.columns
    met = pairs.join(t.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    met = met.join(t.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, held = WordHash(WORDS), None, np.zeros(0, U)
        for x in batches:
            keep = []
            for ta, tb in zip(x.column(0), x.column(1), strict=True):
                if ta != last:
                    last, held = ta, shingles(ta.as_py(), width, known)
                other = shingles(tb.as_py(), width, known)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            yield x.select(names).filter(pa.array(keep, pa.bool_()))

    return met.select("text_a", "text_b", *names).mapInArrow(run, pairs.schema).distinct()


def _blocks(rows: DataFrame, size: Column) -> DataFrame:
    """key, main, xs, ys for each bucket of several components: the component with most members, and in how many blocks of at most about BLOCK members and BLOCK_BYTES the members outside it and all members go.

    rows: key, component and what `size` needs, the bytes that a comparison holds for a member.
    """
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    sums = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "size", "component")).alias("m")).where("parts > 1")

    def number(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")

    return sums.select("key", F.col("m.component").alias("main"), number(F.col("n") - F.col("m.n"), F.col("size") - F.col("m.size")).alias("xs"), number(F.col("n"), F.col("size")).alias("ys"))


def _in_buckets(rows: DataFrame, carried: str, compare: Callable[..., pa.Table], out: str) -> DataFrame:
    """compare(x, y) for each bucket with itself, or, in a bucket of several blocks, for each block of members outside its main component with each block of all members.

    rows: key, main, xs, ys (see _blocks) and the columns of `carried`, component among them; x's have the prefix x_.
    Members of the main component need no comparison with each other, so no pair of components is missed, and a task
    holds two blocks whatever the size of the bucket.
    """
    names = [c.split()[0] for c in carried.split(", ")]

    def alone(t: pa.Table) -> pa.Table:
        return compare(t.rename_columns([f"x_{c}" for c in t.column_names]), t)

    once = rows.where("ys = 1").select("key", *names).groupBy("key").applyInArrow(alone, out)
    large = rows.where("ys > 1")

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")

    def all_of(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    x = large.where("component <> main").select(F.col("key").alias("x_key"), block("xs").alias("x_block"), all_of("ys").alias("x_other"), *[F.col(c).alias(f"x_{c}") for c in names])
    y = large.select("key", all_of("xs").alias("other"), block("ys").alias("block"), *names)
    return once.unionByName(x.groupBy("x_key", "x_block", "x_other").cogroup(y.groupBy("key", "other", "block")).applyInArrow(compare, out))


def _columns(t: pa.Table, prefix: str) -> list[np.ndarray]:
    return [t.column(prefix + c).to_numpy() for c in ("doc_id", "n_shingles", "component")]


def relabelled(rows: DataFrame, label: str, comp: DataFrame) -> DataFrame:
    """rows, with the component of what `label` names as their column component; an id that comp lacks is its own."""
    now = comp.select(F.col("id").alias("__id"), F.col("component").alias("__to"))
    out = rows.join(now, F.col(label) == F.col("__id"), "left").withColumn("__to", F.coalesce("__to", label))
    return out.drop("__id", "component").withColumnRenamed("__to", "component")


def mixed(at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `at` in buckets of several components; and these buckets' blocks. Both are written."""
    some = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rows = staged(at.select("key", "band", "doc_id", "n_shingles", "component").join(some, "key"), "mixed")
    return rows, staged(_blocks(rows, F.lit(MARKS + 2 * BANDS)), "blocks")


def further(rows: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """a, b and their components: the star step again, in buckets with more than a block of members outside the main component: these with the first of them, each member once."""
    out = rows.join(small(blocks.where("xs > 1").select("key", "main"), 16), "key").where("component <> main")
    hubs = out.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles", "component")).alias("h")).select("key", F.col("h.doc_id").alias("a"), F.col("h.n_shingles").alias("n_hub"), F.col("h.component").alias("c_hub"))
    met = out.join(hubs, "key").where("component <> c_hub").where(100 * F.least("n_shingles", "n_hub") >= percent * F.greatest("n_shingles", "n_hub"))
    best = met.groupBy("a", F.col("doc_id").alias("b"), "c_hub", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("b").agg(F.max(F.struct("n", F.negative("a").alias("a"), "c_hub", "component")).alias("m"))
    return best.select(F.negative("m.a").alias("a"), "b", F.col("m.c_hub").alias("of_a"), F.col("m.component").alias("of_b"))


def suspects(rows: DataFrame, blocks: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """key, doc_id, n_shingles, component: members with a partner of another component in the bucket that is alike in size and in its sketch's marks.

    Partners that share several buckets count in the first two of them only. Which buckets they share is told by tags,
    16 bits of each band's key: a partner would be missed if two tags before the first shared band agreed by chance,
    which has a probability of 1e-8.
    """
    least = (percent / 100 - SLACK) * MARKS

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        found, partners = [], np.zeros(y.num_rows, bool)
        if x.num_rows and y.num_rows:
            marks = [np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, MARKS) for t, c in ((x, "x_marks"), (y, "marks"))]
            tags = [np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint16).reshape(-1, BANDS) for t, c in ((x, "x_tags"), (y, "tags"))]
            band = x.column("x_band")[0].as_py()
            (ids, sizes, comps), (_, osize, ocomp) = _columns(x, "x_"), _columns(y, "")
            for i in range(len(ids)):
                some = np.flatnonzero((ocomp != comps[i]) & (100 * np.minimum(osize, sizes[i]) >= percent * np.maximum(osize, sizes[i])))
                if not len(some):
                    continue
                some = some[(marks[1][some] == marks[0][i]).sum(axis=1) >= least]
                some = some[(tags[1][some, :band] == tags[0][i, :band]).sum(axis=1) < 2]
                if len(some):
                    found.append(i)
                    partners[some] = True
        at, of = pa.array(found, pa.int64()), pa.array(np.flatnonzero(partners))
        return pa.table({c: pa.chunked_array([*x.column(f"x_{c}").take(at).chunks, *y.column(c).take(of).chunks], pa.int64()) for c in ("key", "doc_id", "n_shingles", "component")})

    met = rows.join(small(blocks, 32), "key").join(firsts.select("doc_id", "marks", "tags"), "doc_id")
    return _in_buckets(met, "band int, doc_id long, n_shingles long, component long, marks binary, tags binary", compare, "key long, doc_id long, n_shingles long, component long").distinct()


def bucket_links(rows: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str, repeats: bool) -> DataFrame:
    """a, b: components with a link in a bucket, found on whole shingle sets; of links that join the same parts, one."""
    blocks = _blocks(rows, 8 * F.col("n_shingles"))
    t = texts_of(docs, staged(rows.select(F.col("doc_id").alias("id")).distinct(), "suspect-ids"), doc_id, text, repeats)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash(WORDS)
        for b in batches:
            made = [shingles(x.as_py(), width, known) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in made], pa.int64()), pa.array([x.tobytes() for x in made], pa.binary())], names=["doc_id", "n_shingles", "set"])

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if x.num_rows and y.num_rows:
            (ids, sizes, comps), (_, osize, ocomp) = _columns(x, "x_"), _columns(y, "")
            own = [np.frombuffer(v, U) for v in x.column("x_set").to_pylist()]
            flat = np.frombuffer(b"".join(y.column("set").to_pylist()), U)
            words, code = np.unique(flat, return_inverse=True)
            ends = np.cumsum(osize) - osize
            root: dict[int, int] = {}

            def top(c: int) -> int:
                while (up := root.get(c, c)) != c:
                    c = up
                return c

            for i in range(len(ids)):
                at = np.searchsorted(words, own[i])
                at = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == own[i])]
                has = np.zeros(len(words), np.int32)
                has[at] = 1
                both = np.add.reduceat(has[code], ends)
                for j in np.flatnonzero((ocomp != comps[i]) & (100 * both >= percent * (osize + sizes[i] - both))):
                    a, b = top(int(comps[i])), top(int(ocomp[j]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        links.append((int(comps[i]), int(ocomp[j])))
        return pa.table({"a": pa.array([p[0] for p in links], pa.int64()), "b": pa.array([p[1] for p in links], pa.int64())})

    met = rows.join(blocks, "key").join(t.mapInArrow(sets, "doc_id long, n_shingles long, set binary"), ["doc_id", "n_shingles"])
    return _in_buckets(met, "doc_id long, n_shingles long, component long, set binary", compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), kept (doc_id = component_id)."""
    docs = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    rows = staged(sketches(docs, width, doc_id, text), "sketches")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    the_set = ["set_a", "set_b", "n_shingles"]
    classes = staged(full.groupBy(*the_set).agg(F.min("doc_id").alias("first")), "classes")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("set_a", "set_b") for f in (F.min, F.max)]
    again = staged(full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1"), "repeated-ids")
    repeats = not again.isEmpty()
    firsts = full.join(small(classes.select(F.col("first").alias("doc_id"), "set_a", "set_b"), 24), ["doc_id", "set_a", "set_b"], "left_semi")
    buckets = firsts.select("doc_id", "n_shingles", F.posexplode("keys").alias("band", "key"))
    shared = staged(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("key", "hub"), "shared")
    # rows of buckets with more than one member: (key, band, doc_id, n_shingles, hub); a repeated row of a first document once
    held = buckets.join(small(shared, 32), "key")
    held = staged(held.distinct() if repeats else held, "buckets")
    firsts = firsts.select("doc_id", "marks", "tags")
    firsts = firsts.distinct() if repeats else firsts

    def fits(x: str, y: str) -> Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    sizes = held.where("doc_id = hub").select("key", F.col("n_shingles").alias("n_hub"))
    star = held.where("doc_id <> hub").join(sizes, "key").where(fits("n_shingles", "n_hub")).groupBy(F.col("hub").alias("a"), F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    best = star.groupBy("b").agg(F.max(F.struct("n", F.negative("a").alias("a"))).alias("m")).select(F.negative("m.a").alias("a"), "b")
    comp = roots(confirmed(staged(best, "tried"), docs, width, percent, doc_id, text, repeats))
    rows_of, blocks = mixed(relabelled(held.drop("hub"), "doc_id", comp))
    links: list[DataFrame] = []  # between components
    while tries := (pairs := staged(further(rows_of, blocks, percent), "tried-further")).count():
        found = staged(confirmed(pairs, docs, width, percent, doc_id, text, repeats), "further-links")
        now = components(found, "of_a", "of_b")
        links.append(now.select("id", "component"))
        done = 20 * found.count() < tries  # too few to be worth a round: what is left is compared in blocks
        rows_of, blocks = mixed(relabelled(rows_of, "component", now))
        if done:
            break
    left = staged(suspects(rows_of, blocks, firsts, percent), "suspects")
    links.append(staged(bucket_links(left, docs, width, percent, doc_id, text, repeats), "more-links"))
    if repeats:  # the texts of one id
        of = full.join(again.where("min_set_a <> max_set_a or min_set_b <> max_set_b"), "doc_id", "left_semi").join(classes, the_set).groupBy("doc_id").agg(F.collect_set("first").alias("f"))
        ends = of.select(F.array_min("f").alias("x"), F.explode("f").alias("y")).where("x <> y")
        ends = relabelled(relabelled(ends, "x", comp).drop("x").withColumnRenamed("component", "x"), "y", comp)
        links.append(staged(ends.select("x", "component"), "links-of-ids"))
    joined = links[0].toDF("a", "b")
    for more in links[1:]:
        joined = joined.unionByName(more.toDF("a", "b"))
    again_of = components(joined)
    of = relabelled(relabelled(classes, "first", comp), "component", again_of)
    out = rows.drop("keys", "marks", "tags").join(small(staged(of.select(*the_set, "component"), "class-components"), 48), the_set, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that near_duplicates does not keep; repeated rows of a kept id stay together, null ids stay."""
    gone = staged(near_duplicates(docs, width, percent, doc_id, text).where("not kept").select(F.col("doc_id").alias("id")).distinct(), "gone-ids")
    where = docs.withColumn("__struct", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("__struct", F.col(f"`{doc_id}`").cast("long").alias("id"))
    return where.join(small(gone, 16), "id", "left_anti").select("__struct.*")
