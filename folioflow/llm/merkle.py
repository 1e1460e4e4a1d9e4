"""Merkle dataset manifest: a radix-ranked trie of hashes per language, proofs for every row, and what tampering does to them.

A row's leaf is the SHA-256 of its fields, each with its length before it. Per language the leaves stand in order of
doc_id; runs of `FANOUT` nodes are hashed to one node until one is left, the language's subroot; the subroots, in order
of their language, are hashed to the root in the same way.

Ranks come without a global sort. doc_id is read as digits of 12 bits below the first bit in which two ids differ.
Counting rows by all digits but the last gives a histogram of cells, adding it up digit by digit gives the cells above;
a cell's start is its parent's start and the rows of the smaller cells of the same parent. So every window holds at
most 4,097 cells of one parent, or the at most 4,096 ids of one cell. Where rows of one id differ, the digits go on into their
leaf's hash; equal rows are counted once and dealt to places one after the other.

The rank's digits in base FANOUT name the trie's nodes: a block of FANOUT^3 leaves shares all digits but the last three,
its longest prefix, and is reduced in one row with array functions; block roots are the leaves of the next round. Paths come down
the same way: a block's siblings above are joined to it once, not to each of its leaves. Everything is DataFrame expressions.

Defined cases: null fields count as `-`; null languages are a group of their own, before all others; null ids come
before all others of their language and are not tampered with; rows of one id are in order of their leaf; each repeated
row has a place, a proof and an output row of its own; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, staged

FANOUT, DIGIT_BITS = 8, 3
#: Levels that one block reduces, and its leaves.
DEPTH = 3
BLOCK = FANOUT**DEPTH
DIGIT = 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Copies of one row that are unfolded from one row.
COPIES = 1024


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it enters a leaf: its length in bytes, a colon and its text; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in fields]))


def starts(cells: DataFrame, by: list[str], bits: int) -> DataFrame:
    """by, p, start: how many rows of the group have a smaller p.

    cells: by (never null), p (long, -1 or at least 0; two of a group differ in the last `bits` bits or in being -1), n
    rows of it; one row for each p.
    """
    if bits <= DIGIT:
        return cells.select(*by, "p", (F.sum("n").over(Window.partitionBy(*by).orderBy("p")) - F.col("n")).alias("start"))
    cells = cells.withColumn("q", F.shiftright("p", DIGIT))
    above = starts(cells.groupBy(*by, F.col("q").alias("p")).agg(F.sum("n").alias("n")), by, bits - DIGIT)
    above = above.withColumnsRenamed({"p": "q", "start": "before"})
    within = F.sum("n").over(Window.partitionBy(*by, "q").orderBy("p")) - F.col("n")
    return cells.withColumn("within", within).join(above, [*by, "q"]).select(*by, "p", (F.col("before") + F.col("within")).alias("start"))


def _running(by: list[str], order: list[str]) -> Column:
    return F.sum("n").over(Window.partitionBy(*by).orderBy(*order)) - F.col("n")


def ranks(rows: DataFrame) -> DataFrame:
    """lang_key, doc_id, leaf, bent, rank: each row's place in its language, from 0. rows: a written table of the others."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    bits = ((low ^ high) & (1 << 64) - 1).bit_length() if low is not None else 0
    by = ["lang_key"]
    ordered = F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    kept = rows.withColumn("p", F.coalesce(F.shiftrightunsigned(ordered, DIGIT), F.lit(-1))).withColumn("id", F.coalesce("doc_id", F.lit(0)))
    one = F.struct("leaf", "bent")
    ids = kept.groupBy(*by, "p", "id").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one"), F.max("leaf").alias("last"), F.first("doc_id").alias("doc_id"))
    ids = staged(ids, "merkle-ids")
    cells = starts(ids.groupBy(*by, "p").agg(F.sum("n").alias("n")), by, max(bits - DIGIT, 0))
    placed = ids.withColumn("within", _running([*by, "p"], ["id"])).join(cells, [*by, "p"]).withColumn("start", F.col("start") + F.col("within"))
    placed = staged(placed.drop("within"), "merkle-placed")
    mixed = placed.where("one.leaf <> last").select(*by, "p", "id", "start")
    single = placed.where("one.leaf = last").select(*by, "doc_id", "one.leaf", "one.bent", "n", "start")
    if not mixed.isEmpty():  # rows of one id that differ: the digits of their leaf go on
        key = [*by, "p", "id"]
        apart = kept.join(mixed.select(*key), key, "left_semi").groupBy(*key, "leaf").agg(F.first("bent").alias("bent"), F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
        apart = staged(apart.withColumnRenamed("p", "of"), "merkle-apart").withColumn("p", F.conv(F.substring("leaf", 1, 6), 16, 10).cast("long"))
        key = [*by, "of", "id"]
        hashed = starts(apart.groupBy(*key, "p").agg(F.sum("n").alias("n")), key, 24)
        inside = apart.withColumn("within", _running([*key, "p"], ["leaf"])).join(hashed.withColumnRenamed("start", "before"), [*key, "p"])
        inside = inside.drop("p").join(mixed.withColumnRenamed("p", "of"), key)
        single = single.unionByName(inside.select(*by, "doc_id", "leaf", "bent", "n", (F.col("start") + F.col("before") + F.col("within")).alias("start")))
    # equal rows, stretch by stretch
    part = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"), F.lit(COPIES).cast("long")))
    single = single.withColumn("at", part)
    each = F.sequence(F.col("start") + F.col("at"), F.col("start") + F.least(F.col("n"), F.col("at") + COPIES) - 1)
    return single.select(*by, "doc_id", "leaf", "bent", F.explode(each).alias("rank"))


def _up(nodes: Column) -> Column:
    """The level above: each run of FANOUT nodes hashed to one."""
    runs = F.sequence(F.lit(1), F.size(nodes), F.lit(FANOUT))
    return F.transform(runs, lambda i: digest(F.concat_ws("", F.slice(nodes, i, FANOUT))))


def blocks(nodes: DataFrame, by: list[str], carried: list[str]) -> DataFrame:
    """by, block, levels (arrays of nodes, from below), depth (how many of them have to be hashed), root, rows (carried, in order).

    nodes: by, rank (from 0 without gaps in each group), h and what is carried. A group's only block ends at its root;
    others go up all DEPTH levels.
    """
    rows = nodes.groupBy(*by, F.shiftright("rank", DIGIT_BITS * DEPTH).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "h", *carried))).alias("rows"))
    rows = rows.withColumn("l0", F.col("rows.h"))
    for i in range(DEPTH):
        rows = rows.withColumn(f"l{i + 1}", _up(F.col(f"l{i}")))
    levels = [F.col(f"l{i}") for i in range(DEPTH + 1)]
    depth, root = F.lit(DEPTH), levels[DEPTH][0]
    for i in reversed(range(DEPTH)):  # a single block with one node at level i is done there
        alone = (F.col("block") == 0) & (F.size(levels[i]) == 1)
        depth, root = F.when(alone, i).otherwise(depth), F.when(alone, levels[i][0]).otherwise(root)
    return rows.select(*by, "block", F.array(*levels[:DEPTH]).alias("levels"), depth.alias("depth"), root.alias("root"), "rows")


def path(levels: Column, depth: Column, place: Column) -> Column:
    """The siblings of the leaf at `place` (from 0) of a block, level by level: array of (left, right), each joined."""

    def step(j: Column) -> Column:
        at = F.call_function("shiftright", place, DIGIT_BITS * j)
        run = F.call_function("shiftright", at, F.lit(DIGIT_BITS)) * FANOUT
        nodes = F.element_at(levels, j + 1)
        return F.struct(F.concat_ws("", F.slice(nodes, run + 1, at - run)).alias("left"), F.concat_ws("", F.slice(nodes, at + 2, FANOUT - 1 - (at - run))).alias("right"))

    return F.when(depth == 0, _no_path()).otherwise(F.transform(F.sequence(F.lit(0), depth - 1), step))


def _no_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def trie(nodes: DataFrame, by: list[str], carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """by, carried, h, subroot, path of every node; and by, subroot of every group. Rounds go with the logarithm of the nodes in base BLOCK."""
    rounds = [staged(blocks(nodes, by, carried), "merkle-blocks")]
    while rounds[-1].agg(F.max("block")).first()[0]:
        nodes = rounds[-1].select(*by, F.col("block").alias("rank"), F.col("root").alias("h"))
        rounds.append(staged(blocks(nodes, by, []), "merkle-blocks"))
    top = rounds[-1].select(*by, F.col("root").alias("subroot"))
    met = rounds[-1].withColumn("subroot", F.col("root")).withColumn("above", _no_path())
    while True:
        x = met.select(*by, "levels", "depth", "subroot", "above", F.posexplode("rows").alias("place", "row"))
        x = x.select(*by, "row", "subroot", F.concat(path(F.col("levels"), F.col("depth"), F.col("place")), F.col("above")).alias("path"))
        rounds.pop()
        if not rounds:
            return x.select(*by, *[f"row.{c}" for c in carried], "row.h", "subroot", "path"), top
        down = staged(x.select(*by, F.col("row.rank").alias("block"), "subroot", F.col("path").alias("above")), "merkle-paths")
        met = rounds[-1].join(small(down, _path_bytes("above")), [*by, "block"])


def _path_bytes(name: str) -> Column:
    """The most that a row with a path takes, but for its group's key."""
    return 128 + (64 * FANOUT) * F.size(name)


def folded(start: Column, way: Column) -> Column:
    """The root that a leaf and its siblings hash to."""
    return F.aggregate(way, start, lambda node, s: digest(F.concat(s.left, node, s.right)))


def proof(way: Column) -> Column:
    return digest(F.concat_ws("", F.flatten(F.transform(way, lambda s: F.array(s.left, s.right)))))


def _name_ranks(names: DataFrame) -> DataFrame:
    """lang_key, rank: places of distinct names in bytewise order. names: a written table, one row for each.

    Few names are numbered in one window; more are first counted by a prefix, the shortest that leaves a window of them.
    """
    length, most = 0, names.count()
    while most > 1 << DIGIT:
        length += 1
        most = names.groupBy(F.substring(F.hex("lang_key"), 1, 2 * length)).count().agg(F.max("count")).first()[0]
    part = names.withColumn("part", F.substring(F.hex("lang_key"), 1, 2 * length)).withColumn("n", F.lit(1).cast("long"))
    cells = part.groupBy("part").agg(F.sum("n").alias("n")).withColumn("start", F.lit(0).cast("long"))
    for size in range(length):  # rows before each prefix: siblings of one parent at a time
        at = F.substring("part", 1, 2 * size + 2)
        level = cells.groupBy(at.alias("cell")).agg(F.sum("n").alias("n")).withColumn("before", _running([F.substring("cell", 1, 2 * size)], ["cell"])).drop("n")
        cells = cells.join(level, at == F.col("cell")).withColumn("start", F.col("start") + F.col("before")).drop("cell", "before")
    return part.join(cells.select("part", "start"), "part").select("lang_key", (F.col("start") + _running(["part"], ["lang_key"])).alias("rank"))


def manifest(docs: DataFrame, tampered: Column | None = None, fanned: list[str] | None = None) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    tampered: a condition on docs' columns; there the text's A-Z are lower-cased before the leaf is made again. By
    default the rows for which 3 divides the crc32 of doc_id. fanned: the columns that make a leaf, doc_id first.
    """
    names = fanned or FIELDS
    own = [F.col(f"`{c}`") for c in names]
    if tampered is None:
        tampered = F.crc32(F.col("`doc_id`").cast("string").cast("binary")) % 3 == 0
    text = F.translate(F.col("`text`"), UPPER, LOWER)
    bent = F.when(tampered, leaf([text if c == "text" else x for c, x in zip(names, own, strict=True)]))
    key = F.coalesce(F.concat(F.lit("="), F.col("`lang`")), F.lit(""))
    rows = staged(docs.select(key.alias("lang_key"), F.col("`doc_id`").cast("long").alias("doc_id"), leaf(own).alias("leaf"), bent.alias("bent")), "merkle-leaves")
    leaves, subroots = trie(ranks(rows).withColumnRenamed("leaf", "h"), ["lang_key"], ["doc_id", "bent"])
    order = _name_ranks(subroots.select("lang_key"))
    tops = subroots.withColumnRenamed("subroot", "h").join(order, "lang_key").withColumn("whole", F.lit(0))
    roots = trie(tops, ["whole"], ["lang_key"])[0].select("lang_key", F.col("subroot").alias("root"), F.col("path").alias("beyond"))
    roots = staged(roots, "merkle-roots")
    out = leaves.join(small(roots, F.octet_length("lang_key") + _path_bytes("beyond")), "lang_key").withColumn("way", F.concat("path", "beyond"))
    out = out.withColumn("folded_root", folded(F.coalesce("bent", "h"), F.col("way")))
    lang = F.when(F.col("lang_key") != "", F.expr("substring(lang_key, 2)"))
    return out.select("doc_id", lang.alias("lang"), F.col("h").alias("leaf"), "subroot", "root", proof(F.col("way")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

