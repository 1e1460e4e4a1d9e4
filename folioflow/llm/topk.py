"""Exact top-k search by the three-phase uniform threshold over blocks of dimensions.

Equal vectors are merged first: a class keeps the k + 1 smallest ids that have it, which is all that a result can show.
Each vector is cut into `parts` blocks of dimensions; a block's partial inner product is a local score, and a task of
the first two phases sees one block of dimensions only.

Phase 1 gathers, for each query and part, the classes with the k + 1 best local scores, and the mean m_j and spread
of all local scores. These few classes' vectors are fetched and scored whole; the (k + 1)-th best is a floor T that as
many classes reach, so it is a safe cutoff. Phase 2 sends each query its lines c_j = m_j + w_j (T - sum m), where the
weights w_j add up to one and go with the spread: if every local score were below its line, their sum would be below
T. So a class at or above none of its lines is done with, and every class that reaches T is among the others. Phase 3
multiplies the whole vectors of these entries alone, in the block where they were found, and only a block's k + 1 best
leave it. One rank more than k is searched for because the query itself is among the candidates.

Queries against classes run in blocks of at most `QUERIES` by about `CANDIDATES`, in numpy; neither side is broadcast
unless it measures small, and pairs never become rows but for the best of each block.

Defined cases: vectors that are null or hold a null or non-finite component take no part, neither do null ids;
repeated rows are candidates each, and one query; rows that share an id are never each other's partners, and a query
id with several vectors gets the best of all of them; vectors of other lengths than the query's are not compared; a query without
partners gives no rows; ties go to the smaller id; extra columns are ignored. Scores are exact while the sums of
absolute products stay below 2^53 (with 64 dimensions, components up to 45,000); beyond that they are rounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, staged

QUERIES = 4096
CANDIDATES = 16384
PARTS = 2


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers, 0 for null, and where there is one: as floats, large ids would lose digits."""
    return column.fill_null(0).to_numpy(), column.is_valid().to_numpy()


def _strips(q: pa.Table, c: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, slice, np.ndarray | None]]:
    """Local scores of a strip of queries with all candidates of the block, which candidates and queries these are, and which scores are between rows of one id (None: none)."""
    if not q.num_rows or not c.num_rows:
        return
    dim = len(q.column("x")[0])
    qs, cs = _matrix(q.column("x"), dim), _matrix(c.column("x"), dim).T
    rows, (only, alone), (own, several) = c.column("row").to_numpy(), _ids(c.column("only")), _ids(q.column("own"))
    step = max(1, 4_000_000 // len(rows))
    for a in range(0, len(qs), step):
        at = slice(a, a + step)
        same = (own[at, None] == only[None, :]) & several[at, None] & alone[None, :] if several.any() else None
        yield qs[at] @ cs, rows, at, same


def integers(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v array<double> of whole numbers floor(256 x): the vectors that take part."""
    x = F.col(f"`{embedding}`")
    v = F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    some = vectors.where(x.isNotNull() & F.col(f"`{vec_id}`").isNotNull()).where(whole & (F.size(x) > 0))
    return some.select(F.col(f"`{vec_id}`").alias("id"), v.alias("v"))


class Search:
    """The phases over `queries` (q, dim, v, own) and `classes` (row, dim, v, members, only): the `most` best classes of each query."""

    def __init__(self, queries: DataFrame, classes: DataFrame, most: int, parts: int) -> None:
        self.queries, self.classes, self.most, self.parts = queries, classes, most, parts
        n = classes.count()
        width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.stretches = max(1, min(width, -(-n // 1024)), -(-n // CANDIDATES))
        self.blocks = 1 + queries.count() // QUERIES

    def _sliced(self, df: DataFrame, key: str, own: int, other: int, more: tuple[str, ...] = ()) -> DataFrame:
        """A row for each part and each block of the other side: dim, part, mine, theirs, key, x."""
        n = F.least(F.lit(self.parts), F.col("dim"))
        each = df.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
        lo, hi = F.floor(F.col("part") * F.col("dim") / n).cast("int"), F.floor((F.col("part") + 1) * F.col("dim") / n).cast("int")
        each = each.select("dim", "part", F.pmod(F.xxhash64(key), F.lit(own)).cast("int").alias("mine"), key, *more, F.slice("v", lo + 1, hi - lo).alias("x"))
        return each.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    def _met(self, q: DataFrame, run, schema: str) -> DataFrame:  # noqa: ANN001
        c = self._sliced(self.classes, "row", self.stretches, self.blocks, ("only",))
        return q.groupBy("dim", "part", "mine", "theirs").cogroup(c.groupBy("dim", "part", "theirs", "mine")).applyInArrow(run, schema)

    def scored(self, pairs: DataFrame) -> DataFrame:
        """pairs (q, row) with their whole scores; only the vectors of these pairs are read."""
        v = self.classes.select("row", "v")
        u = small(self.queries.select("q", F.col("v").alias("u")), 16 + 8 * F.size("u"))
        dot = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return pairs.join(v, "row").join(u, "q").select("q", "row", dot.alias("score"))

    def local_lists(self) -> DataFrame:
        """q, part, row, local of the best of each block; and, where row is null, the number, sum and sum of squares of its local scores."""
        k = self.most

        def gather(q: pa.Table, c: pa.Table) -> pa.Table:
            out: list[pa.Table] = []
            names = ["q", "part", "row", "local", "n", "s", "ss"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.float64()] * 4]
            for local, rows, at, own in _strips(q, c):
                sums = [np.full(len(local), float(local.shape[1])), local.sum(axis=1), (local * local).sum(axis=1)]
                if own is not None:
                    local[own] = -np.inf
                ids, m = q.column("q").to_numpy()[at], min(k, local.shape[1])
                best = np.argpartition(local, local.shape[1] - m, axis=1)[:, local.shape[1] - m :]
                part = int(q.column("part")[0].as_py())
                cols = [np.repeat(ids, m), np.full(len(ids) * m, part), rows[best].reshape(-1), np.take_along_axis(local, best, 1).reshape(-1)]
                cols = [x[np.isfinite(cols[3])] for x in cols]
                out.append(pa.table([*(pa.array(x, t) for x, t in zip(cols, kinds, strict=False)), *[pa.nulls(len(cols[0]), pa.float64())] * 3], names))
                none = [pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.float64())]
                out.append(pa.table([pa.array(ids, pa.int64()), pa.array(np.full(len(ids), part), pa.int32()), *none, *(pa.array(x) for x in sums)], names))
            return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in kinds], names)

        q = self._sliced(self.queries, "q", self.blocks, self.stretches, ("own",))
        return staged(self._met(q, gather, "q long, part int, row long, local double, n double, s double, ss double"), "topk-local")

    def lines(self, lists: DataFrame) -> DataFrame:
        """q, part, line."""
        top = F.row_number().over(Window.partitionBy("q", "part").orderBy(F.desc("local"), "row"))
        best = lists.where("row is not null").withColumn("r", top).where(F.col("r") <= self.most).select("q", "row").distinct()
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
        floor = self.scored(best).withColumn("r", rank).where(F.col("r") == self.most).select("q", F.col("score").alias("floor"))
        sums = lists.where("row is null").groupBy("q", "part").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
        mean = F.col("s") / F.col("n")
        spread = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
        each = sums.select("q", "part", mean.alias("mean"), spread.alias("spread"))
        of_q = Window.partitionBy("q")
        each = each.withColumns({"means": F.sum("mean").over(of_q), "spreads": F.sum("spread").over(of_q), "n": F.count(F.lit(1)).over(of_q)})
        share = F.when(F.col("spreads") > 0, F.col("spread") / F.col("spreads")).otherwise(1 / F.col("n"))
        # local scores are whole: rounding down makes good for the rounding of the line
        line = F.floor(F.col("mean") + share * (F.col("floor") - F.col("means"))).cast("double")
        return each.join(floor, "q", "left").select("q", "part", F.coalesce(line, F.lit(float("-inf"))).alias("line"))

    def entries(self, lines: DataFrame) -> DataFrame:
        """q, row, first, score of each block's best among the classes at or above a line, by score and then `first`, the smallest id that is not the query's own; and, where row is null, how many classes that were, as score."""
        most, parts = self.most, self.parts

        def resolve(q: pa.Table, c: pa.Table) -> pa.Table:
            names, kinds = ["q", "row", "first", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            out: list[pa.Table] = []
            if q.num_rows and c.num_rows:
                dim = len(q.column("v")[0])
                qs, cs = _matrix(q.column("v"), dim), _matrix(c.column("v"), dim)
                ids, rows = q.column("q").to_numpy(), c.column("row").to_numpy()
                (own, several), (only, alone), (first, _), (second, _) = (_ids(t.column(x)) for t, x in ((q, "own"), (c, "only"), (c, "first"), (c, "second")))
                least = np.array(q.column("lines").to_pylist()).reshape(len(qs), -1)
                cuts = [(j * dim // min(parts, dim), (j + 1) * dim // min(parts, dim)) for j in range(min(parts, dim))]
                step = max(1, 4_000_000 // len(rows))
                for a in range(0, len(qs), step):
                    enough = np.zeros((len(qs[a : a + step]), len(rows)), bool)
                    for j, (x, y) in enumerate(cuts):
                        enough |= qs[a : a + step, x:y] @ cs[:, x:y].T >= least[a : a + step, j : j + 1]
                    for i, some in enumerate(enough, a):
                        at = np.flatnonzero(some & ~(alone & (only == own[i])) if several[i] else some)
                        score = cs[at] @ qs[i]
                        name = np.where(several[i] & (first[at] == own[i]), second[at], first[at])
                        best = np.lexsort((name, -score))[:most]
                        cols = [np.full(len(best), ids[i]), rows[at[best]], name[best], score[best]]
                        out.append(pa.table([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names))
                        out.append(pa.table([pa.array([x], t) for x, t in zip((ids[i], None, None, float(len(at))), kinds, strict=True)], names))
            return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in kinds], names)

        dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("mine")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("theirs")
        wide = lines.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("part", "line"))).alias("l")).select("q", F.col("l.line").alias("lines"))
        q = self.queries.join(wide, "q").select("dim", dealt("q", self.blocks), "q", "own", "lines", "v", each(self.stretches))
        c = self.classes.select("dim", dealt("row", self.stretches), "row", "only", F.get("members", F.lit(0))["id"].alias("first"), F.get("members", F.lit(1))["id"].alias("second"), "v", each(self.blocks))
        return staged(q.groupBy("dim", "mine", "theirs").cogroup(c.groupBy("dim", "theirs", "mine")).applyInArrow(resolve, "q long, row long, first long, score double"), "topk-entries")

    def best(self) -> DataFrame:
        """q, row, score of the `most` best classes."""
        found = self.entries(staged(self.lines(self.local_lists()), "topk-lines")).where("row is not null")
        top = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first"))
        return found.withColumn("r", top).where(F.col("r") <= self.most).select("q", "row", "score")


def prepared(vectors: DataFrame, is_query: Column, k: int, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """asked (query_id, v, own), queries (q, dim, v, own), classes (row, dim, v, members, only), all written.

    own: the query's id where that id has several vectors; other queries of one vector are searched for once. members:
    the k + 1 smallest ids of a vector; only: its id, if it has one alone.
    """
    each = staged(integers(vectors, vec_id, embedding).groupBy("v", "id").agg(F.count(F.lit(1)).alias("times")), "topk-vectors")
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = each.withColumn("r", first).where(F.col("r") <= k + 1)
    members = F.sort_array(F.collect_list(F.struct("id", F.least("times", F.lit(k)).alias("times"))))  # at most k + 1
    number = F.monotonically_increasing_id()
    only = F.when(F.size("members") == 1, F.get("members", F.lit(0))["id"])
    classes = staged(few.groupBy("v").agg(members.alias("members")).select(number.alias("row"), F.size("v").alias("dim"), "v", "members", only.alias("only")), "topk-classes")
    asked = each.where(is_query).select(F.col("id").alias("query_id"), "v")
    several = staged(asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("query_id", F.col("query_id").alias("own")), "topk-several")
    asked = asked.join(small(several, 16), "query_id", "left")
    queries = staged(asked.select("v", "own").distinct().select(number.alias("q"), F.size("v").alias("dim"), "v", "own"), "topk-queries")
    return asked, queries, classes


def topk(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", parts: int = PARTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products with other rows. is_query speaks of the column `id`."""
    asked, queries, classes = prepared(vectors, is_query, k, vec_id, embedding)
    best = Search(queries, classes, k + 1, parts).best().join(classes.select("row", "members"), "row")
    ids = best.join(small(queries.select("q", "own"), 16), "q").select("q", "own", "score", F.explode("members").alias("m")).select("q", "own", "score", "m.id", "m.times")
    ids = ids.where("own is null or own <> id").drop("own")
    top = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    ids = ids.withColumn("r", top).where(F.col("r") <= k + 1).drop("r")
    met = queries.select("q", F.col("v").alias("u"), F.col("own").alias("of"))
    of = asked.join(met, (F.col("v") == F.col("u")) & F.col("own").eqNullSafe(F.col("of"))).select("query_id", "q")
    out = of.join(ids, "q").where("id <> query_id").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int")
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))
