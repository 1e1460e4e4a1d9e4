"""Pairs of overlapping boxes, their one-to-one matching, and what is counted from it.

The pair join has an equality key (page, and class where the class gates), so it hashes; boxes that do not overlap
have IoU 0 and can never be matched, and never become rows. On crowded pages boxes also meet by the cells of a grid, so
that few pairs are tested. Matching is greedy by (IoU, place): up to `FOLD` pairs of a key fold inside the JVM, more are
matched in rounds of pairs that are the best of both their boxes, which gives the same matching without an array of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from .linked import kept

BOX = ["minx", "miny", "maxx", "maxy"]


#: Pairs of boxes of a key that are tested without a grid, and pairs of a key that are matched by a fold.
CROWD, FOLD = 100_000, 1_000


def pairs(pred: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """by, p (ord of pred), g (ord of truth), iou > 0 of all overlapping pairs."""
    a = pred.select(*by, F.col("ord").alias("p"), *[F.col(c).alias(f"p_{c}") for c in BOX])
    b = truth.select(*by, F.col("ord").alias("g"), *[F.col(c).alias(f"g_{c}") for c in BOX])
    full = crowded(pred, truth, by)
    if full is None:
        return _met(a.join(b, by), by)
    alone = _met(a.join(full, by, "left_anti").join(b, by), by)
    return alone.unionByName(in_cells(a.join(full, by), b.join(full, by), by))


def crowded(pred: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame | None:
    """by, wide, high: keys with more than CROWD pairs of boxes, and the cells of their grid, twice as large as a box on average; None where there are none."""
    one = lambda df, n: df.select(*by, F.lit(n).alias("is_p"), (F.col("maxx") - F.col("minx")).alias("w"), (F.col("maxy") - F.col("miny")).alias("h"))
    sizes = one(pred, 1).unionByName(one(truth, 0)).groupBy(*by).agg(F.sum("is_p").alias("n_p"), F.sum(1 - F.col("is_p")).alias("n_g"), F.avg("w").alias("w"), F.avg("h").alias("h"))
    full = kept(sizes.where(F.col("n_p") * F.col("n_g") > CROWD).select(*by, *[F.greatest(F.ceil(2 * F.col(c)), F.lit(1)).alias(n) for c, n in (("w", "wide"), ("h", "high"))]))
    return None if full.isEmpty() else full


def in_cells(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The pairs of boxes that share a cell. A box is in every cell that it meets; a pair counts in the cell of its common part's upper left corner only."""
    cell = lambda v, size: F.floor(v / F.col(size))

    def spread(df: DataFrame, s: str) -> DataFrame:
        each = lambda lo, hi, size: F.explode(F.sequence(cell(F.col(lo), size), cell(F.col(hi), size)))
        return df.withColumn("cx", each(f"{s}_minx", f"{s}_maxx", "wide")).withColumn("cy", each(f"{s}_miny", f"{s}_maxy", "high"))

    met = spread(a, "p").join(spread(b, "g").drop("wide", "high"), [*by, "cx", "cy"])
    here = (cell(F.greatest("p_minx", "g_minx"), "wide") == F.col("cx")) & (cell(F.greatest("p_miny", "g_miny"), "high") == F.col("cy"))
    return _met(met.where(here), by)


def _met(both: DataFrame, by: list[str]) -> DataFrame:
    near = (F.col("p_minx") < F.col("g_maxx")) & (F.col("g_minx") < F.col("p_maxx")) & (F.col("p_miny") < F.col("g_maxy")) & (F.col("g_miny") < F.col("p_maxy"))
    side = lambda s: {c: F.col(f"{s}_{c}") for c in BOX}
    return both.where(near).select(*by, "p", "g", iou(side("p"), side("g")).alias("iou"))


def matched(found: DataFrame, by: list[str], threshold: float = 0.0) -> DataFrame:
    """by, p, g, iou of the greedy one-to-one matching of pairs at or above the threshold: the best pair first, ties by place."""
    some = found.where((F.col("iou") >= threshold) & (F.col("iou") > 0))
    many = kept(some.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLD).select(*by))
    if many.isEmpty():
        return folded(some, by)  # the pairs are found again where they lie, which costs less than writing and dealing them out
    some = kept(some)
    return folded(some.join(many, by, "left_anti"), by).unionByName(in_rounds(some.join(many, by, "left_semi"), by))


def folded(some: DataFrame, by: list[str]) -> DataFrame:
    """The greedy matching of few pairs of each key: a fold over the sorted pairs."""
    ranked = F.sort_array(F.collect_list(F.struct(F.negative("iou").alias("k"), "p", "g")))
    # taken places are searched as arrays of numbers, without a call for each of them
    free = lambda acc, x: ~(F.array_contains(acc["p"], x["p"]) | F.array_contains(acc["g"], x["g"]))
    start = F.expr("named_struct('k', array(), 'p', array(), 'g', array())").cast("struct<k:array<double>,p:array<int>,g:array<int>>")
    more = lambda acc, x: F.struct(*[F.array_append(acc[c], x[c]).alias(c) for c in "kpg"])
    taken = F.aggregate("ranked", start, lambda acc, x: F.when(free(acc, x), more(acc, x)).otherwise(acc))
    best = some.groupBy(*by).agg(ranked.alias("ranked")).select(*by, taken.alias("t")).select(*by, F.explode(F.arrays_zip("t.k", "t.p", "t.g")).alias("x"))
    return best.select(*by, F.col("x.p").alias("p"), F.col("x.g").alias("g"), F.negative("x.k").alias("iou"))


def in_rounds(some: DataFrame, by: list[str]) -> DataFrame:
    """The same matching of many pairs: in each round the pairs that come first among those of both their boxes are taken, and what shares a box with them goes.

    The order of pairs is total, so the first pair of all is always such a pair and the greedy matching is the only
    outcome. Each round is written; rounds go with the longest chain of ever better neighbours, which is short.
    """
    order = F.struct(F.negative("iou").alias("k"), "p", "g")
    left, out = kept(some.withColumn("first", order)), []
    while not left.isEmpty():
        best = lambda side: left.groupBy(*by, side).agg(F.min("first").alias("first"))
        taken = kept(best("p").select(*by, "first").join(best("g").select(*by, "first"), [*by, "first"]).select(*by, "first.p", "first.g", F.negative("first.k").alias("iou")))
        out.append(taken)
        gone = lambda side: taken.select(*by, side)
        left = kept(left.join(gone("p"), [*by, "p"], "left_anti").join(gone("g"), [*by, "g"], "left_anti"), gone=left)
    return reduce(DataFrame.unionByName, out) if out else left.drop("first")


def rates(tp: Column, n_pred: Column, n_truth: Column) -> dict[str, Column]:
    """precision, recall (1 for an empty side) and f1."""
    p = F.when(n_pred == 0, F.lit(1.0)).otherwise(tp / n_pred)
    r = F.when(n_truth == 0, F.lit(1.0)).otherwise(tp / n_truth)
    return {"precision": p, "recall": r, "f1": F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))}


def counted(pred: DataFrame, truth: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """by, tp, fp, fn, n_gt, precision, recall, f1 of every key on either side."""
    hits = matched(pairs(pred, truth, by), by, threshold).groupBy(*by).agg(F.count(F.lit(1)).alias("tp"))
    one = lambda df, p: df.select(*by, F.lit(p).alias("np"), F.lit(1 - p).alias("ng"))
    sizes = one(pred, 1).unionByName(one(truth, 0)).groupBy(*by).agg(F.sum("np").alias("np"), F.sum("ng").alias("ng"))
    out = sizes.join(hits, by, "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return out.select(*by, "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"), F.col("ng").alias("n_gt"), *[v.alias(k) for k, v in rates(F.col("tp"), F.col("np"), F.col("ng")).items()])


def compared(pred: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """page, label (null: all classes) with counts and rates. Classes gate the pairs, so a page's counts are the sums of its classes'."""
    each = counted(pred, truth, ["page", "label"], threshold)
    sums = {c: F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n_gt")}
    every = each.groupBy("page").agg(*sums.values())
    all_ = every.select("page", F.lit(None).cast("int").alias("label"), *sums, *[v.alias(k) for k, v in rates(F.col("tp"), F.col("tp") + F.col("fp"), F.col("n_gt")).items()])
    return each.unionByName(all_)


def aligned(pred: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """by, p, g, where an unmatched side is null: a full matching while IoU is above 0, and the rest of both sides."""
    m = matched(pairs(pred, truth, by), by)
    a = pred.select(*by, F.col("ord").alias("p")).join(m.select(*by, "p", "g"), [*by, "p"], "left")
    b = truth.select(*by, F.col("ord").alias("g")).join(m.select(*by, "g"), [*by, "g"], "left_anti")
    return a.select(*by, "p", "g").unionByName(b.select(*by, F.lit(None).cast("int").alias("p"), "g"))


def matched_texts(pred: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """by, truth, read: the texts of aligned lines; a line without a partner meets the empty text. Both sides: by, ord (once in a key), box, text.

    Lines meet in groupings by key and line: where both sides lie by key, as the pairs do, none of them is dealt out again.
    """
    none = F.lit(None)
    m = matched(pairs(pred, truth, by), by)
    read = pred.select(*by, F.col("ord").alias("p"), none.cast(dict(truth.dtypes)["ord"]).alias("g"), F.col("text").alias("read"))
    hits = m.select(*by, "p", "g", none.cast("string").alias("read"))
    read = read.unionByName(hits).groupBy(*by, "p").agg(F.max("g").alias("g"), F.max("read").alias("read"))
    # what has no partner is a group of its own
    read = read.select(*by, "g", F.when(F.col("g").isNull(), F.col("p")).alias("alone"), none.cast("string").alias("truth"), "read")
    said = truth.select(*by, F.col("ord").alias("g"), none.cast(dict(pred.dtypes)["ord"]).alias("alone"), F.col("text").alias("truth"), none.cast("string").alias("read"))
    both = read.unionByName(said).groupBy(*by, "g", "alone").agg(F.max("truth").alias("truth"), F.max("read").alias("read"))
    return both.select(*by, *[F.coalesce(c, F.lit("")).alias(c) for c in ("truth", "read")])


def zipped(pred: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """by, place, p, g: the rows of both sides at equal places by ord; the longer side's rest has no partner and leaves."""
    w = Window.partitionBy(*by).orderBy("ord")
    side = lambda df, name: df.select(*by, (F.row_number().over(w) - 1).alias("place"), F.col("ord").alias(name))
    return side(pred, "p").join(side(truth, "g"), [*by, "place"])


def middle(df: DataFrame, by: list[str], values: list[str], times: str | None = None) -> DataFrame:
    """by, and <value>_lower and <value>_upper of each value: the two middle ones, equal for an odd number; nulls and NaN do not count, and a row counts as often as `times` says.

    Rows are counted by value first, so what is sorted for a key is its distinct values (fractions of a page's counts),
    not its rows.
    """
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("v")) for c in values]))
    df = df.select(*by, F.col(times).alias("__t") if times else F.lit(1).alias("__t"), x.alias("x"))
    n = df.where(F.col("x.v").isNotNull() & ~F.isnan("x.v")).groupBy(*by, "x.of", "x.v").agg(F.sum("__t").alias("__n"))
    w = Window.partitionBy(*by, "of")
    cum = n.withColumns({"__upto": F.sum("__n").over(w.orderBy("v")), "__every": F.sum("__n").over(w)})
    lower, upper = 2 * F.col("__upto") >= F.col("__every"), 2 * F.col("__upto") > F.col("__every")
    at = lambda c, far: F.min(F.when((F.col("of") == c) & far, F.col("v")))
    return cum.groupBy(*by).agg(*[at(c, far).alias(f"{c}_{end}") for c in values for end, far in (("lower", lower), ("upper", upper))])


RATES, COUNTS = ["precision", "recall", "f1"], ["tp", "fp", "fn", "n_gt"]


def _counted_pages(scores: DataFrame, by: list[str]) -> DataFrame:
    """Pages that are equal in all that is summed up, counted as n: the matching below is computed once for all statistics."""
    return scores.groupBy(*by, *RATES, *COUNTS).agg(F.count(F.lit(1)).alias("n"))


def _statistics(pages: DataFrame, by: list[str], sample: bool) -> DataFrame:
    """by, mean, deviation (of a sample or of all), least and most of each rate, and the sums of counts with their rates."""
    n = F.sum("n")
    out = []
    for m in RATES:
        mean = F.sum(F.col(m) * F.col("n")) / n
        square = F.greatest(F.sum(F.col(m) * F.col(m) * F.col("n")) / n - mean * mean, F.lit(0.0))
        std = F.when(n > 1, F.sqrt(square * n / (n - 1))) if sample else F.sqrt(square)
        out += [mean.alias(f"{m}_mean"), std.alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    sums = pages.groupBy(*by).agg(*out, *[F.sum(F.col(c) * F.col("n")).alias(c) for c in COUNTS])
    return sums.withColumns({f"micro_{k}": v for k, v in rates(F.col("tp"), F.col("tp") + F.col("fp"), F.col("n_gt")).items()})


def summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Over pages: mean, middle (between the two middle ones) and population deviation of each rate, and the rates of the sums."""
    pages = _counted_pages(scores, by)
    ends = middle(pages, by, RATES, "n")
    ends = ends.select(*by, *[((F.col(f"{m}_lower") + F.col(f"{m}_upper")) / 2).alias(f"{m}_median") for m in RATES])
    return _statistics(pages, by, False).drop(*[f"{m}_{end}" for m in RATES for end in ("min", "max")]).join(ends, by, "left")


def line_summary(scores: DataFrame) -> DataFrame:
    """Over pages: mean, lower middle, sample deviation, least and most of each rate, and the rates of the sums."""
    pages = _counted_pages(scores, [])
    every = F.lit(0).alias("__all")
    ends = middle(pages.select("*", every), ["__all"], RATES, "n").select("__all", *[F.col(f"{m}_lower").alias(f"{m}_median") for m in RATES])
    return _statistics(pages, [], True).select("*", every).join(ends, "__all", "left").drop("__all")
