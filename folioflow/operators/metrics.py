"""Text and class metrics as aggregations with partial sums."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import code_points, narrow_points, sliced


#: Pairs of texts with more cells than this fill no table: their columns are whole numbers of as many bits.
LONG = 1 << 20


def bounded_distances(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The edit distance of each pair of texts where bounds from above and below meet, else -1.

    Texts of one length are at most as far apart as places differ, and at least as far as their characters differ when
    counted: these are equal where no character that a differing place loses comes back at another one (and distances
    below 3 are settled by the length alone). Of two lengths, the shorter text made of a start and an end of the longer
    one is as far as the lengths are.
    """
    n, m = (pc.fill_null(pc.utf8_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in (a, b))
    out = np.abs(n - m)
    same, other = np.flatnonzero((n == m) & (n > 0)), np.flatnonzero((n != m) & (np.minimum(n, m) > 0))
    open_ = np.zeros(len(n), bool)
    if len(same):  # side by side, place for place
        (x, ends), (y, _) = (narrow_points(t.take(pa.array(same))) for t in (a, b))
        differs = x != y
        out[same] = count = np.add.reduceat(differs, ends - n[same], dtype=np.int64)
        place, row = np.flatnonzero(differs), np.repeat(np.arange(len(same)), count)
        if (count <= 2).any():
            many = count[row] > 2
            place, row = place[many], row[many]
        codes = [np.unique(row << 21 | c[place]) for c in (x, y)]
        open_[same[np.intersect1d(*codes, assume_unique=True) >> 21]] = True
    if len(other):
        n, m = n[other], m[other]
        short = np.minimum(n, m)
        (x, ends_x), (y, ends_y) = (narrow_points(t.take(pa.array(other))) for t in (a, b))
        first = _alike(x, y, ends_x - n, ends_y - m, short)
        rest = np.flatnonzero(first < short)  # the others end where the shorter text does
        if len(rest):
            last = _alike(x[::-1], y[::-1], len(x) - ends_x[rest], len(y) - ends_y[rest], short[rest])
            open_[other[rest]] = first[rest] + last < short[rest]
    return np.where(open_, -1, out)


def _alike(x: np.ndarray, y: np.ndarray, x0: np.ndarray, y0: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row, how many of its n (at least 1) characters from x0 in x and from y0 in y are alike before the first that differs."""
    begin = np.cumsum(n) - n
    place = np.arange(n.sum())
    differs = x[place + np.repeat(x0 - begin, n)] != y[place + np.repeat(y0 - begin, n)]
    at = np.append(np.flatnonzero(differs), len(place))
    return np.minimum(at[np.searchsorted(at, begin)] - begin, n)


def bit_distance(a: str, b: str) -> int:
    """Edit distance by Myers' and Hyyrö's bit vectors: a column of the table is two numbers with a bit for each character of a."""
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, out = every, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        vertical = eq | down
        level = ((eq & up) + up ^ up) | eq
        more, less = down | ~(level | up) & every, up & level
        out += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | ~(vertical | more) & every, more & vertical
    return out


def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    found = []
    for part in sliced(pa.RecordBatch.from_arrays([a, b], names=["a", "b"]), "a", "b"):
        one = bounded_distances(*part.columns)
        known = pc.and_(pc.is_valid(part.column("a")), pc.is_valid(part.column("b"))).to_numpy(zero_copy_only=False)
        size = pc.multiply(*[pc.fill_null(pc.utf8_length(c), 0).cast(pa.int64()) for c in part.columns]).to_numpy()
        for i in np.flatnonzero((one < 0) & known & (size > LONG)):
            one[i] = bit_distance(part.column("a")[i].as_py(), part.column("b")[i].as_py())
        found.append(pa.array(one, pa.int32(), mask=~known | (one < 0)))
    return pa.concat_arrays(found) if found else pa.array([], pa.int32())


def edit_distance(a: Column, b: Column) -> Column:
    """The edit distance of two texts. Equal ones, and pairs whose bounds meet, cost no table; of the others short ones fill it and long ones step over it in whole columns."""
    found = F.arrow_udf(_distances, "int")(F.when(a != b, a), F.when(a != b, b))
    return F.when(a == b, F.lit(0)).otherwise(F.coalesce(found, F.levenshtein(a, b)))


def line_errors(truth: Column, read: Column) -> dict[str, Column]:
    """distance, length (of the longer text) and ratio of a line; ratio is null where both are empty."""
    d = edit_distance(truth, read)
    n = F.greatest(F.length(truth), F.length(read))
    return {"distance": d, "length": n, "ratio": F.when(n > 0, d / n)}


def confident(conf: Column, threshold: float | None) -> Column:
    """A missing or zero threshold lets everything pass."""
    return F.lit(True) if not threshold else conf >= threshold


def error_rates(lines: DataFrame, by: list[str]) -> DataFrame:
    """lines: truth, read, and optionally `used` (false: the line counts, but is not scored). Rates by key, or of all lines.

    line_score = 1 - sum of ratios / all lines; line_median = 1 - middle ratio; char_ratio = sum of distances / sum of
    lengths (0 without lines); correct and bad: shares of scored lines with ratio 0 and above 0.1.
    """
    e = line_errors(F.col("truth"), F.col("read"))
    used = F.col("used") if "used" in lines.columns else F.lit(True)
    scored = used & (e["length"] > 0)
    df = lines.select(*by, F.when(scored, e["distance"]).alias("distance"), F.when(scored, e["length"]).alias("length"))
    # lines are counted by distance and length first: what is sorted for the middle is distinct pairs, not lines
    n = df.groupBy(*by, "distance", "length").agg(F.count(F.lit(1)).alias("n")).withColumn("ratio", F.col("distance") / F.col("length"))
    n = n.withColumn("n_scored", F.when(F.col("ratio").isNotNull(), F.col("n")).otherwise(0))
    # what lies before a ratio is what lies before its thousandth, and what lies before it there: no window sorts all of a key's pairs
    n = n.withColumn("cell", F.floor(F.col("ratio") * 1000))
    cells = n.groupBy(*by, "cell").agg(F.sum("n_scored").alias("of_cell"))
    w = Window.partitionBy(*by)
    cells = cells.withColumns({"before": F.sum("of_cell").over(w.orderBy("cell")) - F.col("of_cell"), "every": F.sum("of_cell").over(w)}).drop("of_cell")
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "cell"]]
    n = n.alias("n").join(cells.alias("c"), reduce(lambda x, y: x & y, same)).select("n.*", "before", "every")
    n = n.withColumn("upto", F.col("before") + F.sum("n_scored").over(Window.partitionBy(*by, "cell").orderBy("ratio")))
    middle = (F.min(F.when(2 * F.col("upto") >= F.col("every"), F.col("ratio"))) + F.min(F.when(2 * F.col("upto") > F.col("every"), F.col("ratio")))) / 2
    total = lambda c: F.sum(F.col(c) * F.col("n"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0))
    s = n.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"), F.coalesce(F.sum("n_scored"), F.lit(0)).alias("n_scored"), total("distance").alias("distance"), total("length").alias("length"), total("ratio").alias("rs"), middle.alias("rm"), count(F.col("ratio") == 0).alias("n_correct"), count(F.col("ratio") > 0.1).alias("n_bad"), F.min("ratio").alias("least_ratio"), F.max("ratio").alias("most_ratio"))
    share = lambda c: F.try_divide(F.col(c), F.col("n_scored"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return s.select(*by, "n_lines", "n_scored", F.coalesce("distance", F.lit(0)).alias("distance"), F.coalesce("length", F.lit(0)).alias("length"), F.when(F.col("n_lines") > 0, 1 - zero(F.col("rs")) / F.col("n_lines")).otherwise(F.lit(0.0)).alias("line_score"), (1 - F.col("rm")).alias("line_median"), zero(F.try_divide(F.col("distance"), F.col("length"))).alias("char_ratio"), share("n_correct").alias("correct"), share("n_bad").alias("bad"), "least_ratio", "most_ratio")


def confusion(df: DataFrame, target: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(target).alias("target"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(matrix: DataFrame, classes: int = 10) -> DataFrame:
    """label, n_target, n_pred, hits, csi, precision, recall, f1, weight for labels 0.. classes - 1; rates are NaN where nothing has the class."""
    both = F.array(F.struct(F.col("target").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))
    sums = matrix.select(F.explode(both).alias("x")).groupBy("x.label").agg(F.sum("x.t").alias("n_target"), F.sum("x.p").alias("n_pred"), F.sum("x.h").alias("hits"))
    labels = matrix.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    out = labels.join(sums, "label", "left").na.fill(0, ["n_target", "n_pred", "hits"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(float("nan")))
    h, t, p = F.col("hits"), F.col("n_target"), F.col("n_pred")
    return out.withColumns({"csi": ratio(h, t + p - h), "precision": ratio(h, p), "recall": ratio(h, t), "f1": ratio(2 * h, t + p), "weight": F.greatest(t, p)})


def overall(per_class: DataFrame) -> DataFrame:
    """Accuracy, Jaccard weighted by target counts, mean CSI over present classes, and the early-stop score (sum of squared misses, absent classes as 0)."""
    csi = F.nanvl("csi", F.lit(0.0))
    present = ~F.isnan("csi")
    return per_class.agg((F.sum("hits") / F.sum("n_target")).alias("accuracy"), (F.sum(F.col("n_target") * csi) / F.sum("n_target")).alias("weighted_jaccard"), F.avg(F.when(present, F.col("csi"))).alias("mean_csi"), F.sum(F.pow(1 - csi, 2)).alias("stop_score"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean that skips NaN; NaN where no weight is left."""
    w = F.sum(F.when(~F.isnan(value), weight).otherwise(0))
    return F.when(w > 0, F.sum(F.when(~F.isnan(value), value * weight).otherwise(0.0)) / w).otherwise(F.lit(float("nan")))


def histogram(df: DataFrame, label: str, classes: int = 10) -> DataFrame:
    """label, n, ratio for every label from 0; absent ones count 0."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    out = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("label")).join(n, "label", "left").na.fill(0, ["n"])
    total = n.agg(F.sum("n").alias("total"))  # one row
    return out.crossJoin(F.broadcast(total)).select("label", "n", F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("ratio"))


def vocabulary(lines: DataFrame, text: str, order: list[str]) -> DataFrame:
    """char, n and rank by first appearance. A batch of lines gives one row for each of its characters, counted in numpy, so neither a sort nor a shuffle gets one for each character of the text; only the characters are ranked."""
    kinds = dict(lines.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, text):
                b = b.take(pc.sort_indices(b.select(order), [(c, "ascending") for c in order], null_placement="at_start"))
                codes, ends = code_points(b.column(text))
                if not len(codes):
                    continue
                n = np.bincount(codes)
                first = np.zeros(len(n), np.int64)
                first[codes[::-1]] = np.arange(len(codes))[::-1]  # of equal places the last one stays: the first appearance
                found = np.flatnonzero(n)
                row = np.searchsorted(ends, first[found], "right")
                at = first[found] - np.concatenate([[0], ends])[row]
                chars = pa.array([chr(c) for c in found], pa.string())
                yield pa.RecordBatch.from_arrays([chars, pa.array(n[found], pa.int64()), *b.select(order).take(pa.array(row)).columns, pa.array(at, pa.int64())], names=["char", "n", *order, "at"])

    c = lines.select(*order, text).where(F.col(text).isNotNull()).mapInArrow(run, "char string, n long, " + ", ".join(f"`{k}` {kinds[k]}" for k in order) + ", at long")
    v = c.groupBy("char").agg(F.sum("n").alias("n"), F.min(F.struct(*order, "at")).alias("first"))
    return v.select("char", "n", F.row_number().over(Window.orderBy("first")).alias("rank"))
