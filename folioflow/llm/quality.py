"""Quality rules: adaptive fences from mergeable quantile sketches per language and source, then a joined filter.

Everything here is DataFrame expressions. A sketch is a log-linear histogram: an integer v below 64 has its own
bucket, a larger one shares a bucket of relative width 1/32. Sketches of parts add up bucket by bucket, so partial
aggregation merges them before the shuffle, and the sketch of a language is the sum of its sources' sketches. A
sketch has at most 64 + 32 * 57 buckets, however many rows feed it. Results do not depend on the order of rows.

Defined cases: a null text counts as empty; an empty text has no words and fails the base rule; null languages and
sources are groups of their own; a group with fewer than `min_group` documents takes the fences of its language,
and a language with as few takes those of all documents; repeated rows count each time; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, words

#: Bits of a packed window that hold its position; the others hold the head of a hash that only proposes pairs.
POSITION_BITS = 30

#: metric -> (slack added above the fence, slack taken below it or None where only high values are suspect)
METRICS: dict[str, tuple[int, int | None]] = {
    "word_length": (200, 200),  # code points in 100 words
    "symbols": (100, None),  # symbols in 1000 words
    "dup_lines": (500, None),  # repeated lines in 1000 lines
    "repeat_words": (400, None),  # words in repeated windows in 1000 words
}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def features(docs: DataFrame, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The columns of `keep` and the base features of each whole text.

    A 3-word window is proposed as repeated when the head of its hash occurs twice in the text; the proposal is then
    compared as text, so the count is exact. Cost grows as n log n with a text's words.
    """
    kept = [F.col(f"`{c}`") for c in (keep or docs.columns)]
    n = lambda c: F.col(f"__{c}")
    df = docs.select(F.struct(*kept).alias("__row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    df = df.select("__row", "__t", words(n("t")).alias("__w"))
    lines = F.filter(F.split(n("t"), "\n"), lambda x: x.rlike(WORD))
    mask = (1 << POSITION_BITS) - 1
    window = lambda w, i: F.shiftleft(F.xxhash64(w, F.get(n("w"), i + 1), F.get(n("w"), i + 2)), POSITION_BITS).bitwiseOR(i.cast("long"))
    df = df.select(
        "__row",
        "__w",
        F.regexp_count(n("t"), F.lit("[#*$%&|<>]")).cast("long").alias("__n_symbols"),
        lines.alias("__l"),
        F.char_length(F.array_join(n("w"), "")).cast("long").alias("__word_chars"),
        F.size("__w").cast("long").alias("__n_words"),
        F.sort_array(F.transform(F.slice(n("w"), F.lit(1), F.greatest(F.size("__w") - 2, F.lit(0))), window)).alias("__p"),
    )
    head = lambda x: F.shiftright(x, POSITION_BITS)
    near = lambda x, i: (head(x) == head(F.get(n("p"), i - 1))) | (head(x) == head(F.get(n("p"), i + 1)))
    df = df.select("*", F.transform(F.filter(n("p"), near), lambda x: x.bitwiseAND(F.lit(mask)).cast("int")).alias("__c"))
    said = lambda p: F.struct(F.concat_ws(" ", F.get(n("w"), p), F.get(n("w"), p + 1), F.get(n("w"), p + 2)).alias("g"), p.alias("p"))
    df = df.select("*", F.sort_array(F.transform(n("c"), said)).alias("__e"))
    same = lambda x, i: (x["g"] == F.get(n("e"), i - 1)["g"]) | (x["g"] == F.get(n("e"), i + 1)["g"])
    covered = F.flatten(F.transform(F.filter(n("e"), same), lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    found = F.struct(
        n("n_words").alias(f"{prefix}n_words"),
        n("word_chars").alias(f"{prefix}word_chars"),
        n("n_symbols").alias(f"{prefix}n_symbols"),
        F.size("__l").cast("long").alias(f"{prefix}n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias(f"{prefix}n_dup_lines"),
        F.size(F.array_distinct(covered)).cast("long").alias(f"{prefix}n_repeat_words"),
    )
    # a filter on a feature is not to be moved below and computed there for each word: nothing is pushed into a generator
    return df.select("__row", F.inline(F.array(found))).select("__row.*", *[f"{prefix}{c}" for c in FEATURES])


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def metrics(prefix: str = "") -> dict[str, Column]:
    share = lambda a, b, of: F.expr(f"({of} * `{prefix}{a}`) div greatest(`{prefix}{b}`, 1)")
    return {"word_length": share("word_chars", "n_words", 100), "symbols": share("n_symbols", "n_words", 1000), "dup_lines": share("n_dup_lines", "n_lines", 1000), "repeat_words": share("n_repeat_words", "n_words", 1000)}


def bucket(v: Column) -> Column:
    """The sketch's bucket of an integer from 0."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (shift * 32 + F.call_function("shiftright", v, shift)).cast("long")


def bucket_top(b: Column) -> Column:
    """The largest integer of a bucket."""
    shift = F.greatest(F.floor((b - 32) / 32), F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - shift * 32 + 1, shift) - 1


def sketches(feats: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """lang, source, metric, bucket, n: the sketches of the documents that pass the base rule."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metrics(prefix).items()])
    rows = feats.where(~base_failed(prefix)).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), F.explode(pairs).alias("x"))
    return rows.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, by: list[str], spread: float = 3.0) -> DataFrame:
    """by, n_docs and for each metric its lowest and highest value kept: quartiles widened by `spread` times their distance and the slack."""
    w = Window.partitionBy(*by, "metric")
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    cum = merged.withColumns({"cum": F.sum("n").over(w.orderBy("bucket")), "all": F.sum("n").over(w)})
    at = lambda num: F.min(F.when(4 * F.col("cum") >= num * F.col("all"), bucket_top(F.col("bucket"))))
    q = cum.groupBy(*by, "metric").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("all").alias("n_docs"))
    pick = lambda m, x: F.max(F.when(F.col("metric") == m, x))
    wide = F.col("q3") - F.col("q1")
    out = []
    for m, (above, below) in METRICS.items():
        out.append(pick(m, F.col("q3") + spread * wide + above).alias(f"{m}_hi"))
        out.append(pick(m, F.col("q1") - spread * wide - below if below is not None else F.lit(-1.0)).alias(f"{m}_lo"))
    return q.groupBy(*by).agg(F.max("n_docs").alias("n_docs"), *out)


def thresholds(sketch: DataFrame, min_group: int = 50) -> DataFrame:
    """One row of fences for each language and source that has a sketch; small groups take merged sketches' fences."""
    own, lang, whole = fences(sketch, ["lang", "source"]), fences(sketch, ["lang"]), fences(sketch, [])
    names = [f"{m}_{end}" for m in METRICS for end in ("lo", "hi")]
    own = own.select(F.struct("lang", "source").alias("key"), F.struct("n_docs", *names).alias("own"))
    lang = lang.select(F.col("lang").alias("of_lang"), F.struct("n_docs", *names).alias("by_lang"))
    whole = whole.select(F.struct("n_docs", *names).alias("of_all"))
    met = own.join(lang, F.col("key.lang").eqNullSafe(F.col("of_lang"))).crossJoin(F.broadcast(whole))  # whole is one row
    got = lambda c: F.when(F.col("own.n_docs") >= min_group, F.col(f"own.{c}")).when(F.col("by_lang.n_docs") >= min_group, F.col(f"by_lang.{c}")).otherwise(F.col(f"of_all.{c}"))
    return met.select(F.struct("key.lang", "key.source").alias("__key"), F.struct(*[got(c).alias(c) for c in names]).alias("__fence"))


def judged(feats: DataFrame, fence: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """feats with base_failed and kept, by a join with the fences. The fences are few; Spark broadcasts them only when they measure below its threshold."""
    met = feats.join(fence, F.col(f"`{lang}`").eqNullSafe(F.col("__key.lang")) & F.col(f"`{source}`").eqNullSafe(F.col("__key.source")), "left")
    good = ~base_failed(prefix)
    for m, v in metrics(prefix).items():
        good = good & F.coalesce((v >= F.col(f"__fence.{m}_lo")) & (v <= F.col(f"__fence.{m}_hi")), F.lit(True))
    return met.withColumns({f"{prefix}base_failed": base_failed(prefix), f"{prefix}kept": good}).drop("__key", "__fence")


def quality_rules(docs: DataFrame, min_group: int = 50, lang: str = "lang", source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the base features, base_failed and kept of every document. Texts are read once and never shuffled."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    found = staged(features(own, "text", ["doc_id", "lang", "source"]), "quality-features")
    fence = staged(thresholds(sketches(found), min_group), "quality-fences")
    return judged(found, fence).drop("lang", "source")


def quality_filter(docs: DataFrame, min_group: int = 50, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The documents that quality_rules keeps, with all their columns. They are written once with their features beside them, which costs less than computing features twice or shuffling texts to join them."""
    names = {lang: "lang", source: "source", text: "text"}
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = staged(features(own, "text", ["row", "lang", "source"]), "quality-features")
    fence = staged(thresholds(sketches(found), min_group), "quality-fences")
    return judged(found, fence).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
