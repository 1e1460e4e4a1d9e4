"""URL filters: rules for hosts and paths, and for the rest logistic regression on hashed character n-grams.

DataFrame functions only, the ML library's among them; a URL's n-grams come from regular expressions in time linear in
its length. A host's last label (its top-level domain) makes no n-grams, so it decides nothing. Training takes the small
labelled table given (by default data/url_seed.csv: names written by hand, each under two of ten domains, every domain
as often in one class as in the other; at most `max_rows` rows, the first by hash), in one partition, so weights do not
depend on how rows lie. Scoring maps over urls where they lie, with `2 ** bits` weights.

Defined cases: a null url or one without `://` has an empty host and path, no rule, and the model's verdict on empty
strings; repeated and equal urls are judged alike; where the labelled table lacks a class its only class is the verdict
(allow without rows); extra columns are kept, those named like an output (host, path, rule, verdict, block_score) are
replaced by it.
"""

from __future__ import annotations

from importlib import resources

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 14
#: The model blocks from this probability on: n-grams that it has not met leave a url near one half, which is no evidence.
LEAST = 0.8


def seed(spark: SparkSession) -> DataFrame:
    """url, label of the labelled table that comes with the package; 1 is to block."""
    lines = resources.files(__package__).joinpath("data/url_seed.csv").read_text(encoding="utf-8").splitlines()[1:]
    rows = [line.rsplit(",", 1) for line in lines]
    return spark.createDataFrame([(u, int(y)) for u, y in rows], "url string, label int")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, with A-Z lower-cased."""
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ngrams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams of the host without its last label and of the path, told apart by a mark."""
    host = F.regexp_replace(host, r"\.[^.]*$", "")

    def grams(mark: str, s: Column) -> list[Column]:
        found = [F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
        return [F.transform(f, lambda g: F.concat(F.lit(mark), g)) for f in found]

    return F.concat(*grams("h", F.concat(F.lit("^"), host, F.lit("$"))), *grams("p", F.concat(path, F.lit("$"))))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule or null, verdict or null): the longest fitting rule of (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a later, longer one wins
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, url: str = "url", bits: int = BITS, least: float = LEAST, max_rows: int = 2000) -> DataFrame:
    """pages without other columns of these names, and host, path, rule, verdict, block_score (null where a rule decides)."""
    spark = pages.sparkSession
    labelled = seed(spark) if labelled is None else labelled.select("url", "label")
    labelled = labelled.where("label in (0, 1)").orderBy(F.xxhash64("url"), "url").limit(max_rows)
    grams = lambda df, u: df.withColumn("__grams", ngrams(host_of(u), path_of(u)))
    learn = grams(labelled, F.col("url")).select("__grams", F.col("label").cast("double").alias("__label")).coalesce(1)
    classes = [r[0] for r in learn.groupBy("__label").count().orderBy("__label").collect()]  # at most two rows
    outputs = {"host", "path", "rule", "verdict", "block_score"}
    names = [c for c in pages.columns if c not in outputs or c == url]
    u = F.col(f"`{url}`")
    df = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), host_of(u).alias("host"), path_of(u).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "by_rule": verdict})
    if len(classes) == 2:
        tf = HashingTF(inputCol="__grams", outputCol="x", numFeatures=1 << bits, binary=True)
        lr = LogisticRegression(featuresCol="x", labelCol="__label", predictionCol="block", probabilityCol="p", rawPredictionCol="raw", maxIter=60, regParam=0.005)
        model = Pipeline(stages=[tf, lr]).fit(learn)
        df = model.transform(df.withColumn("__grams", ngrams(F.col("host"), F.col("path"))))
        score = F.get(vector_to_array("p"), F.lit(1))
        block = score >= least
    else:
        only = bool(classes and classes[0])
        score, block = F.lit(1.0 if only else 0.0), F.lit(only)
    df = df.withColumns({"verdict": F.coalesce("by_rule", F.when(block, "block").otherwise("allow")), "block_score": F.when(F.col("rule").isNull(), score)})
    own = [F.col("row").getField(c).alias(c) for c in names]
    return df.select(*own, *[c for c in ("host", "path", "rule", "verdict", "block_score") if c != url])
