"""Queries of text quality, export, vocabulary and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import metrics as M
from ..operators import text_export as X
from . import views as V
from .registry import query

W = "WITH "
#: DuckDB's edit distance counts bytes. So the SQL writes each character of a line as one byte, the place of its character among those of all lines (at most 127), which changes no distance.
_CODED = """, ab AS (SELECT list(DISTINCT c ORDER BY c) AS abc FROM (SELECT unnest(string_split(g || o, '')) AS c FROM tl)),
cd AS (SELECT doc_id, line, g, o, coalesce(array_to_string(list_transform(string_split(g, ''), lambda c: chr(list_position(abc, c)::INT)), ''), '') AS gc, coalesce(array_to_string(list_transform(string_split(o, ''), lambda c: chr(list_position(abc, c)::INT)), ''), '') AS oc FROM tl, ab)"""
_ERR = V.WHOLE_LINES + _CODED + """, e AS (SELECT doc_id, CASE WHEN greatest(length(g), length(o)) > 0 THEN levenshtein(gc, oc) END AS d, CASE WHEN greatest(length(g), length(o)) > 0 THEN greatest(length(g), length(o)) END AS n FROM cd)"""
_RATES = "count(*) AS n_lines, count(d) AS n_scored, coalesce(sum(d), 0)::BIGINT AS distance, coalesce(sum(n), 0)::BIGINT AS length, round(1 - coalesce(sum(d / n), 0) / count(*), 6) AS line_score, round(1 - median(d / n), 6) AS line_median, round(coalesce(sum(d)::DOUBLE / nullif(sum(n), 0), 0), 6) AS char_ratio, round(count(*) FILTER (d = 0) / nullif(count(d), 0), 6) AS correct, round(count(*) FILTER (d / n > 0.1::DOUBLE) / nullif(count(d), 0), 6) AS bad, round(min(d / n), 6) AS least_ratio, round(max(d / n), 6) AS most_ratio FROM e"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.whole_lines(spark, sf_dir).withColumnsRenamed({"g": "truth", "o": "read"})


@query("ocr_cer_corpus", W + _ERR + " SELECT " + _RATES)
def ocr_cer_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.error_rates(_read(spark, sf_dir), []))


@query("ocr_page_quality", W + _ERR + " SELECT doc_id, " + _RATES + " GROUP BY doc_id")
def ocr_page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.error_rates(_read(spark, sf_dir), ["doc_id"]))


@query("ocr_conf_filtered", W + _ERR.replace("CASE WHEN greatest(length(g), length(o)) > 0", "CASE WHEN (line % 10) / 10.0::DOUBLE >= 0.4::DOUBLE AND greatest(length(g), length(o)) > 0") + " SELECT " + _RATES)
def ocr_conf_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir)
    return _rounded(M.error_rates(df.withColumn("used", M.confident((F.col("line") % 10) / 10.0, 0.4)), []))


_EXTRA = ", ".join(f"chr({ord(c)})" for c in T.CUSTOM)
_WHOLE_IDS = f"list_transform(string_split(g, ''), lambda c: CASE WHEN unicode(c) < {T.UNICODE} THEN unicode(c) + 4 ELSE coalesce(nullif(list_position([{_EXTRA}], c), 0) + {T.UNICODE + 3}, 2) END)"


@query("tokenize", W + V.WHOLE_LINES + f", i AS (SELECT doc_id, line, list_concat([1], CASE WHEN g = '' THEN [] ELSE {_WHOLE_IDS} END, [3]) AS ids FROM tl) SELECT doc_id, line, array_to_string(ids, ' ') AS ids, array_to_string(ids[1:{T.MAX_LENGTH}], ' ') AS model_ids FROM i")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character of every line in the reference's vocabulary; model_ids are the ids that fit its model."""
    df = V.whole_lines(spark, sf_dir).select("doc_id", "line", T.tokenise(F.col("g"), T.UNICODE, T.CUSTOM).cast("array<string>").alias("ids"))
    return df.select("doc_id", "line", F.array_join("ids", " ").alias("ids"), F.array_join(F.slice("ids", 1, T.MAX_LENGTH), " ").alias("model_ids"))


_OUTSIDE = rf"[^\x{{0}}-\x{{{T.UNICODE - 1:x}}}{''.join(rf'\x{{{ord(c):x}}}' for c in T.CUSTOM)}]"


@query("detokenize", W + V.WHOLE_LINES + f" SELECT doc_id, line, regexp_replace(g, '{_OUTSIDE}', '', 'g') AS text FROM tl")
def detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = T.tokenise(F.col("g"), T.UNICODE, T.CUSTOM)
    return V.whole_lines(spark, sf_dir).select("doc_id", "line", T.detokenise(ids, T.alphabet(T.UNICODE, T.CUSTOM)).alias("text"))


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as regions, their turns as lines; the reading order runs backwards."""
    df = V.read(spark, sf_dir, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    df = df.withColumn("ord", n.cast("int"))
    custom = F.when(F.col("ord") % 7 == 0, "none").otherwise(F.format_string("readingOrder {index:%d;} structure {type:%s;}", F.lit(40) - F.col("ord"), "role"))
    df = df.select(F.expr("conv_id div 20").alias("page"), F.col("conv_id").alias("region"), "ord", F.col("role").alias("class"), (F.col("ord") / 8).alias("conf"), "text", custom.alias("custom"))
    return X.ordered(df, ["page", "region"])


_TALK = """talk0 AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text))::INT AS ord FROM conversations),
talk AS (SELECT conv_id // 20 AS page, conv_id AS region, ord, role AS class, ord / 8.0::DOUBLE AS conf, text, (row_number() OVER (PARTITION BY conv_id ORDER BY 40 - ord, ord) - 1)::INT AS position FROM talk0 WHERE ord % 7 <> 0)"""


@query("text_export_region", W + _TALK + " SELECT page, region, class, round(avg(conf) FILTER (length(text) > 0), 6) AS confidence, coalesce(string_agg(text, chr(10) ORDER BY position) FILTER (length(text) > 0), '') AS text FROM talk GROUP BY page, region, class")
def text_export_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(X.region_rows(_talk(spark, sf_dir)))


@query("text_export_lines", W + _TALK + " SELECT page, region, (row_number() OVER (PARTITION BY page, region ORDER BY position))::INT AS line, class, conf AS confidence, text FROM talk WHERE length(text) > 0")
def text_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.line_rows(_talk(spark, sf_dir))


@query("text_export_json", W + _TALK + ", rg AS (SELECT page, region, class, list(text ORDER BY position, text) AS t FROM talk WHERE length(text) > 0 GROUP BY page, region, class) SELECT page, to_json(list({'class': class, 'text': t} ORDER BY region, class, t))::VARCHAR AS json FROM rg GROUP BY page")
def text_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.page_json(_talk(spark, sf_dir))


_RES = "res AS (SELECT doc_id, line, o FROM tl WHERE line % 3 <> 0)"


@query("vocabulary", W + V.WHOLE_LINES + """, c AS (SELECT doc_id, line, i, g[i] AS char FROM (SELECT doc_id, line, g, unnest(range(1, length(g) + 1)) AS i FROM tl))
SELECT char, n, (row_number() OVER (ORDER BY first))::INT AS rank FROM (SELECT char, count(*) AS n, min((doc_id, line, i)) AS first FROM c GROUP BY char)""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.vocabulary(V.whole_lines(spark, sf_dir), "g", ["doc_id", "line"])


# two results for every third of the lines that have one, of which the last counts
_RES = "res AS (SELECT doc_id, line, o, 0 AS turn FROM tl WHERE line % 3 <> 0 UNION ALL SELECT doc_id, line, 'again ' || o, 1 FROM tl WHERE line % 9 = 1)"


@query("attach_text", W + V.WHOLE_LINES + ", " + _RES + ", last AS (SELECT doc_id, line, arg_max(o, turn) AS o FROM res GROUP BY doc_id, line) SELECT tl.doc_id AS page, tl.line AS line_id, trim(r.o) AS text FROM tl LEFT JOIN last r ON tl.doc_id = r.doc_id AND tl.line = r.line")
def attach_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    tl = V.whole_lines(spark, sf_dir).select(F.col("doc_id").alias("page"), F.col("line").alias("line_id"), F.col("g").alias("text"), "o")
    first = tl.where("line_id % 3 <> 0").select("page", "line_id", F.lit(0).alias("ord"), F.col("o").alias("text"))
    second = tl.where("line_id % 9 = 1").select("page", "line_id", F.lit(1).alias("ord"), F.concat(F.lit("again "), "o").alias("text"))
    return X.attach_by_id(tl.drop("o"), first.unionByName(second)).select("page", "line_id", "text")


@query("replace_text", W + V.WHOLE_LINES + ", res AS (SELECT doc_id, line, o FROM tl WHERE line % 3 <> 0) SELECT tl.doc_id AS page, tl.line AS line_id, CASE WHEN length(r.o) > 0 THEN r.o ELSE tl.g END AS text FROM tl LEFT JOIN res r ON tl.doc_id = r.doc_id AND tl.line = r.line")
def replace_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    tl = V.whole_lines(spark, sf_dir).select(F.col("doc_id").alias("page"), F.col("line").alias("line_id"), F.col("g").alias("text"), "o")
    res = tl.where("line_id % 3 <> 0").select("page", "line_id", F.col("o").alias("text"))
    return X.replace_text(tl.drop("o"), res).select("page", "line_id", "text")


@query("path_stem", "SELECT page_id, n[1:greatest(length(n) - 4, 0)] AS stem, url FROM (SELECT page_id, url, string_split(string_split(url, '?')[1], '/')[-1] AS n FROM pages)")
def path_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; names shorter than the suffix have an empty stem."""
    return V.read(spark, sf_dir, "pages").select("page_id", T.short_stem(F.substring_index("url", "?", 1)).alias("stem"), "url")
