"""Queries of general polygons, rasters' outlines, baselines, and the texts of matched lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import tokens as T
from ..operators import matching as A
from ..operators import metrics as M
from ..operators import runs as R
from ..operators import shapes as S
from ..operators import splits as D
from . import views as V
from .evaluation_queries import _matched, _sides
from .registry import query
from .text_queries import _RATES, _rounded

_AREA = "greatest(least({a}.{x2}, {b}.{u2}) - greatest({a}.{x1}, {b}.{u1}), 0)::DOUBLE * greatest(least({a}.{y2}, {b}.{v2}) - greatest({a}.{y1}, {b}.{v1}), 0)"
_WHOLE, _CUT = ("minx", "miny", "maxx", "maxy"), ("mx", "miny", "maxx", "my")


def _shared(a: str, b: str, one: tuple[str, ...], two: tuple[str, ...]) -> str:
    return _AREA.format(a=a, b=b, x1=one[0], y1=one[1], x2=one[2], y2=one[3], u1=two[0], v1=two[1], u2=two[2], v2=two[3])


def _corner_shape(a: str, b: str) -> str:
    """Area that two boxes without their upper right quarters share, by inclusion and exclusion."""
    return f"{_shared(a, b, _WHOLE, _WHOLE)} - {_shared(a, b, _CUT, _WHOLE)} - {_shared(a, b, _WHOLE, _CUT)} + {_shared(a, b, _CUT, _CUT)}"


def _with_corner(df: DataFrame) -> DataFrame:
    """Boxes without their upper right quarters, as polygons of six corners."""
    at = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    mx, my = "minx + int((maxx - minx) / 2)", "miny + int((maxy - miny) / 2)"
    points = F.array(at("minx", "miny"), at(mx, "miny"), at(mx, my), at("maxx", my), at("maxx", "maxy"), at("minx", "maxy"))
    return df.select("page", "label", "ord", points.alias("points"))


_MID = "*, minx + (maxx - minx) // 2 AS mx, miny + (maxy - miny) // 2 AS my"


@query("polygon_iou", f"""WITH {V.REGIONS}, {V.PREDICTED}, p AS (SELECT {_MID} FROM predicted), g AS (SELECT {_MID} FROM regions),
pr AS (SELECT p.page, p.label, p.ord AS p, g.ord AS g, {_corner_shape('p', 'p')} AS a1, {_corner_shape('g', 'g')} AS a2, {_corner_shape('p', 'g')} AS it FROM p JOIN g ON p.page = g.page AND p.label = g.label)
SELECT page, label, p, g, round(it / (a1 + a2 - it), 6) AS iou FROM pr WHERE it > 0""")
def polygon_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, truth = _sides(spark, sf_dir)
    return _rounded(S.polygon_pairs(_with_corner(pred), _with_corner(truth), ["page", "label"]))


@query("page_hull", f"""WITH {V.REGIONS}, pt AS (SELECT DISTINCT page, x::DOUBLE AS x, y::DOUBLE AS y FROM (SELECT page, minx AS x, miny AS y FROM regions UNION ALL SELECT page, maxx, maxy FROM regions)),
ed AS (SELECT p.page, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM pt p JOIN pt q ON p.page = q.page AND (p.x, p.y) <> (q.x, q.y)),
outer_ed AS (SELECT * FROM ed ANTI JOIN pt r ON r.page = ed.page AND ((qx - px) * (r.y - py) < (qy - py) * (r.x - px) OR ((qx - px) * (r.y - py) = (qy - py) * (r.x - px) AND (r.x - px) * (r.x - qx) + (r.y - py) * (r.y - qy) > 0)))
SELECT page, count(*)::INT AS n_corners, round(abs(sum(px * qy - qx * py)) / 2, 3) AS area FROM outer_ed GROUP BY page""")
def page_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.regions(spark, sf_dir)
    points = df.select("page", F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("minx", "miny"), ("maxx", "maxy"))])).alias("p")).select("page", "p.*")
    return S.hulls(points, ["page"]).select("page", F.size("hull").alias("n_corners"), F.round(G.area(F.col("hull")), 3).alias("area"))


@query("split_lines", f"WITH {V.REGIONS} SELECT page, ord, round((maxx - minx)::DOUBLE * ((maxy - miny) * 2 // 3), 3) AS ascender, round((maxx - minx)::DOUBLE * (maxy - miny - (maxy - miny) * 2 // 3), 3) AS descender FROM regions")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    base = "miny + int((maxy - miny) * 2 / 3)"
    df = V.regions(spark, sf_dir).select("page", "ord", F.array(at("minx", "miny"), at("maxx", "miny"), at("maxx", "maxy"), at("minx", "maxy")).alias("points"), F.array(at("minx + 5", base), at("maxx - 5", base)).alias("baseline"))
    return S.split_lines(df, ["page", "ord"]).select("page", "ord", *[F.round(G.area(F.col(c)), 3).alias(c) for c in ("ascender", "descender")])


_SLOT = f"""{V.REGIONS}, sl AS (SELECT page, ord, label, (2 + partkey % 10)::INT AS x, 2 + 16 * ord AS y, (4 + suppkey % 20)::INT AS w, 3 + label AS h FROM regions)"""


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small shapes that do not touch: each region in a slot of its own."""
    return V.regions(spark, sf_dir).select("page", "ord", "label", F.expr("int(2 + partkey % 10)").alias("x"), (2 + 16 * F.col("ord")).alias("y"), F.expr("int(4 + suppkey % 20)").alias("w"), (3 + F.col("label")).alias("h"))


def _boxes(slots: DataFrame, inset: int = 0, *more: str) -> DataFrame:
    """Regions in their slots, with all sides moved in, and more columns as they are."""
    x, y, w, h = (F.col(c) for c in "xywh")
    at = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    x0, y0, x1, y1 = x + inset, y + inset, x + w - inset, y + h - inset
    return slots.select("page", "ord", "label", F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1)).alias("points"), *more)


def _over(below: DataFrame, above: DataFrame, *more: str) -> DataFrame:
    """page, z, label, points: shapes to be drawn, and shapes that erase what lies under them."""
    z = lambda k: F.struct(F.lit(k).alias("k"), "ord").alias("z")
    return below.select("page", z(0), "label", "points", *more).unionByName(above.select("page", z(1), F.lit(0).alias("label"), "points", *more))


@query("mask_polygons", f"""WITH {_SLOT} SELECT page, label, (row_number() OVER (PARTITION BY page, label ORDER BY ord DESC) - 1)::INT AS part, 2 * (w + h + 2)::INT AS n_points, x - 0.5::DOUBLE AS minx, y - 0.5::DOUBLE AS miny, x + w + 0.5::DOUBLE AS maxx, y + h + 0.5::DOUBLE AS maxy FROM sl WHERE w + h + 2 > 14""")
def mask_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = R.drawn(_boxes(_slots(spark, sf_dir)), ["page"], "ord")
    return S.mask_polygons(drawn, None, 14).select("page", "label", "part", F.size("points").alias("n_points"), "minx", "miny", "maxx", "maxy")


@query("uncertain_polygons", f"""WITH {_SLOT} SELECT page, 1 AS label, 4 AS n_points, x::DOUBLE AS minx, y::DOUBLE AS miny, (x + w)::DOUBLE AS maxx, (y + h)::DOUBLE AS maxy FROM sl
UNION ALL SELECT page, 2, 4 + 2 * (w > 4)::INT + 2 * (h > 4)::INT, x + 1, y + 1, x + w - 1, y + h - 1 FROM sl""")
def uncertain_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = _slots(spark, sf_dir)
    marks = _over(_boxes(slots).withColumn("label", F.lit(1)), _boxes(slots, 2))
    return S.uncertain_polygons(R.drawn(marks, ["page"], "z")).select("page", "label", F.size("points").alias("n_points"), "minx", "miny", "maxx", "maxy")


@query("baselines", """WITH RECURSIVE px AS (SELECT l_suppkey AS page, l_linenumber AS region, (l_partkey % 3)::INT AS component, (l_orderkey % 500)::INT AS x, l_quantity::INT AS y, l_extendedprice / 1000 AS up, l_discount * 100 - 2 AS down FROM lineitem),
h AS (SELECT page, region, component, 4 * median(greatest(up, 0)) AS up, 4 * median(greatest(down, 0)) AS down FROM px GROUP BY 1, 2, 3 HAVING count(*) > 5),
t AS (SELECT page, region, component, x, min(y) AS y FROM px GROUP BY 1, 2, 3, 4), o AS (SELECT *, row_number() OVER (PARTITION BY page, region, component ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY page, region, component) AS m FROM t),
k AS (SELECT *, greatest(least(m // 10, 10), 2) AS k FROM o), s AS (SELECT *, unnest(range(0, k)) AS j FROM k),
z AS (SELECT page, region, component, 4 * (x + CASE WHEN j = 0 THEN -2 WHEN j = k - 1 THEN 2 ELSE 0 END) AS x, 4 * y AS y, j FROM s WHERE i = CASE WHEN j = k - 1 THEN m - 1 ELSE floor(j * ((m - 1)::DOUBLE / (k - 1))) END),
l AS (SELECT page, region, component, count(*)::INT AS n_points, min(x)::DOUBLE AS minx, max(x)::DOUBLE AS maxx, sum(y)::DOUBLE AS sum_y FROM z GROUP BY 1, 2, 3)
SELECT page, region, component, n_points, minx, maxx, sum_y, round(up, 4) AS up, round(down, 4) AS down, (row_number() OVER (PARTITION BY page, region ORDER BY minx, component) - 1)::INT AS position FROM l JOIN h USING (page, region, component)""")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_linenumber").alias("region"), F.expr("int(l_partkey % 3)").alias("component"), F.expr("int(l_orderkey % 500)").alias("x"), F.expr("int(l_quantity)").alias("y"), (F.col("l_extendedprice") / 1000).alias("up"), (F.col("l_discount") * 100 - 2).alias("down"))
    out = S.baselines(df, ["page", "region", "component"], 4.0)
    xs = F.transform("points", lambda p: p["x"])
    ys = F.aggregate(F.transform("points", lambda p: p["y"].cast("double")), F.lit(0.0), lambda a, y: a + y)
    return out.select("page", "region", "component", F.size("points").alias("n_points"), F.array_min(xs).alias("minx"), F.array_max(xs).alias("maxx"), ys.alias("sum_y"), F.round("up", 4).alias("up"), F.round("down", 4).alias("down"), "position")


_SAID = "'line ' || partkey || ' of ' || suppkey"


@query("ocr_matched_lines", f"""{_matched(["page"], 0)} mt AS (SELECT page, unnest(ps) AS p, unnest(gs) AS g FROM hit), said AS (SELECT page, ord, {_SAID} AS t, CASE WHEN ord % 2 = 0 THEN replace({_SAID}, '1', 'l') ELSE {_SAID} END AS r FROM regions),
tl AS (SELECT coalesce(b.t, '') AS g, a.r AS o FROM (SELECT s.* FROM said s SEMI JOIN predicted p ON s.page = p.page AND s.ord = p.ord) a LEFT JOIN mt ON a.page = mt.page AND a.ord = mt.p LEFT JOIN said b ON b.page = mt.page AND b.ord = mt.g
 UNION ALL SELECT t, '' FROM said b WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.page = b.page AND mt.g = b.ord)),
e AS (SELECT CASE WHEN greatest(length(g), length(o)) > 0 THEN levenshtein(g, o) END AS d, CASE WHEN greatest(length(g), length(o)) > 0 THEN greatest(length(g), length(o)) END AS n FROM tl) SELECT {_RATES}""")
def ocr_matched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = V.regions(spark, sf_dir).withColumn("text", F.format_string("line %d of %d", "partkey", "suppkey"))
    text = F.when(F.col("ord") % 2 == 0, F.replace("text", F.lit("1"), F.lit("l"))).otherwise(F.col("text"))
    read = V.predicted(truth.withColumn("text", text), "text")
    return _rounded(M.error_rates(A.matched_texts(read, truth, ["page"]), []))


@query("shape_mismatch", f"""WITH {V.REGIONS}, {V.PREDICTED}, a AS (SELECT page, max(maxx) AS width, max(maxy) AS height FROM regions GROUP BY page), b AS (SELECT page, max(maxx) AS target_width, max(maxy) AS target_height FROM predicted GROUP BY page)
SELECT page, width, height, target_width, target_height FROM a JOIN b USING (page) WHERE width <> target_width OR height <> target_height""")
def shape_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda df: df.groupBy("page").agg(F.max("maxx").alias("width"), F.max("maxy").alias("height"))
    pred, truth = _sides(spark, sf_dir)
    return D.mismatched(size(truth), size(pred), "page")


@query("vocabulary_extend", "SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '') AS letters FROM (SELECT page_id, list_concat(['a', 'b', 'c', '.'], string_split(url, '')) AS l FROM pages)")
def vocabulary_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(*[F.lit(x) for x in "abc."])
    return V.read(spark, sf_dir, "pages").select("page_id", F.array_join(T.extended(known, T.characters(F.col("url"))), "").alias("letters"))
