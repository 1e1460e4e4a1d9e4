"""Queries of geometry, classes and region windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import layout as L
from ..operators import reading_order as order
from ..operators import regions as R
from ..schema import LABEL_NAMES, LABEL_RANK, LABELS, VALID_TAGS
from . import views as V
from .registry import query



def box() -> dict:
    return {c: F.col(c) for c in ("minx", "miny", "maxx", "maxy")}


def with_(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "


@query("region_parse", with_(V.REGIONS, V.POINTS) + "SELECT page, ord, 4 AS n_points, minx, miny, maxx, maxy FROM regions")
def region_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.point_strings(V.regions(spark, sf_dir)).withColumn("p", G.parse_points(F.col("points")))
    return df.select("page", "ord", F.size("p").alias("n_points"), *[v.alias(k) for k, v in G.bbox(F.col("p")).items()])


@query("region_scale", with_(V.REGIONS) + "SELECT page, ord, concat_ws(' ', trunc(minx*0.37)::INT||','||trunc(miny*0.37)::INT, trunc(maxx*0.37)::INT||','||trunc(miny*0.37)::INT, trunc(maxx*0.37)::INT||','||trunc(maxy*0.37)::INT, trunc(minx*0.37)::INT||','||trunc(maxy*0.37)::INT) AS points FROM (SELECT page, ord, minx::DOUBLE AS minx, miny::DOUBLE AS miny, maxx::DOUBLE AS maxx, maxy::DOUBLE AS maxy FROM regions)".replace("*0.37", "*0.37::DOUBLE"))
def region_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.point_strings(V.regions(spark, sf_dir))
    return df.select("page", "ord", G.format_points(G.parse_points(F.col("points")), 0.37).alias("points"))


@query("region_pad", with_(V.REGIONS) + "SELECT page, ord, concat_ws(' ', (minx+10)||','||(miny+10), (maxx+10)||','||(miny+10), (maxx+10)||','||(maxy+10), (minx+10)||','||(maxy+10)) AS points FROM regions")
def region_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.point_strings(V.regions(spark, sf_dir))
    return df.select("page", "ord", G.format_points(G.moved(G.parse_points(F.col("points")), 10, 10)).alias("points"))


@query("region_clip", with_(V.REGIONS) + "SELECT page, ord, least(greatest(minx,0),3000) AS minx, least(greatest(miny,0),2000) AS miny, least(greatest(maxx,0),3000) AS maxx, least(greatest(maxy,0),2000) AS maxy FROM regions")
def region_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.point_strings(V.regions(spark, sf_dir)).withColumn("p", G.clipped(G.parse_points(F.col("points")), F.lit(3000), F.lit(2000)))
    return df.select("page", "ord", *[v.alias(k) for k, v in G.bbox(F.col("p")).items()])


@query("region_size_filter", with_(V.REGIONS) + "SELECT page, ord, minx + abs(maxx - minx) / 2.0::DOUBLE AS center_x, (maxx - minx)::DOUBLE * (maxy - miny) AS area FROM regions WHERE (maxx - minx) + (maxy - miny) > 1100 AND maxx - minx > 920 AND (maxx - minx)::BIGINT * (maxy - miny) > 150000 AND maxx > minx AND maxy > miny")
def region_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, b = V.regions(spark, sf_dir), box()
    keep = G.perimeter_over(b, 1100) & G.perimeter_over(b, 920, True) & G.area_over(b, 150000) & G.is_box(b)
    return df.where(keep).select("page", "ord", G.center_x(b).alias("center_x"), G.box_area(b).alias("area"))


@query("polygon_area", with_(V.REGIONS) + "SELECT page, ord, (maxx - minx)::DOUBLE * (maxy - miny) AS area, (minx + maxx) / 2.0::DOUBLE AS cx, (miny + maxy) / 2.0::DOUBLE AS cy FROM regions")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.point_strings(V.regions(spark, sf_dir)).withColumn("p", G.parse_points(F.col("points")))
    cx, cy = G.centroid(F.col("p"))
    return df.select("page", "ord", F.round(G.area(F.col("p")), 3).alias("area"), F.round(cx, 3).alias("cx"), F.round(cy, 3).alias("cy"))


@query("line_polygon", with_(V.REGIONS) + "SELECT page, ord, round(minx::DOUBLE, 3) AS x0, round(miny - 12.0::DOUBLE, 3) AS y0, round(maxx::DOUBLE, 3) AS x3, round(miny + 5.0::DOUBLE, 3) AS y2, 4 AS n FROM regions")
def line_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda x: F.struct(F.col(x).alias("x"), F.col("miny").alias("y"))
    df = V.regions(spark, sf_dir).withColumn("p", G.line_polygon(F.array(at("minx"), at("maxx")), F.lit(12.0), F.lit(5.0)))
    g = lambda i, c: F.round(F.get("p", F.lit(i))[c], 3)
    return df.select("page", "ord", g(0, "x").alias("x0"), g(0, "y").alias("y0"), g(2, "x").alias("x3"), g(2, "y").alias("y2"), F.size("p").alias("n"))


_BENT = """bent AS (SELECT page, ord, [minx, minx + 300, maxx]::DOUBLE[] AS x, [miny, miny + suppkey % 90, maxy]::DOUBLE[] AS y FROM regions WHERE maxx > minx),
pt AS (SELECT page, ord, unnest([1, 2, 3]) AS i, x, y FROM bent), an AS (SELECT *, atan2(y[least(i, 2) + 1] - y[least(i, 2)], x[least(i, 2) + 1] - x[least(i, 2)]) + pi() / 2 AS a FROM pt)"""


@query("line_polygon_bent", with_(V.REGIONS, _BENT) + "SELECT page, ord, i - 1 AS i, round(x[i] - cos(a) * 20, 3) + 0.0::DOUBLE AS up_x, round(y[i] - sin(a) * 20, 3) + 0.0::DOUBLE AS up_y, round(x[i] + cos(a), 3) + 0.0::DOUBLE AS down_x, round(y[i] + sin(a), 3) + 0.0::DOUBLE AS down_y FROM an")
def line_polygon_bent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines that change direction; the height below is less than one pixel."""
    df = V.regions(spark, sf_dir).where("maxx > minx").withColumns({"midx": F.col("minx") + 300, "midy": F.expr("int(miny + suppkey % 90)")})
    base = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("minx", "miny"), ("midx", "midy"), ("maxx", "maxy"))])
    df = df.withColumn("base", base).select("page", "ord", G.line_polygon(F.col("base"), F.lit(20.0), F.lit(0.25)).alias("p")).withColumn("i", F.explode(F.array(*map(F.lit, range(3)))))
    g = lambda j, c: F.round(F.get("p", j)[c], 3)
    i = F.col("i")
    return df.select("page", "ord", "i", g(i, "x").alias("up_x"), g(i, "y").alias("up_y"), g(5 - i, "x").alias("down_x"), g(5 - i, "y").alias("down_y"))


@query("region_class", with_(V.REGIONS, V.CUSTOMS) + r"""SELECT page, ord, CASE WHEN regexp_extract(custom, 'readingOrder \{index:(.+?);\} structure \{type:(.+?);\}', 2) <> '' THEN regexp_extract(custom, 'readingOrder \{index:(.+?);\} structure \{type:(.+?);\}', 2)
 WHEN kind IN ('ImageRegion', 'GraphicRegion') THEN 'image' ELSE 'UnknownRegion' END AS class, nullif(regexp_extract(custom, 'structure \{type:(.+?);\}', 1), '') AS tag,
 CASE WHEN regexp_extract(custom, '\{type:(.*);\}', 1) IN ('article', 'article_') THEN 'paragraph' ELSE nullif(regexp_extract(custom, '\{type:(.*);\}', 1), '') END AS eval_tag,
 CASE WHEN regexp_matches(custom, 'readingOrder\s*\{index:(\d+);\}') THEN regexp_extract(custom, 'readingOrder\s*\{index:(\d+);\}', 1)::INT ELSE -1 END AS idx FROM customs""")
def region_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.customs(V.regions(spark, sf_dir))
    c = F.col("custom")
    return df.select("page", "ord", L.region_class(c, F.col("kind")).alias("class"), L.class_tag(c).alias("tag"), L.eval_tag(c).alias("eval_tag"), L.order_index(c).alias("idx"))


_TAGS = ", ".join(f"'{t}'" for t in VALID_TAGS)


@query("unknown_tags", with_(V.REGIONS, V.CUSTOMS) + rf"""SELECT class, count(*) AS n, count(DISTINCT page) AS n_pages FROM (SELECT page, regexp_extract(custom, 'structure \{{type:(.+?);\}}', 1) AS class FROM customs) WHERE class <> '' AND class NOT IN ({_TAGS}) GROUP BY class""")
def unknown_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.customs(V.regions(spark, sf_dir)).select("page", L.class_tag(F.col("custom")).alias("class")).where("class is not null")
    valid = spark.createDataFrame([(t,) for t in VALID_TAGS], "class string")
    return df.join(F.broadcast(valid), "class", "left_anti").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page").alias("n_pages"))


_LABEL = "CASE class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABELS.items()) + " ELSE 1 END"
_RANK = "CASE label " + " ".join(f"WHEN {k} THEN {v}" for k, v in LABEL_RANK.items()) + " END"
_NAME = "['" + "', '".join(LABEL_NAMES) + "']"


@query("label_map", with_(V.REGIONS, V.CUSTOMS) + rf"""SELECT page, ord, label, (row_number() OVER (PARTITION BY page ORDER BY {_RANK}, ord) - 1)::INT AS id, {_NAME}[label] AS name
 FROM (SELECT page, ord, {_LABEL} AS label FROM (SELECT page, ord, regexp_extract(custom, 'structure \{{type:(.+?);\}}', 1) AS class FROM customs)) WHERE label > 0""")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.coalesce(L.class_tag(F.col("custom")), F.lit(""))
    df = V.customs(V.regions(spark, sf_dir)).select("page", "ord", L.label_of(tag).alias("label"))
    return R.numbered(df).select("page", "ord", "label", "id", L.label_name(F.col("label")).alias("name"))


@query("yolo_boxes", with_(V.REGIONS) + "SELECT page, ord, format('{:d} {:.6f} {:.6f} {:.6f} {:.6f}', label, (minx + maxx) / 2.0::DOUBLE / 5119, (miny + maxy) / 2.0::DOUBLE / 8191, (maxx - minx)::DOUBLE / 5119, (maxy - miny)::DOUBLE / 8191) AS line FROM regions")
def yolo_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.regions(spark, sf_dir)
    y = G.yolo_box(box(), F.lit(5119.0), F.lit(8191.0))
    return df.select("page", "ord", F.format_string("%d %.6f %.6f %.6f %.6f", "label", *y.values()).alias("line"))


_PROPS = f"""props AS (SELECT page, ord, label, minx, maxx, (minx + maxx) / 2.0::DOUBLE AS meanx, (miny + maxy) / 2.0::DOUBLE AS meany, (maxx - minx)::DOUBLE AS width, (maxy - miny)::DOUBLE AS height,
 (row_number() OVER (PARTITION BY page ORDER BY {_RANK}, ord) - 1)::INT AS id FROM regions),
meds AS (SELECT page, coalesce(quantile_cont(width, 0.5) FILTER (label IN (2, 3)), 1.0)::DOUBLE AS x_median, min(minx) AS page_minx, max(maxx) AS page_maxx FROM props GROUP BY page),
cols AS (SELECT p.*, x_median, page_minx, round_even((page_maxx - page_minx) / x_median, 0)::INT AS n_columns, round_even(width / x_median, 0)::INT AS cols FROM props p JOIN meds USING (page)),
divs AS (SELECT *, label = 7 AND cols >= n_columns AS is_global, label IN (4, 7) AND cols > 1 AND cols < n_columns AND NOT (label = 7 AND cols >= n_columns) AS is_local FROM cols)"""


@query("column_estimate", with_(V.REGIONS, _PROPS) + "SELECT page, ord, id, x_median, n_columns, cols, meanx, meany FROM cols")
def column_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.in_columns(R.properties(V.regions(spark, sf_dir))).select("page", "ord", "id", "x_median", "n_columns", "cols", "meanx", "meany")


@query("dividers", with_(V.REGIONS, _PROPS) + "SELECT page, ord, is_global, is_local FROM divs WHERE is_global OR is_local")
def dividers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_dividers(R.in_columns(R.properties(V.regions(spark, sf_dir)))).where("is_global or is_local").select("page", "ord", "is_global", "is_local")


@query("sections", with_(V.REGIONS, _PROPS) + "SELECT a.page, a.ord, count(b.ord)::INT AS section FROM divs a LEFT JOIN divs b ON a.page = b.page AND b.is_global AND b.meany < a.meany GROUP BY a.page, a.ord")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sectioned(R.with_dividers(R.in_columns(R.properties(V.regions(spark, sf_dir))))).select("page", "ord", "section")


_STATE = "'id': id, 'label': label, 'minx': minx, 'maxx': maxx, 'meanx': meanx, 'meany': meany, 'width': width, 'height': height, 'is_local': is_local"
_AT = ", ".join(f"'{c}': top.{c}" for c in ("id", "label", "minx", "maxx", "meanx", "meany", "width", "height")) + ", 'is_local': false"
#: Each section is a stack of groups: a group with a local divider is replaced by the groups before, of and after it; another one gives up its next column.
_WALK = f"""sec AS (SELECT a.page, a.ord, a.id, a.label, a.minx::DOUBLE AS minx, a.maxx::DOUBLE AS maxx, a.meanx, a.meany, a.width, a.height, a.is_global, a.is_local, CASE WHEN a.x_median > 0 THEN a.x_median ELSE 1.0::DOUBLE END AS step, a.page_minx::DOUBLE AS page_minx,
 (SELECT count(*) FROM divs b WHERE b.page = a.page AND b.is_global AND b.meany < a.meany)::INT AS section FROM divs a),
walk AS (SELECT page, section, any_value(step) AS step, any_value(page_minx) AS page_minx, [list({{{_STATE}}} ORDER BY id)] AS stack, NULL::DOUBLE AS border, []::INT[] AS found FROM sec WHERE NOT is_global GROUP BY page, section
 UNION ALL SELECT page, section, step, page_minx,
  CASE WHEN len(g) = 0 THEN stack[2:] WHEN top IS NOT NULL THEN list_concat([list_filter(rest, lambda x: list_contains(ahead, x.id)), [{{{_AT}}}], list_filter(rest, lambda x: NOT list_contains(ahead, x.id))], stack[2:])
   WHEN len(here) = 0 THEN stack ELSE list_concat([list_filter(g, lambda x: NOT list_contains(list_transform(here, lambda y: y.id), x.id))], stack[2:]) END,
  CASE WHEN len(g) = 0 OR top IS NOT NULL THEN NULL WHEN len(here) = 0 THEN b + step * greatest(1, floor((list_min(list_transform(g, lambda x: least(x.minx + step / 2, x.meanx))) - b) / step)) ELSE coalesce(list_avg(edges), b) + step END,
  CASE WHEN len(g) = 0 OR top IS NOT NULL OR len(here) = 0 THEN found ELSE list_concat(found, list_transform(list_sort(list_transform(here, lambda x: {{'part': CASE WHEN x.label = 6 AND x.width < x.height AND x.maxx < middle THEN 0 WHEN x.label = 6 AND x.width < x.height AND x.minx > middle THEN 2 ELSE 1 END,
   'v': CASE WHEN x.label = 6 AND x.width < x.height AND (x.maxx < middle OR x.minx > middle) THEN x.meanx ELSE x.meany END, 'id': x.id}})), lambda x: x.id)) END
 FROM (SELECT *, list_transform(list_filter(rest, lambda x: x.meanx < top.minx OR x.meanx > top.maxx OR (x.meany < top.meany) <> (len(list_filter(rest, lambda y: y.meanx < top.minx)) > 0 AND len(list_filter(rest, lambda y: y.meanx > top.maxx)) > 0)), lambda x: x.id) AS ahead,
   list_transform(list_filter(here, lambda x: x.label IN (2, 3, 4, 5)), lambda x: x.maxx) AS edges,
   coalesce(list_avg(list_transform(list_filter(here, lambda x: x.label <> 6), lambda x: x.meanx)), list_avg(list_transform(here, lambda x: x.meanx))) AS middle
  FROM (SELECT *, list_filter(g, lambda x: x.id <> top.id) AS rest, list_filter(g, lambda x: x.minx < b - step / 2 OR x.meanx < b) AS here
   FROM (SELECT *, list_sort(list_transform(list_filter(g, lambda x: x.is_local), lambda x: {{'m': x.meany, 'id': x.id, 'x': x}}))[1].x AS top
    FROM (SELECT *, stack[1] AS g, coalesce(border, page_minx + step) AS b FROM walk WHERE len(stack) > 0)))))"""


@query("reading_order", "WITH RECURSIVE " + ", ".join((V.REGIONS, _PROPS, _WALK)) + """, fin AS (SELECT page, section, unnest(found) AS id, generate_subscripts(found, 1) AS sub FROM walk WHERE len(stack) = 0),
whole AS (SELECT sec.page, sec.ord, sec.id, sec.section, fin.sub FROM sec JOIN fin ON sec.page = fin.page AND sec.id = fin.id UNION ALL SELECT page, ord, id, section, 1073741824 FROM sec WHERE is_global)
SELECT page, ord, id, (row_number() OVER (PARTITION BY page ORDER BY section, sub, id DESC) - 1)::INT AS position FROM whole""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.reading_order(V.regions(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = box()
    return V.regions(spark, sf_dir).select("page", (F.col("suppkey") % 2).cast("int").alias("region"), "ord", "minx", (b["maxx"] - b["minx"]).alias("width"), ((b["minx"] + b["maxx"]) / 2).alias("cx"), ((b["miny"] + b["maxy"]) / 2).alias("cy"))


@query("line_order", with_(V.REGIONS) + "SELECT page, region, ord, (row_number() OVER (PARTITION BY page, region ORDER BY trunc(cy)::INT, ord) - 1)::INT AS position FROM (SELECT page, (suppkey % 2)::INT AS region, ord, (miny + maxy) / 2.0::DOUBLE AS cy FROM regions)")
def line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.lines_by_height(_lines(spark, sf_dir))


@query("line_order_columns", with_(V.REGIONS) + """, l AS (SELECT page, (suppkey % 2)::INT AS region, ord, minx, (maxx - minx)::DOUBLE AS width, (minx + maxx) / 2.0::DOUBLE AS cx, (miny + maxy) / 2.0::DOUBLE AS cy FROM regions),
s AS (SELECT page, region, CASE WHEN median(width) = 0 THEN 1 ELSE median(width) END AS step, min(minx)::DOUBLE AS least FROM l GROUP BY page, region),
c AS (SELECT l.*, (SELECT min(k) FROM range(1, 60) t(k) WHERE minx < least + k * step - step / 2 OR cx < least + k * step) AS k FROM l JOIN s USING (page, region))
SELECT page, region, ord, (row_number() OVER (PARTITION BY page, region ORDER BY k, cy, ord) - 1)::INT AS position FROM c""")
def line_order_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.line_order(_lines(spark, sf_dir))


@query("line_order_vertical", with_(V.REGIONS) + "SELECT page, (suppkey % 2)::INT AS region, ord, (row_number() OVER (PARTITION BY page, suppkey % 2 ORDER BY miny, ord) - 1)::INT AS position FROM regions")
def line_order_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.lines_by_first_point(V.regions(spark, sf_dir).select("page", (F.col("suppkey") % 2).cast("int").alias("region"), "ord", F.col("miny").alias("y")))


@query("slice_rank", with_(V.REGIONS) + "SELECT page, ord, (row_number() OVER (PARTITION BY page ORDER BY ord) - 1)::INT AS rank FROM regions WHERE (maxx - minx)::BIGINT * (maxy - miny) > 200000")
def slice_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    df = V.regions(spark, sf_dir).where(G.area_over(box(), 200000))
    return df.select("page", "ord", (F.row_number().over(Window.partitionBy("page").orderBy("ord")) - 1).alias("rank"))


@query("draw_order", with_(V.REGIONS) + "SELECT page, ord, (row_number() OVER (PARTITION BY page ORDER BY CASE label WHEN 8 THEN 0 WHEN 9 THEN 1 ELSE label + 1 END, ord) - 1)::INT AS position FROM regions")
def draw_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("page").orderBy(L.draw_rank(F.col("label")), "ord")
    return V.regions(spark, sf_dir).select("page", "ord", (F.row_number().over(w) - 1).alias("position"))
