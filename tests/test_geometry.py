from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions import layout as L
from folioflow.functions import tokens as T


def one(spark, c, **cols):
    df = spark.range(1).select(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in cols.items()])
    return df.select(c.alias("x")).first().x


def pts(rows):
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in rows])


def test_points(spark):
    assert [tuple(p) for p in one(spark, G.parse_points(F.col("s")), s=" 3,4  -5,60 ")] == [(3, 4), (-5, 60)]
    assert one(spark, G.parse_points(F.col("s")), s="  ") == []
    assert one(spark, G.parse_points(F.col("s")), s=F.lit(None).cast("string")) is None
    assert one(spark, G.format_points(F.col("p"), 0.5), p=pts([(3, -3), (10, 1)])) == "1,-1 5,0"  # cut toward zero


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-9999, 9999), st.integers(-9999, 9999)), min_size=1, max_size=12))
def test_format_then_parse(spark, points):
    back = one(spark, G.parse_points(G.format_points(F.col("p"))), p=pts(points))
    assert [tuple(p) for p in back] == points


def test_boxes(spark):
    b = {c: F.col(c) for c in ("minx", "miny", "maxx", "maxy")}
    cols = dict(minx=0, miny=0, maxx=10, maxy=5)
    assert not one(spark, G.perimeter_over(b, 15), **cols) and one(spark, G.perimeter_over(b, 14), **cols)
    assert not one(spark, G.area_over(b, 50), **cols) and one(spark, G.area_over(b, 49), **cols)
    assert one(spark, G.center_x(b), **cols) == 5
    far = {c: F.lit(v) for c, v in (("minx", 5), ("miny", 0), ("maxx", 15), ("maxy", 5))}
    assert abs(one(spark, G.iou(b, far), **cols) - 25 / 75) < 1e-12
    assert one(spark, G.iou(b, {c: F.lit(20) for c in b}), **cols) == 0


def test_polygons(spark):
    tri = pts([(0, 0), (6, 0), (0, 6)])
    assert one(spark, G.area(F.col("p")), p=tri) == 18
    assert one(spark, F.array(*G.centroid(F.col("p"))), p=tri) == [2, 2]
    assert [tuple(p) for p in one(spark, G.clipped(F.col("p"), F.lit(4), F.lit(3)), p=pts([(-1, 9), (5, 2)]))] == [(0, 3), (4, 2)]
    got = one(spark, G.line_polygon(F.col("p"), F.lit(2.0), F.lit(0.0)), p=pts([(0, 10), (10, 10)]))
    assert [(round(p.x, 6), round(p.y, 6)) for p in got] == [(0, 8), (10, 8), (10, 11), (0, 11)]  # heights are 1 at least
    assert one(spark, G.line_polygon(F.col("p"), F.lit(2.0), F.lit(2.0)), p=pts([(0, 10)])) is None


def test_classes(spark):
    both = "readingOrder {index:12;} structure {type:heading;}"
    assert one(spark, L.region_class(F.lit(both), F.lit("TextRegion"))) == "heading"
    assert one(spark, L.region_class(F.lit("structure {type:heading;}"), F.lit("TextRegion"))) == "UnknownRegion"
    assert one(spark, L.region_class(F.lit(""), F.lit("GraphicRegion"))) == "image"
    assert one(spark, L.class_tag(F.lit("structure {type:heading;}"))) == "heading"
    assert one(spark, L.order_index(F.lit(both))) == 12 and one(spark, L.order_index(F.lit("none"))) == -1
    assert one(spark, L.label_of(F.lit("unskd"))) == 1 and one(spark, L.label_of(F.lit("TextLine"))) == 0
    assert one(spark, L.label_name(F.lit(3))) == "paragraph" and one(spark, L.label_name(F.lit(0))) == "UnknownRegion"


def test_decisions(spark):
    s = F.array(*[F.lit(x) for x in (0.1, 0.6, 0.6)])
    assert one(spark, L.decided(s, 0.6)) == 1  # the first highest; equality passes
    assert one(spark, L.decided(s, 0.61)) == 0
    assert one(spark, L.uncertain(s, F.lit(0), 0.2)) == 1 and one(spark, L.uncertain(s, F.lit(1), 0.6)) == 0
    assert abs(sum(one(spark, L.softmax(s))) - 1) < 1e-12


def test_tokens(spark):
    letters = T.alphabet(128, ["ſ", "a", "é"])
    assert letters[:5] == ["<PAD>", "<START>", "<NAN>", "<END>", "\0"] and len(letters) == 134
    ids = one(spark, T.tokenise(F.lit("aſ😀"), 128, ["ſ", "é"]))
    assert ids == [1, ord("a") + 4, 132, 2, 3]
    assert one(spark, T.tokenise(F.lit("a"), 128, max_length=6, pad=True)) == [1, 101, 3, 0, 0, 0]
    assert one(spark, T.tokenise(F.lit("abc"), 128, max_length=3)) == [1, 101, 102]  # END is cut
    assert one(spark, T.detokenise(F.lit(ids), letters)) == "aſ"
    assert one(spark, T.detokenise(F.lit(ids), letters, True)) == "aſ<NAN>"
    assert one(spark, T.replaced(F.lit("abc"), {"a": "b", "b": "x"})) == "xxc"
    assert one(spark, T.stem(F.lit("/x/page_01.xml"))) == "page_01"
    assert one(spark, T.with_slash(F.lit("a"))) == "a/" and one(spark, T.without_slash(F.lit("a//"))) == "a/"
