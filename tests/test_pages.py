"""Whole pages from file to file, samples, logs, and orders against plain loops."""

import random
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from folioflow.operators import matching, page_flow, splits, text_export
from folioflow.operators import reading_order as order
from folioflow.sources import files, pagexml


def page(regions, width=3000, height=2000):
    body = "".join(f'<{kind} id="{i}" custom="structure {{type:{cls};}}"><Coords points="{x0},{y0} {x1},{y0} {x1},{y1} {x0},{y1}"/>{inner}</{kind}>' for i, kind, cls, x0, y0, x1, y1, inner in regions)
    return f'<?xml version="1.0" encoding="UTF-8"?><PcGts><Page imageFilename="p.jpg" imageWidth="{width}" imageHeight="{height}">{body}</Page></PcGts>'


LINE = '<TextLine id="l1" custom="readingOrder {index:0;}"><Coords points="1,1 2,2 3,3"/><TextEquiv><Unicode>x &amp; y</Unicode></TextEquiv></TextLine>'
COLUMNS = [
    ("right", "TextRegion", "paragraph", 1600, 100, 2500, 800, ""),
    ("left2", "TextRegion", "paragraph", 0, 900, 900, 1500, ""),
    ("left1", "TextRegion", "paragraph", 0, 100, 900, 800, LINE),
    ("ad", "TextRegion", "advertisement", 0, 1600, 900, 1900, ""),
]


def test_a_folder_is_put_into_reading_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p1.xml").write_text(page(COLUMNS))
    (tmp_path / "in" / "p2.xml").write_text(page([]))
    page_flow.apply_reading_order(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    nested = pagexml.read_written(spark, str(tmp_path / "out"))
    regions = pagexml.region_table(nested)
    assert {r.region_id: r.reading_order for r in regions.collect()} == {"left1": 0, "left2": 1, "right": 2}
    assert [(r.region_id, r.text) for r in pagexml.line_table(regions).collect()] == [("left1", "x & y")]
    assert {r.page_id for r in pagexml.page_table(nested).collect()} == {"p1", "p2"}


def test_annotations_become_rasters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.xml").write_text(page([("a", "TextRegion", "paragraph", 1, 1, 6, 4, ""), ("b", "GraphicRegion", "image", 4, 2, 8, 8, "")], 10, 12))
    page_flow.convert_annotations(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    r = spark.read.parquet(str(tmp_path / "out")).first()
    img = np.frombuffer(r.raster, np.uint8).reshape(r.height, r.width)
    want = np.zeros((12, 10), np.uint8)
    want[2:9, 4:9] = 8  # images are drawn first
    want[1:5, 1:7] = 3
    assert (img == want).all()


def nested_dividers(n):
    """A page whose section splits n times."""
    rows = [(1, i, 4, 0, 30 * i, 1900, 30 * i + 10) for i in range(n)]
    return rows + [(1, n + i, 3, 0, 30 * i + 11, 900, 30 * i + 29) for i in range(n)] + [(1, 2 * n, 3, 3000, 0, 3900, 10)]


def test_thousands_of_dividers_need_no_recursion(spark):
    df = spark.createDataFrame(nested_dividers(1500), "page long, ord int, label int, minx int, miny int, maxx int, maxy int")
    got = order.reading_order(df).collect()
    assert sorted(r.position for r in got) == list(range(3001))


def loop_order(lines):
    """A border moves on in steps only when no line is left of it."""
    step = median(w for _, _, w, _, _ in lines) or 1.0
    border = min(x for _, x, *_ in lines) + step
    out, rest = [], list(lines)
    while rest:
        here = [r for r in rest if r[1] < border - step / 2 or r[3] < border]
        if not here:
            border += step
            continue
        out += sorted(here, key=lambda r: (r[4], r[0]))
        rest = [r for r in rest if r not in here]
    return {r[0]: i for i, r in enumerate(out)}


def test_line_order_equals_the_loop(spark):
    rng = random.Random(5)
    regions = {k: [(i, float(rng.randrange(0, 400, 5)), float(rng.choice([0, 40, 50, 60])), rng.randrange(0, 800) / 2, rng.randrange(0, 20) / 2) for i in range(rng.randint(1, 30))] for k in range(40)}
    df = spark.createDataFrame([(1, k, *r) for k, v in regions.items() for r in v], "page long, region int, ord int, minx double, width double, cx double, cy double")
    got = {}
    for r in order.line_order(df).collect():
        got.setdefault(r.region, {})[r.ord] = r.position
    assert got == {k: loop_order(v) for k, v in regions.items()}


def test_draws_with_replacement(spark):
    df = spark.createDataFrame([(f"f{i}",) for i in range(50)], "path string")
    taken, rest = splits.draw(df, "path", 200, 3)
    rows = taken.collect()
    drawn = {r.path for r in rows}
    assert sorted(r.draw for r in rows) == list(range(200)) and len(drawn) < 50 + 1 and len(rows) > len(drawn)
    assert {r.path for r in rest.collect()} == {f"f{i}" for i in range(50)} - drawn
    assert splits.fetch_commands(taken, "path").first().command.startswith("get f")
    assert splits.draw(df.where("false"), "path", 5)[0].count() == 0


def test_log_and_todo(spark, tmp_path):
    pages = spark.createDataFrame([("a",), ("b",)], "page_id string")
    splits.log_work(splits.log_rows(pages.withColumn("error", F.when(F.col("page_id") == "a", "bad")), "s"), str(tmp_path / "log"))
    splits.log_work(splits.log_rows(pages.where("page_id = 'a'").withColumn("error", F.lit(None).cast("string")), "s"), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 3 and [tuple(r) for r in splits.logged(log).collect()] == [("s", "done", 2)]


def test_csv_quotes_texts_only(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 'say "x"; y', None), (2, None, None, "z")], "n int, conf double, text string, more string")
    text_export.write_csv(df.coalesce(1), str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0] == '"n";"conf";"text";"more"' and set(lines[1:]) == {'1;0.5;"say ""x""; y";""', '2;"";"";"z"'}


def test_images_meet_their_lines(spark):
    images = spark.createDataFrame([("file:/d/p1.jpg", bytearray(b"1")), ("/d/q.png", bytearray(b"2"))], "path string, content binary")
    lines = spark.createDataFrame([("p1", "l1"), ("p1", "l2"), ("r", "l3")], "page_id string, line_id string")
    assert sorted((r.line_id, bytes(r.content)) for r in files.images_with_lines(images, lines).collect()) == [("l1", b"1"), ("l2", b"1")]


def test_middle_of_counted_values(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(8) / 8) for k in range(5) for _ in range(rng.randint(1, 40))] + [(9, float("nan")), (9, None), (9, 0.25)]
    got = {r.k: (r.v_lower, r.v_upper) for r in matching.middle(spark.createDataFrame(rows, "k int, v double"), ["k"], ["v"]).collect()}
    for k in {k for k, _ in rows}:
        v = sorted(x for i, x in rows if i == k and x is not None and x == x)
        assert got[k] == (v[(len(v) - 1) // 2], v[len(v) // 2])


def test_samples_are_extracted_stored_and_split(spark, tmp_path):
    import pyarrow as pa

    from folioflow.sources import samples

    class Lengths(samples.Samples):
        schema = "page_id string, n int, target int"

        def pages(self, spark):
            return spark.createDataFrame([("a", "x y"), ("b", "z")], "page_id string, text string")

        def extract(self, batch):
            rows = [(p, i, len(w)) for p, t in zip(batch.column("page_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for i, w in enumerate(t.split())]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2)]], names=["page_id", "n", "target"])

    Lengths().store(spark, str(tmp_path / "s"))
    got = samples.stored(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, got.collect())) == [("a", 0, 1), ("a", 1, 1), ("b", 0, 1)]
    splits_ = spark.createDataFrame([("Training", "a"), ("Test", "b")], "split string, page_id string")
    assert {r.split: r.n for r in samples.split_sizes(got, splits_).collect()} == {"Training": 2, "Test": 1}
    assert samples.joined_by_place(got, got.select("page_id", "n")).count() == 3


def test_characters_go_there_and_back(spark):
    from folioflow.functions import tokens as T

    t: T.Tokenizer = T.Characters(max_length=512)
    df = spark.createDataFrame([("d-p ſchön",), ("",)], "text string")
    assert [r[0] for r in df.select(t.decode(t.encode(F.col("text")))).collect()] == ["d-p ſchön", ""]
    assert len(t) == 4 + T.UNICODE + len(T.CUSTOM)


def test_scaled_region_tables_are_those_of_scaled_pages(spark):
    """Scaling a region table gives what scaling, writing and reading its pages gives, lines included; and each copy its own scale."""
    line = '<TextLine id="l" custom="readingOrder {index:0;}"><Coords points="3,5 9,9 -7,9"/><Baseline points="3,9 101,9"/></TextLine>'
    body = '<Page imageFilename="a.jpg" imageWidth="901" imageHeight="1203"><TextRegion id="r1" custom="readingOrder {index:0;} structure {type:heading;}"><Coords points="0,0 10,0  11,-5 7,21"/>' + line + '</TextRegion><TableRegion id="t" custom="structure {type:table;}"><Coords points=""/></TableRegion><ImageRegion id="i"/></Page>'
    nested = pagexml.parse_pages(spark.createDataFrame([("a", body), ("b", body)], "page_id string, xml string"))
    rows = lambda df: sorted(map(str, df.select("page_id", "region_id", "ord", "class", "points", "width", "height", F.transform("lines", lambda x: F.struct(x["Coords"]["_points"], x["Baseline"]["_points"])).alias("l")).collect()))
    whole = pagexml.region_table(page_flow.randomly_scaled(nested, 1.5, 3, 7), sizes=True)
    got = rows(page_flow.randomly_scaled_regions(pagexml.region_table(nested, sizes=True), 1.5, 3, 7))
    assert got == rows(whole) and len(got) == 2 * 4 * 3


def test_rewritten_pages_name_each_item_once(spark):
    """What a document says three times is worked out once: the items are a column of their own before they are joined."""
    body = '<Page imageFilename="a.jpg" imageWidth="9" imageHeight="8"><TextRegion id="r1" custom="readingOrder {index:1;} structure {type:heading;}"><Coords points="0,0 1,1"/></TextRegion><TextRegion id="r0" custom="readingOrder {index:0;}"><Coords points="2,2"/></TextRegion></Page>'
    nested = pagexml.parse_pages(spark.createDataFrame([("a", body)], "page_id string, xml string"))
    xml = page_flow.rewritten(nested)
    plan = xml._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<RegionRefIndexed") == 1
    out = xml.first().xml
    assert out.index('index="0" regionRef="r0"') < out.index('index="1" regionRef="r1"') < out.index('id="r0"') < out.index('id="r1"')
