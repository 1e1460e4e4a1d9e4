import json

from folioflow.sources import files, pagexml
from folioflow.streaming import ingest

PAGE = """<?xml version="1.0" encoding="UTF-8"?>
<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"><Page imageFilename="a.jpg" imageWidth="900" imageHeight="1200">
<TextRegion id="r1" custom="readingOrder {index:1;} structure {type:paragraph;}"><Coords points="0,0 10,0 10,-5 0,20"/>
<TextLine id="l1" custom="readingOrder {index:0;}"><Coords points="0,0 9,0 9,9"/><Baseline points="0,5 9,5"/><TextEquiv conf="0.5"><Unicode>Hallo &amp; ſo</Unicode></TextEquiv></TextLine>
<TextLine id="l2" custom="readingOrder {index:1;}"><Coords points="0,9 9,9"/></TextLine></TextRegion>
<TextRegion id="r2" custom="structure {type:heading;}"><Coords points="0,0 1,1"/></TextRegion>
<SeparatorRegion id="s1" custom="readingOrder {index:0;} structure {type:separator_vertical;}"><Coords points="5,5 6,6 7,7"/></SeparatorRegion>
<GraphicRegion id="g1" custom=""><Coords points="1,1 2,2 3,3"/></GraphicRegion>
</Page></PcGts>"""


def read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(PAGE)
    return pagexml.read_pages(spark, str(tmp_path / "in"))


def test_page_scan(spark, tmp_path):
    nested = read(spark, tmp_path)
    assert tuple(pagexml.page_table(nested).first()) == ("a", "a.jpg", 900, 1200)
    regions = pagexml.region_table(nested)
    got = [(r.region_id, r.ord, r["class"], r.tag, r.reading_order, len(r.points)) for r in regions.orderBy("ord").collect()]
    assert got == [("r1", 0, "paragraph", "paragraph", 1, 4), ("r2", 1, "UnknownRegion", "heading", -1, 2), ("s1", 2, "separator_vertical", "separator_vertical", 0, 3), ("g1", 3, "image", None, -1, 3)]
    lines = pagexml.line_table(regions).orderBy("ord").collect()
    assert [(x.line_id, x.text, x.conf, x.baseline and len(x.baseline)) for x in lines] == [("l1", "Hallo & ſo", 0.5, 2), ("l2", None, None, None)]
    assert pagexml.polygons(regions).count() == 3
    assert pagexml.text_polygons(pagexml.line_table(regions), True).count() == 1


def test_written_pages_read_back(spark, tmp_path):
    nested = read(spark, tmp_path)
    regions = pagexml.region_table(nested)
    lines = pagexml.line_table(regions)
    xml = pagexml.page_xml(pagexml.page_table(nested), regions.withColumnRenamed("ord", "position"), lines.withColumnRenamed("ord", "position"))
    body = xml.first().xml
    assert body.index("ReadingOrder") < body.index("TextRegion") and "&amp;" in body
    pagexml.write_pages(xml, str(tmp_path / "out"))
    again = pagexml.region_table(pagexml.read_written(spark, str(tmp_path / "out")))
    assert {r.region_id: r.points for r in again.collect()} == {r.region_id: r.points for r in regions.collect()}
    assert {r.line_id: r.text for r in pagexml.line_table(again).collect()} == {r.line_id: r.text for r in lines.collect()}


def test_second_dialect(spark, tmp_path):
    (tmp_path / "h.xml").write_text('<PcGts><Page imageFilename="h.tif" imageWidth="5" imageHeight="6"><TextRegion id="t" type="paragraph"><Coords><Point x="1" y="2"/><Point x="3" y="4"/></Coords></TextRegion><TextRegion id="u" type="odd"><Coords><Point x="1" y="2"/></Coords></TextRegion><SeparatorRegion id="s"><Coords><Point x="0" y="0"/></Coords></SeparatorRegion></Page></PcGts>')
    got = [(r.region_id, r["class"], [tuple(p) for p in r.points]) for r in pagexml.read_hlna(spark, str(tmp_path / "h.xml")).orderBy("ord").collect()]
    assert got == [("t", "article", [(1, 2), (3, 4)]), ("u", "UnknownRegion", [(1, 2)]), ("s", "separator_vertical", [(0, 0)])]


def test_files(spark, tmp_path):
    (tmp_path / "p1.jpg").write_bytes(b"x")
    (tmp_path / "p2.png").write_bytes(b"x")
    assert [r.stem for r in files.stems(spark, str(tmp_path), ".jpg").collect()] == ["p1"]
    (tmp_path / "split.json").write_text(json.dumps({"Training": ["b", "a"], "Test": []}))
    split = files.read_split(spark, str(tmp_path / "split.json"))
    assert sorted(map(tuple, split.collect())) == [("Training", "a"), ("Training", "b")]
    assert json.loads(files.split_json(split).first().json) == {"Training": ["a", "b"]}
    (tmp_path / "boxes.json").write_text(json.dumps({"bboxes": [{"id": "1", "class": "headline", "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}}, {"id": "2", "class": "odd", "bbox": {"x0": 0, "y0": 0, "x1": 0, "y1": 0}}]}))
    assert [tuple(r) for r in files.read_boxes(spark, str(tmp_path / "boxes.json")).collect()] == [("boxes", "heading", 1, 2, 3, 4)]
    (tmp_path / "list.txt").write_text("a.jpg\nb.xml\nc.jpeg\nd.jpgx\n")
    assert [r.path for r in files.image_list(spark, str(tmp_path / "list.txt")).collect()] == ["a.jpg", "c.jpeg"]
    assert files.suffixes("transkribus")[0] == ".jpg" and files.suffixes("x")[0] == ".png"
    (tmp_path / "s" / "run=r1" / "tag=loss").mkdir(parents=True)
    (tmp_path / "s" / "run=r1" / "tag=loss" / "x.csv").write_text("Wall,Step,Value\n1.0,5,0.25\n")
    assert tuple(files.read_series(spark, str(tmp_path / "s")).first()) == (1.0, 5, 0.25, "r1", "loss")


def test_ingestion_is_incremental(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.xml").write_text(PAGE)
    (tmp_path / "src" / "bad.xml").write_text("<PcGts></PcGts>")
    ingest.ingest(spark, src, out, chk)
    ingest.ingest(spark, src, out, chk)
    assert spark.read.parquet(f"{out}/regions").count() == 4
    (tmp_path / "src" / "b.xml").write_text(PAGE)
    ingest.ingest(spark, src, out, chk)
    assert spark.read.parquet(f"{out}/regions").count() == 8
    log = {(r.page_id, r.status) for r in spark.read.parquet(f"{out}/work_log").collect()}
    assert log == {("a", "done"), ("bad", "failed"), ("b", "done")}
