"""The page data source, batch and stream, and the timed run."""

import os

from folioflow.sources import page_source
from folioflow.streaming.ingest import ingest_for


def page(i, body=""):
    return f'<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"><Page imageFilename="p{i}.jpg" imageWidth="{100 + i}" imageHeight="50"><TextRegion id="r{i}" custom="structure {{type:paragraph;}}"><Coords points="1,2 3,4"/>{body}</TextRegion><SeparatorRegion id="s"/></Page></PcGts>'


def put(folder, name, text, at):
    folder.mkdir(exist_ok=True)
    f = folder / f"{name}.xml"
    f.write_text(text, encoding="utf-8")
    os.utime(f, ns=(at * 10**9, at * 10**9))


def test_every_file_is_a_row(spark, tmp_path):
    spark.dataSource.register(page_source.PageFiles)
    d = tmp_path / "pages"
    for i in range(7):
        put(d, f"p{i}", page(i), i)
    put(d, "broken", "<PcGts><Page", 8)
    put(d, "empty", "", 9)
    put(d, "other", "<html/>", 10)
    (d / "note.txt").write_text("not a page")
    df = spark.read.format("pagefiles").option("maxBytes", 10_000).load(str(d))
    got = {r.page_id: r for r in df.collect()}
    assert {k: r.status for k, r in got.items()} == {**{f"p{i}": "ok" for i in range(7)}, "broken": "corrupt", "empty": "corrupt", "other": "corrupt"}
    assert got["other"].error == "no page element" and got["broken"].error
    r = got["p3"]
    assert (r.width, r.height, r.image) == (103, 50, "p3.jpg")
    assert [tuple(x) for x in r.regions] == [("r3", "TextRegion", "structure {type:paragraph;}", "1,2 3,4"), ("s", "SeparatorRegion", None, None)]
    assert df.rdd.getNumPartitions() == 5  # two files to 10,000 bytes, with 4,096 for opening each
    assert spark.read.format("pagefiles").load(str(tmp_path / "none")).count() == 0


def test_partitions_are_dealt_by_bytes():
    parts = page_source.dealt([(0, f"f{i}", size) for i, size in enumerate([10, 20, 90_000, 5, 5, 5])], 50_000)
    assert [[p for p, _ in x.files] for x in parts] == [["f0", "f1"], ["f2"], ["f3", "f4", "f5"]]


def test_stream_reads_each_file_once(spark, tmp_path):
    spark.dataSource.register(page_source.PageFiles)
    d, out, at = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        q = spark.readStream.format("pagefiles").load(str(d)).select("page_id", "status").writeStream.format("parquet").option("path", out).option("checkpointLocation", at).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.page_id, r.status) for r in spark.read.parquet(out).collect())

    put(d, "a", page(1), 100)
    put(d, "b", "nothing", 101)
    assert run() == [("a", "ok"), ("b", "corrupt")]
    put(d, "c", page(2), 102)
    assert run() == [("a", "ok"), ("b", "corrupt"), ("c", "ok")]


def test_a_timed_run_stops_and_goes_on(spark, tmp_path):
    d, out, at = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for i in range(7):
        put(d, f"p{i}", page(i), 1000 + i)
    now = iter(range(0, 10_000, 10))  # a clock that moves on by ten seconds whenever it is asked
    first = ingest_for(spark, str(d), out, at, 45, 2, clock=lambda: next(now))
    assert not first.finished and len(first.seconds) == 2
    ids = lambda: sorted(r.page_id for r in spark.read.parquet(f"{out}/pages").collect())
    assert len(ids()) == 4
    second = ingest_for(spark, str(d), out, at, 1e9, 2)
    assert second.finished and ids() == [f"p{i}" for i in range(7)]
    assert spark.read.parquet(f"{out}/work_log").count() == 7
    assert ingest_for(spark, str(d), out, at, 1e9, 2).seconds == []
