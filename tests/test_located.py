"""What lies by page is not dealt out again, and pages are parsed once: the exchanges and parsers in a query's plan."""

import os
import re

import pytest

from folioflow.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture
def plan(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda name: registry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def dealt(text):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)


@pytest.mark.parametrize("name", ["raster_histogram", "annotation_rasters", "scaled_labels", "masked_pages", "tile_labels", "line_crops", "line_components", "uncertain_polygons", "mask_polygons"])
def test_lines_of_pages_stay(plan, name):
    assert len(dealt(plan(name))) <= 6


@pytest.mark.parametrize("name", ["page_xml", "page_scan", "page_scale", "page_scale_random", "baselines_scaled", "line_scan", "baseline_scan", "layout_masks", "baseline_padded", "polygon_scan"])
def test_pages_are_written_and_read_once(plan, name):
    text = plan(name)
    found = dealt(text)
    assert len(found) <= 2 and all(re.match(r"page(_id)?#\d+L?, \d+$", x) for x in found)
    assert len(re.findall(r"from_xml\(", text)) <= 2 * 8  # printed once for each field of a page, for each reading
