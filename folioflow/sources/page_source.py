"""Page files as a data source of Spark's own: `spark.read.format("pagefiles")` and `spark.readStream.format("pagefiles")`.

    spark.dataSource.register(page_source.PageFiles)
    spark.read.format("pagefiles").option("maxBytes", 64_000_000).load("pages/")

Each file is one row: page_id, path, bytes, status, error, image, width, height and regions. A file that is no XML, holds
no page or cannot be read is a row too, with its status and the reason, so one broken file neither fails a job nor is
lost. Files are dealt over partitions by their bytes, so many small ones share a task and a large one has its own; the
driver lists names and sizes only. Any folder that Arrow's file systems open will do, remote ones included.

As a stream, a file's place is its time of change and its path; the offset is the last place that was seen, so each file
is read once, also after a restart. Files have to be moved into the folder whole, and not with a time before the offset.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "page_id string, path string, bytes long, status string, error string, image string, width int, height int, regions array<struct<id:string,kind:string,custom:string,points:string>>"
MAX_BYTES = 64_000_000


@dataclass
class Files(InputPartition):
    """Paths and sizes that one task reads."""

    files: list[tuple[str, int]]


def _folder(path: str):  # noqa: ANN202
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[int, str, int]]:
    """(time of change in nanoseconds, path, bytes) of every .xml file below a folder, in that order."""
    from pyarrow import fs

    system, root = _folder(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((int(f.mtime_ns or 0), f.path, f.size or 0) for f in found if f.is_file and f.path.endswith(".xml"))


def dealt(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    """Files in order, in partitions of up to `most` bytes; each file counts 4,096 bytes more, for being opened."""
    out: list[Files] = []
    held = most + 1
    for _, path, size in files:
        if held + size + 4096 > most:
            out.append(Files([]))
            held = 0
        out[-1].files.append((path, size))
        held += size + 4096
    return out


def page_row(path: str, size: int, content: bytes | None, error: str | None = None) -> tuple:
    """The row of one file."""
    name = path.rsplit("/", 1)[-1].removesuffix(".xml")
    if content is None:
        return (name, path, size, "unreadable", error, None, None, None, None)
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        return (name, path, size, "corrupt", str(e), None, None, None, None)
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    page = next((e for e in root.iter() if tag(e) == "Page"), None)
    if page is None:
        return (name, path, size, "corrupt", "no page element", None, None, None, None)
    regions = []
    for e in page.iter():
        if tag(e).endswith("Region"):
            coords = next((c for c in e if tag(c) == "Coords"), None)
            regions.append((e.get("id"), tag(e), e.get("custom"), None if coords is None else coords.get("points")))
    number = lambda v: int(v) if v and v.strip().isdigit() else None
    return (name, path, size, "ok", None, page.get("imageFilename"), number(page.get("imageWidth")), number(page.get("imageHeight")), regions)


def _read(folder: str, part: Files) -> Iterator[tuple]:
    system, _ = _folder(folder)
    for path, size in part.files:
        try:
            with system.open_input_stream(path) as f:
                content = f.read()
        except OSError as e:
            yield page_row(path, size, None, str(e))
        else:
            yield page_row(path, size, content)


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagefiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageStream(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("maxBytes", MAX_BYTES))

    def partitions(self) -> list[Files]:
        return dealt(listed(self.path), self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _read(self.path, partition)


class PageStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("maxBytes", MAX_BYTES))

    def initialOffset(self) -> dict:
        return {"at": json.dumps([-1, ""])}

    def latestOffset(self) -> dict:
        found = listed(self.path)
        return {"at": json.dumps(list(found[-1][:2]))} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        a, b = (tuple(json.loads(x["at"])) for x in (start, end))
        return dealt([f for f in listed(self.path) if a < f[:2] <= b], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for an offset."""
