"""Python data sources that plan their partitions: paged services, shapefiles in archives, workbooks by row window.

Each plans on the driver from an index or a count (a few numbers a partition) and reads one partition a task, so that a
lost executor costs the partitions that it held.
"""

from __future__ import annotations

import json
import os
import struct
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as E

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _fs(path: str):
    """(pyarrow file system, path) of a URI; a plain path is local."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class Window(InputPartition):
    """What one task reads: a file or a page with its bounds."""

    def __init__(self, *what):
        self.what = what


#: Rows of a page; tries of a page, with a pause that doubles in between.
PAGE, TRIES = 1000, 3


def paged(spark: SparkSession, name: str, fetch: Callable[[dict], dict], schema: str, *, total: Callable[[], int], cache: str | None = None, page: int = PAGE, tries: int = TRIES, pause: float = 0.5) -> DataFrame:
    """Rows of a paged service: pages of ``page`` rows by offset, each one partition.

    ``fetch({"offset", "limit", "fields"})`` gives {"records": [...]}; of the service only the fields of ``schema`` are
    asked for. A page that fails is tried again; after ``tries`` failures the task fails, and Spark tries it anew.
    ``cache`` is a folder that all executors share: a page that is there is not fetched, so a lost executor or a second
    run refetches only what is missing. A record may lack a field (null); a page may be short or empty.
    """
    fields = [f.name for f in spark.createDataFrame([], schema).schema]

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    class Reader(DataSourceReader):
        def partitions(self) -> list[Window]:
            return [Window(at) for at in range(0, max(total(), 1), page)]

        def read(self, part: Window) -> Iterator[tuple]:
            for r in self.records(part.what[0]):
                yield tuple(r.get(f) for f in fields)

        def records(self, offset: int) -> list[dict]:
            system, folder = _fs(cache) if cache else (None, None)
            path = f"{folder}/{name}-{offset}-{page}.json"
            if system and system.get_file_info(path).is_file:
                with system.open_input_stream(path) as f:
                    return json.loads(f.read())
            for k in range(tries):
                try:
                    found = fetch({"offset": offset, "limit": page, "fields": fields})["records"]
                    break
                except Exception:
                    if k + 1 == tries:
                        raise
                    time.sleep(pause * 2**k)
            if system:  # under another name first: a page is there whole or not at all
                system.create_dir(folder)
                with system.open_output_stream(f"{path}.{os.getpid()}") as f:
                    f.write(json.dumps(found).encode())
                system.move(f"{path}.{os.getpid()}", path)
            return found

    spark.dataSource.register(Pages)
    return spark.read.format(name).load()


#: Records of a partition of a shapefile.
RECORDS = 10_000
#: Record types of polygons, with and without further coordinates, and of points.
POLYGONS, POINTS = (5, 15, 25), (1, 11, 21)


def _skipped(stream, n: int) -> None:
    """Read ``n`` bytes away: a member of an archive is inflated up to where a partition begins."""
    while n > 0 and (got := len(stream.read(min(n, 1 << 20)))):
        n -= got


def _signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def _inside(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:])) % 2 == 1


def polygons_of(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Rings by the direction that they run in: clockwise ones are outlines, the others holes of the least outline around them; a hole without one is an outline."""
    outlines = sorted(([r] for r in rings if _signed_area(r) <= 0), key=lambda p: abs(_signed_area(p[0])))
    for r in rings:
        if _signed_area(r) > 0:
            owner = next((p for p in outlines if _inside(p[0], *r[0])), None)
            owner.append(r) if owner else outlines.append([r])
    return outlines


def read_shapefile(spark: SparkSession, path: str, columns: list[str], *, records: int = RECORDS) -> DataFrame:
    """(file, record, geom, columns...) of the shapefiles in ZIP archives: ``path`` is one archive or a folder of them.

    geom is an array of polygons, each an array of rings (outline, then holes), each an array of struct<x,y>; a point is
    a polygon of one ring of one point; null shapes are null. Partitions are ranges of the index file's records. Of the
    attributes only ``columns`` are decoded, as text; a column that the table lacks is null. Deleted rows keep their
    place, as records go by number.
    """
    geom = "array<array<array<struct<x:double,y:double>>>>"
    schema = f"file string, record long, geom {geom}" + "".join(f", `{c}` string" for c in columns)

    class Shapes(DataSource):
        @classmethod
        def name(cls) -> str:
            return "shapefile_zip"

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    class Reader(DataSourceReader):
        def partitions(self) -> list[Window]:
            from pyarrow import fs

            system, at = _fs(path)
            info = system.get_file_info(at)
            files = [at] if info.is_file else sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.lower().endswith(".zip"))
            out = []
            for file in files:
                with system.open_input_file(file) as f, zipfile.ZipFile(f) as z:
                    for part in sorted(z.namelist()):
                        if part.lower().endswith(".shx"):
                            n = (z.getinfo(part).file_size - 100) // 8
                            out += [Window(file, part[:-4], k, min(records, n - k)) for k in range(0, n, records)]
            return out or [Window(None, None, 0, 0)]

        def read(self, part: Window) -> Iterator[tuple]:
            file, stem, first, count = part.what
            if not count:
                return
            system, _ = _fs(path)
            with system.open_input_file(file) as f, zipfile.ZipFile(f) as z:
                member = {n.lower(): n for n in z.namelist()}
                with z.open(member[f"{stem}.shx".lower()]) as index:
                    _skipped(index, 100 + 8 * first)
                    places = list(struct.iter_unpack(">ii", index.read(8 * count)))
                rows = self.attributes(z, member.get(f"{stem}.dbf".lower()), first, count)
                with z.open(member[f"{stem}.shp".lower()]) as shapes:
                    at = 0
                    for k, ((offset, length), row) in enumerate(zip(places, rows)):
                        _skipped(shapes, 2 * offset + 8 - at)
                        content = shapes.read(2 * length)
                        at = 2 * offset + 8 + 2 * length
                        yield (file, first + k, self.shape(content), *row)

        def shape(self, content: bytes) -> list | None:
            kind = struct.unpack_from("<i", content)[0]
            if kind in POINTS:
                x, y = struct.unpack_from("<2d", content, 4)
                return [[[(x, y)]]]
            if kind not in POLYGONS:
                return None
            parts, points = struct.unpack_from("<2i", content, 36)
            begin = [*struct.unpack_from(f"<{parts}i", content, 44), points]
            flat = list(struct.iter_unpack("<2d", content[44 + 4 * parts : 44 + 4 * parts + 16 * points]))
            return polygons_of([flat[a:b] for a, b in zip(begin, begin[1:])])

        def attributes(self, z: zipfile.ZipFile, name: str | None, first: int, count: int) -> Iterator[tuple]:
            if name is None or not columns:
                yield from ((None,) * len(columns) for _ in range(count))
                return
            with z.open(name) as f:
                head = f.read(32)
                start, size = struct.unpack_from("<HH", head, 8)
                fields, at = {}, 1
                described = f.read(start - 32)
                for k in range(0, len(described) - 31, 32):
                    if described[k] == 0x0D:
                        break
                    width = described[k + 16]
                    fields[described[k : k + 11].split(b"\0")[0].decode("latin-1")] = (at, at + width)
                    at += width
                _skipped(f, size * first)
                for _ in range(count):
                    row = f.read(size)
                    yield tuple((row[slice(*fields[c])].decode("utf-8", "replace").strip() or None) if c in fields else None for c in columns)

    spark.dataSource.register(Shapes)
    return spark.read.format("shapefile_zip").load()


#: Half axis in metres and flattening of the ellipsoids of the two datums.
NAD83, WGS84 = (6378137.0, 1 / 298.257222101), (6378137.0, 1 / 298.257223563)


def shifted(lng: Column, lat: Column, source: tuple[float, float] = NAD83, target: tuple[float, float] = WGS84, *, move=(0.0, 0.0, 0.0), turn=(0.0, 0.0, 0.0), scale: float = 0.0) -> Column:
    """struct<x,y>: a place of one datum in another, by seven parameters over geocentric coordinates.

    ``move`` in metres, ``turn`` in arc seconds (position vector), ``scale`` in parts per million; with the defaults, the
    null shift between the two datums, only the ellipsoid changes. Latitude by a fixed number of steps, at height 0.
    """
    (a, f), (b, g) = source, target
    e, h = f * (2 - f), g * (2 - g)
    phi, lam = F.radians(lat), F.radians(lng)
    n = a / F.sqrt(1 - e * F.pow(F.sin(phi), 2))
    x, y, z = n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1 - e) * F.sin(phi)
    rx, ry, rz = (t * 3.141592653589793 / 648_000 for t in turn)
    m = 1 + scale * 1e-6
    u, v, w = (move[0] + m * (x - rz * y + ry * z), move[1] + m * (rz * x + y - rx * z), move[2] + m * (-ry * x + rx * y + z))
    p = F.sqrt(u * u + v * v)
    step = lambda t, _: F.atan2(w + h * b * F.sin(t) / F.sqrt(1 - h * F.pow(F.sin(t), 2)), p)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.atan2(w, p * (1 - h)), step)
    return F.struct(F.degrees(F.atan2(v, u)).alias("x"), F.degrees(found).alias("y"))


def reprojected(geom: Column, shift: Callable[[Column, Column], Column] = shifted) -> Column:
    """A geometry with each point shifted."""
    return F.transform(geom, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: shift(q["x"], q["y"]))))


#: Least rows of a sheet that one task hands on, and most windows of a sheet.
SHEET_ROWS, WINDOWS = 5000, 4


def read_sheets(spark: SparkSession, path: str, *, sheets: list[str] | None = None, rows: int = SHEET_ROWS) -> DataFrame:
    """(file, sheet, row, cells: column letters to text) of the sheets of .xlsx files, a window of ``rows`` rows or more a partition, WINDOWS of a sheet at most.

    The driver reads of each file the archive's directory, the names of the sheets and the extent that a sheet states at
    its head (without one a sheet is one partition). A task streams one sheet and hands on its window; the table of
    shared texts is read in each task.
    """
    tag = lambda e: e.tag.rpartition("}")[2]

    class Sheets(DataSource):
        @classmethod
        def name(cls) -> str:
            return "xlsx_rows"

        def schema(self) -> str:
            return "file string, sheet string, row int, cells map<string,string>"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    class Reader(DataSourceReader):
        def partitions(self) -> list[Window]:
            from pyarrow import fs

            system, at = _fs(path)
            info = system.get_file_info(at)
            files = [at] if info.is_file else sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.lower().endswith(".xlsx"))
            out = []
            for file in files:
                with system.open_input_file(file) as f, zipfile.ZipFile(f) as book:
                    links = {r.get("Id"): r.get("Target") for r in E.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
                    for sheet in (s for s in E.fromstring(book.read("xl/workbook.xml")).iter() if tag(s) == "sheet"):
                        if sheets and sheet.get("name") not in sheets:
                            continue
                        target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
                        target = target if target.startswith("xl/") else f"xl/{target}"
                        with book.open(target) as part:
                            head = part.read(4096).decode("utf-8", "replace")
                        last = head.partition("<dimension ref=\"")[2].partition('"')[0].rpartition(":")[2].lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
                        # a task streams what is before its window too: so few windows that a sheet is read a bounded number of times
                        cuts = [*range(1, int(last) + 1, max(rows, -(-int(last) // WINDOWS)))] if last.isdigit() else [1]
                        # the last window is open: an extent may be stated too small
                        out += [Window(file, target, sheet.get("name"), a, b) for a, b in zip(cuts, [*cuts[1:], 1 << 40])]
            return out or [Window(None, None, None, 0, 0)]

        def read(self, part: Window) -> Iterator[tuple]:
            file, target, name, low, high = part.what
            if file is None:
                return
            system, _ = _fs(path)
            with system.open_input_file(file) as f, zipfile.ZipFile(f) as book:
                words = []
                if "xl/sharedStrings.xml" in book.namelist():
                    with book.open("xl/sharedStrings.xml") as shared:
                        for _, item in E.iterparse(shared):
                            if tag(item) == "si":
                                words.append("".join(t.text or "" for t in item.iter() if tag(t) == "t"))
                                item.clear()
                with book.open(target) as sheet:
                    for _, row in E.iterparse(sheet):
                        if tag(row) != "row":
                            continue
                        number = int(row.get("r"))
                        if number >= high:
                            return
                        if number >= low:
                            made = {}
                            for c in row:
                                text = "".join(x.text or "" for x in c.iter() if tag(x) in ("v", "t"))
                                if text:
                                    made["".join(x for x in c.get("r", "") if x.isalpha())] = words[int(text)] if c.get("t") == "s" else text
                            yield file, name, number, made
                        row.clear()

    spark.dataSource.register(Sheets)
    return spark.read.format("xlsx_rows").load()


def grouped_rows(heads: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, head: struct, rows: array<struct> in order) of a sheet of one row a key and one of many; a key without rows has an empty array."""
    columns = [c for c in rows.columns if c not in (key, "file", "sheet")]
    many = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("rows"))
    head = heads.groupBy(key).agg(F.min(F.struct(*[c for c in heads.columns if c not in (key, "file", "sheet")])).alias("head"))
    empty = F.array().cast(many.schema["rows"].dataType)
    return head.join(many, key, "left").select(key, "head", F.coalesce("rows", empty).alias("rows"))
