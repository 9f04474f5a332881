"""Shapefiles as a data source: `spark.read.format("shapefile").load(path)`, one row a vertex, several tasks a file.

    shape_source.register(spark)
    spark.read.format("shapefile").option("columns", "record,part,seq,x,y").load("/shared/pipes.shp")

Where a file's index (.shx) lies beside it, the file is split into ranges of records with about `bytes` bytes each (an
option, 32 MB by default; more where all files would make over STRETCHES ranges); a task reads its part of the index and its
own stretch of the file. Without an index a file is one task. Comparisons with record, kind, path and the record's own box (rxmin, rymin, rxmax, rymax) are used where Spark
pushes filters to Python sources (`register` turns spark.sql.python.filterPushdown.enabled on for the session, which Spark demands of such sources): record narrows the ranges, the box is tested
on a record's header before its vertices are read. Spark tests all filters again.

`path` is a file, a folder (its .shp files), or several of them divided by commas; `kinds` names the shape types to read
(lines 3, 13 by default; `polygons` for 5, 15, 25). Other types, truncated records and files that aren't shapefiles are
errors; null shapes and records without parts have no rows. Z and M values are ignored. Paths are opened by Arrow on the
driver and in tasks: a shared file system, HDFS or an object store that Arrow knows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from catchment.sources.shapefile import LINES, POLYGONS, header

FIELDS = {"path": "string", "kind": "int", "record": "long", "rxmin": "double", "rymin": "double", "rxmax": "double", "rymax": "double", "part": "int", "seq": "int", "x": "double", "y": "double"}
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
BYTES = 32 << 20
#: Ranges of a scan, about: the start of a task takes longer than the reading of some kilobytes.
STRETCHES = 1_000
#: Vertices of a batch, about.
VERTICES = 200_000
COMPARED = (EqualTo, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The .shp files that a path stands for, in order of their names."""
    out = []
    for one in filter(None, (p.strip() for p in path.split(","))):
        system, at = opened(one)
        info = system.get_file_info(at)
        if info.type == fs.FileType.Directory:
            root = one.rstrip("/")
            out += sorted(f"{root}/{f.base_name}" for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.lower().endswith(".shp"))
        elif info.type == fs.FileType.NotFound:
            raise FileNotFoundError(one)
        else:
            out.append(one)
    return out


def index_path(path: str) -> str:
    return path[:-1] + ("X" if path.endswith("P") else "x")


@dataclass
class Stretch(InputPartition):
    """Records first to last - 1 of a file; last None: to its end, found record by record."""

    path: str
    first: int
    last: int | None


class ShapeReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.path, self.columns = options["path"], columns
        self.bytes = int(options.get("bytes", BYTES))
        self.kinds = POLYGONS if options.get("kinds", "lines") == "polygons" else LINES
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Takes comparisons of a record's columns with a literal; all go back to Spark, which tests them as well."""
        for f in filters:
            if isinstance(f, COMPARED) and len(f.attribute) == 1 and f.attribute[0] in list(FIELDS)[:7]:
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in list(FIELDS)[:7]:
                self.tests.append((f.attribute[0], "In", tuple(f.value)))
            yield f

    @staticmethod
    def holds(value, how: str, with_value) -> bool:
        return {"EqualTo": lambda: value == with_value, "LessThan": lambda: value < with_value, "LessThanOrEqual": lambda: value <= with_value, "GreaterThan": lambda: value > with_value, "GreaterThanOrEqual": lambda: value >= with_value, "In": lambda: value in with_value}[how]()

    def passes(self, **values) -> bool:
        return all(self.holds(values[c], how, v) for c, how, v in self.tests if c in values)

    def limits(self, count: int) -> tuple[int, int]:
        """The records that the tests of `record` leave, as a range."""
        low, high = 0, count
        for c, how, v in self.tests:
            if c != "record":
                continue
            if how in ("EqualTo", "In"):
                some = [v] if how == "EqualTo" else [x for x in v if x is not None]
                low, high = max(low, min(some, default=count)), min(high, max(some, default=-1) + 1)
            elif how.startswith("Greater"):
                low = max(low, int(np.floor(v)) + (how == "GreaterThan" and v == int(v)))
            else:
                high = min(high, int(np.floor(v)) + (how == "LessThanOrEqual" or v != int(v)))
        return low, high

    def partitions(self) -> list[Stretch]:
        out, indexed = [], []
        for path in listed(self.path):
            if not self.passes(path=path):
                continue
            system, at = opened(path)
            info = system.get_file_info(at)
            with system.open_input_file(at) as f:
                kind, _ = header(f.read_at(min(100, info.size), 0))
            if kind not in (0, *self.kinds):
                raise ValueError(f"{path}: shape type {kind}")
            index = system.get_file_info(opened(index_path(path))[1])
            if index.type == fs.FileType.NotFound:
                out.append(Stretch(path, 0, None))
                continue
            count = (index.size - 100) // 8
            indexed.append((path, info.size / max(1, count), *self.limits(count)))
        share = max(self.bytes, sum(size * max(0, high - low) for _, size, low, high in indexed) / STRETCHES)
        for path, size, low, high in indexed:
            each = max(1, int(share / max(1, size)))
            out += [Stretch(path, a, min(high, a + each)) for a in range(low, high, each)]
        return out or [Stretch("", 0, 0)]

    def bodies(self, part: Stretch) -> Iterator[tuple[int, bytes]]:
        """The number and body of each record of a stretch."""
        system, at = opened(part.path)
        size = system.get_file_info(at).size
        with system.open_input_file(at) as f:
            if part.last is None:
                place, number = 100, 0
                while place < size:
                    head = f.read_at(8, place)
                    length = 2 * struct.unpack(">i", head[4:])[0] if len(head) == 8 else -1
                    if length < 4 or place + 8 + length > size:
                        raise ValueError(f"{part.path}: truncated record {number}")
                    yield number, f.read_at(length, place + 8)
                    place, number = place + 8 + length, number + 1
                return
            with system.open_input_file(opened(index_path(part.path))[1]) as x:
                held = np.frombuffer(x.read_at(8 * (part.last - part.first), 100 + 8 * part.first), ">i4").reshape(-1, 2).astype(np.int64) * 2
            step = 256  # records that are read at once, from the first's start to the last's end
            for k in range(0, len(held), step):
                rows = held[k : k + step]
                low, high = int(rows[:, 0].min()), int((rows[:, 0] + 8 + rows[:, 1]).max())
                if high > size or rows[:, 1].min() < 4:
                    raise ValueError(f"{part.path}: truncated record")
                data = f.read_at(high - low, low) if high - low <= 4 * int(rows[:, 1].sum()) + 65536 else None
                for j, (start, length) in enumerate(rows.tolist()):
                    yield part.first + k + j, f.read_at(length, start + 8) if data is None else data[start - low + 8 : start - low + 8 + length]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        held: dict[str, list] = {c: [] for c in self.columns}
        size = 0
        for number, body in self.bodies(partition):
            kind = struct.unpack("<i", body[:4])[0]
            if kind == 0:
                continue
            if kind not in self.kinds:
                raise ValueError(f"{partition.path}: shape type {kind}")
            if len(body) < 44:
                raise ValueError(f"{partition.path}: truncated record {number}")
            box = struct.unpack("<4d", body[4:36])
            of_record = {"path": partition.path, "kind": kind, "record": number, **dict(zip(("rxmin", "rymin", "rxmax", "rymax"), box))}
            if not self.passes(**of_record):
                continue
            count, points = struct.unpack("<2i", body[36:44])
            if count < 0 or points < 0 or len(body) < 44 + 4 * count + 16 * points:
                raise ValueError(f"{partition.path}: truncated record {number}")
            firsts = np.frombuffer(body, "<i4", count, 44)
            xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * count)
            sizes = np.diff(np.append(firsts, points))
            total = int(sizes.sum())
            if not count or not total:
                continue
            of_vertex = {"part": lambda: np.repeat(np.arange(count, dtype=np.int32), sizes), "seq": lambda: np.arange(total, dtype=np.int32) - np.repeat(firsts - firsts[0], sizes).astype(np.int32), "x": lambda: xy[2 * firsts[0] :: 2], "y": lambda: xy[2 * firsts[0] + 1 :: 2]}
            for c in self.columns:
                held[c].append(pa.array(of_vertex[c](), ARROW[FIELDS[c]]) if c in of_vertex else pa.repeat(pa.scalar(of_record[c], ARROW[FIELDS[c]]), total))
            size += total
            if size >= VERTICES:
                yield self.batch(held)
                held, size = {c: [] for c in self.columns}, 0
        if size:
            yield self.batch(held)

    def batch(self, held: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(held[c]) for c in self.columns], self.columns)


class ShapeSource(DataSource):
    """Vertices of polylines or polygons."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def columns(self) -> list[str]:
        asked = [c.strip() for c in self.options.get("columns", ",".join(FIELDS)).split(",")]
        if unknown := [c for c in asked if c not in FIELDS]:
            raise ValueError(f"no such columns: {unknown}")
        return asked

    def schema(self) -> str:
        return ", ".join(f"{c} {FIELDS[c]}" for c in self.columns())

    def reader(self, schema) -> ShapeReader:
        return ShapeReader(dict(self.options), self.columns())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShapeSource)
