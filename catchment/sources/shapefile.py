"""ESRI shapefiles and dBASE tables as frames. Files are read whole by Spark (binaryFile), parsed in Arrow batches.

One file is one record of the scan, so many files spread over the cluster. Truncated records and other
shape types are errors. Null shapes have no points; Z and M values are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES, POLYGONS = (3, 13), (5, 15, 25)
POINTS = "path string, kind int, xmin double, ymin double, xmax double, ymax double, record int, part int, seq int, x double, y double"
FIELDS = "path string, record int, deleted boolean, attributes map<string, string>"
#: Points of a batch, about.
VERTICES = 200_000
CODECS = ("utf-8", "cp949", "euc-kr", "latin1")


def read_binary(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def header(content: bytes) -> tuple[int, tuple[float, float, float, float]]:
    if len(content) < 100 or struct.unpack(">i", content[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    return struct.unpack("<i", content[32:36])[0], struct.unpack("<4d", content[36:68])


def records(content: bytes):
    """Bodies of the records, in file order."""
    at = 100
    while at < len(content):
        if at + 8 > len(content):
            raise ValueError("truncated record header")
        size = 2 * struct.unpack(">i", content[at + 4 : at + 8])[0]
        if size < 4 or at + 8 + size > len(content):
            raise ValueError("truncated record")
        yield content[at + 8 : at + 8 + size]
        at += 8 + size


def vertices(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """part, seq, x, y of a record's points."""
    if struct.unpack("<i", body[:4])[0] == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(0)
    n, points = struct.unpack("<2i", body[36:44])
    first = np.frombuffer(body, "<i4", n, 44).astype(np.int64)
    xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * n).reshape(-1, 2)
    sizes = np.maximum(np.diff(np.append(first, points)), 0)
    seq = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(first, sizes) + seq
    return np.repeat(np.arange(n, dtype=np.int32), sizes), seq.astype(np.int32), xy[at, 0], xy[at, 1]


def read_points(files: DataFrame, kinds=LINES) -> DataFrame:
    """POINTS of shapefiles (path, content); a record without parts gives one row with null part."""

    def of_file(path: str, content: bytes):
        """Batches of about VERTICES rows."""
        import pyarrow as pa

        kind, box = header(content)
        if kind not in kinds:
            raise ValueError(f"{path}: shape type {kind} isn't supported")

        def batch(held):
            sizes = [len(v[0]) for _, v in held]
            bare = [not n for n in sizes]  # records without points
            number = np.repeat(np.array([i for i, _ in held], np.int32), np.maximum(sizes, 1))
            empty = np.repeat(bare, np.maximum(sizes, 1))
            own = []
            for k, t in enumerate((np.int32, np.int32, np.float64, np.float64)):
                own.append(pa.array(np.concatenate([np.zeros(1, t) if none else v[k] for (_, v), none in zip(held, bare)]), mask=empty))
            same = [pa.repeat(pa.scalar(v, t), len(number)) for v, t in ((path, pa.string()), (kind, pa.int32()), *[(b, pa.float64()) for b in box])]
            return pa.RecordBatch.from_arrays([*same, pa.array(number), *own], [c.split()[0] for c in POINTS.split(", ")])

        held, size = [], 0
        for i, body in enumerate(records(content)):
            held.append((i, vertices(body)))
            size += max(1, len(held[-1][1][0]))
            if size >= VERTICES:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                yield from of_file(path.as_py(), content.as_py())

    return files.mapInArrow(parse, POINTS)


def read_fields(files: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """FIELDS of dBASE files. With `wanted`, only those columns are decoded; none of them: only the delete marks."""

    def decode(raw: bytes) -> str:
        for codec in CODECS:
            try:
                return raw.decode(codec).strip().strip("\x00").strip()
            except UnicodeDecodeError:
                continue
        return ""

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                count, first, size = struct.unpack("<IHH", content[4:12])
                fields, at, shift = [], 32, 1
                while content[at] != 0x0D:
                    name = content[at : at + 11].split(b"\x00")[0].decode("ascii", "replace")
                    if wanted is None or name in wanted:
                        fields.append((name, shift, shift + content[at + 16]))
                    shift += content[at + 16]
                    at += 32
                for i in range(count):
                    row = content[first + i * size : first + (i + 1) * size]
                    if len(row) < size:
                        raise ValueError(f"{path}: truncated table")
                    rows.append((path, i, row[:1] == b"*", [(n, decode(row[a:b])) for n, a, b in fields]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.bool_(), pa.map_(pa.string(), pa.string())))], ["path", "record", "deleted", "attributes"])

    return files.mapInArrow(parse, FIELDS)


def number(text):
    """A numeric field: blank, stars and bad text are null."""
    return F.when(F.contains(text, F.lit("*")), None).otherwise(F.trim(text).try_cast("double"))


def layer(points: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """points with attributes; record i of the shapes is row i of the table; rows deleted there are dropped."""
    if fields is None:
        return points.where("part IS NOT NULL").withColumn("attributes", F.create_map().cast("map<string,string>"))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    rows = fields.select(stem.alias("_stem"), "record", "deleted", "attributes")
    joined = points.where("part IS NOT NULL").withColumn("_stem", F.regexp_replace("path", r"\.[^./]*$", "")).join(rows.hint("merge"), ["_stem", "record"], "left")
    return joined.where(~F.coalesce("deleted", F.lit(False))).drop("_stem", "deleted")


def segments(layer_points: DataFrame, start_field: str | None = None, end_field: str | None = None) -> DataFrame:
    """Segments of polylines, with heights from two attribute fields."""
    from pyspark.sql import Window

    w = Window.partitionBy("path", "record", "part").orderBy("seq")
    height = lambda f: number(F.try_element_at("attributes", F.lit(f))) if f else F.lit(None).cast("double")
    out = layer_points.select(F.col("path").alias("grid_id"), F.col("record").cast("long").alias("feature_id"), "part", F.col("seq").alias("seg"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), height(start_field).alias("start_h"), height(end_field).alias("end_h"))
    return out.where("x1 IS NOT NULL")


def ring_edges(layer_points: DataFrame) -> DataFrame:
    """Edges of polygons: feature_id, ring, edge, x0, y0, x1, y1 (an open ring is closed)."""
    from pyspark.sql import Window

    w = Window.partitionBy("path", "record", "part").orderBy("seq")
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = layer_points.select(F.col("record").alias("feature_id"), F.col("part").alias("ring"), F.col("seq").alias("edge"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.coalesce(F.lead("x").over(w), first("x")).alias("x1"), F.coalesce(F.lead("y").over(w), first("y")).alias("y1"))
    return out.where("x0 <> x1 OR y0 <> y1")


def boundary_values(fields: DataFrame, name: str) -> DataFrame:
    """Sorted distinct values of an attribute that aren't empty."""
    v = F.trim(F.try_element_at("attributes", F.lit(name)))
    return fields.where("NOT deleted").select(v.alias("value")).where("value <> ''").distinct().orderBy("value")


def feature_label(attributes, feature, preferred: str | None = None, known=("name", "NAME", "label", "LABEL", "id", "ID")):
    """First value that isn't empty: the preferred field, well-known ones, any, else feature_n."""
    names = ([preferred] if preferred else []) + list(known)
    tries = [F.nullif(F.trim(F.try_element_at(attributes, F.lit(n))), F.lit("")) for n in names]
    some = F.get(F.filter(F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.trim(e["value"])), lambda v: v != ""), F.lit(0))
    return F.coalesce(*tries, some, F.concat(F.lit("feature_"), feature.cast("string")))


KIND_NAMES = {0: "null", 1: "point", 3: "line", 5: "polygon", 8: "points", 13: "line with height", 15: "polygon with height", 25: "polygon with measure"}


def inspect(files: DataFrame) -> DataFrame:
    """path, kind, kind_name, xmin, ymin, xmax, ymax, error of shapefiles, from their first 100 bytes: a plan that reads content only up to there."""

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, head in zip(batch.column("path").to_pylist(), batch.column("head").to_pylist()):
                try:
                    kind, box = header(head)
                    rows.append((path, kind, KIND_NAMES.get(kind, f"kind {kind}"), *box, None))
                except ValueError as e:
                    rows.append((path, None, None, None, None, None, None, str(e)))
            if rows:
                kinds = [pa.string(), pa.int32(), pa.string(), *[pa.float64()] * 4, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "kind", "kind_name", "xmin", "ymin", "xmax", "ymax", "error"])

    heads = files.select("path", F.substring("content", 1, 100).alias("head"))
    return heads.mapInArrow(parse, "path string, kind int, kind_name string, xmin double, ymin double, xmax double, ymax double, error string")


def field_names(files: DataFrame) -> DataFrame:
    """path, place, name, width, records of dBASE tables, from their headers alone."""

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                count, first = struct.unpack("<IH", content[4:10])
                for k, at in enumerate(range(32, first - 1, 32)):
                    rows.append((path, k, content[at : at + 11].split(b"\x00")[0].decode("ascii", "replace"), content[at + 16], count))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64()))], ["path", "place", "name", "width", "records"])

    return files.mapInArrow(parse, "path string, place int, name string, width int, records long")


def selected_rings(layer_points: DataFrame, field: str, value: str) -> DataFrame:
    """Edges of the polygons whose attribute equals a value; none is an error."""
    some = layer_points.where(F.trim(F.try_element_at("attributes", F.lit(field))) == value)
    if not some.limit(1).count():
        raise ValueError(f"no polygon has {field} = {value}")
    return ring_edges(some)
