"""Files made from frames: shapefiles, dBASE tables, workbooks, label archives. Each file is one group of rows, made in an Arrow function: (path, content)."""

from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
from pyspark.sql import DataFrame

FILE = "path string, content binary"


def _each(rows: DataFrame, encode, columns: list[str]) -> DataFrame:
    """encode(list of row tuples of a path) -> bytes, one file a path."""

    def run(frame):
        import pyarrow as pa

        path = frame.column("path")[0].as_py()
        content = encode(list(zip(*(frame.column(c).to_pylist() for c in columns))))
        return pa.Table.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary())], ["path", "content"])

    return rows.select("path", *columns).groupBy("path").applyInArrow(run, FILE)


def shape_bytes(points: list[tuple], kind: int) -> bytes:
    """A shapefile of (record, part, seq, x, y): records and parts are numbered from 0 without a gap."""
    return shape_content(*(np.array(v, t) for v, t in zip(zip(*points), (np.int64, np.int64, np.int64, np.float64, np.float64))), kind)


def shape_content(record: np.ndarray, part: np.ndarray, seq: np.ndarray, x: np.ndarray, y: np.ndarray, kind: int) -> bytes:
    """shape_bytes of columns. All fields are words of four bytes, put into place for all records at once."""
    order = np.lexsort((y, x, seq, part, record))
    record, part, x, y = record[order], part[order], x[order].astype("<f8"), y[order].astype("<f8")
    other = record[1:] != record[:-1]
    at = np.flatnonzero(np.append(True, other))  # the first point of each record
    part_at = np.flatnonzero(np.append(True, other | (part[1:] != part[:-1])))
    points = np.diff(np.append(at, len(x)))
    first_part = np.searchsorted(part_at, at)
    parts = np.diff(np.append(first_part, len(part_at)))
    sizes = 13 + parts + 4 * points
    starts = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), "<i4")
    big = lambda v: v.astype(">i4").view("<i4")
    words[starts], words[starts + 1], words[starts + 2] = big(np.arange(1, len(at) + 1)), big(2 * (sizes - 2)), kind
    box = np.stack([f.reduceat(v, at) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))], 1)
    words[starts[:, None] + np.arange(3, 11)] = np.ascontiguousarray(box).view("<i4").reshape(len(at), 8)
    words[starts + 11], words[starts + 12] = parts, points
    of_part = np.repeat(np.arange(len(at)), parts)
    words[starts[of_part] + 13 + np.arange(len(part_at)) - first_part[of_part]] = part_at - at[of_part]
    place = np.repeat(starts + 13 + parts - 4 * at, points) + 4 * np.arange(len(x))
    for k, v in ((0, x), (2, y)):
        halves = v.view("<i4").reshape(-1, 2)
        words[place + k], words[place + k + 1] = halves[:, 0], halves[:, 1]
    whole = (x.min(), y.min(), x.max(), y.max())
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + 2 * len(words)) + struct.pack("<2i4d", 1000, kind, *whole) + b"\0" * 32 + words.tobytes()


def index_bytes(content: bytes) -> bytes:
    """The index of a shapefile's records: where each begins and its length, in words of two bytes."""
    from catchment.sources import shapefile

    at, parts = 50, []
    for body in shapefile.records(content):
        parts.append(struct.pack(">2i", at, len(body) // 2))
        at += 4 + len(body) // 2
    out = b"".join(parts)
    return content[:24] + struct.pack(">i", 50 + len(out) // 2) + content[28:100] + out


def indexes(files: DataFrame) -> DataFrame:
    """path, content of the .shx files of shapefiles (path, content)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            paths = [p[:-1] + "x" for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([index_bytes(c) for c in batch.column("content").to_pylist()], pa.binary())], ["path", "content"])

    return files.select("path", "content").mapInArrow(run, FILE)


def saved(files: DataFrame, folder: str) -> list[str]:
    """Writes files (path: a name without folders, content) below a folder that all executors share, and tells their names."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("path")], ["path"])

    return sorted(x.path for x in files.select("path", "content").mapInArrow(run, "path string").collect())


def shapefiles(points: DataFrame, kind: int = 3) -> DataFrame:
    """path, content of shapefiles from path, record, part, seq, x, y."""

    def run(frame):
        import pyarrow as pa

        path = frame.column("path")[0].as_py()
        content = shape_content(*(frame.column(c).to_numpy() for c in ("record", "part", "seq", "x", "y")), kind)
        return pa.Table.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary())], ["path", "content"])

    return points.select("path", "record", "part", "seq", "x", "y").groupBy("path").applyInArrow(run, FILE)


def table_bytes(rows: list[tuple], names: list[str]) -> bytes:
    """A dBASE table of text fields from (record, deleted, values)."""
    texts = [[("" if v is None else str(v)).encode() for v in values] for _, _, values in sorted(rows)]
    widths = [max([1, *(len(t[k]) for t in texts)]) for k in range(len(names))]
    if max(widths) > 254:
        raise ValueError("a text field holds 254 bytes at most")
    fields = b"".join(n.encode()[:10].ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in zip(names, widths))
    marks = [b"*" if deleted else b" " for _, deleted, _ in sorted(rows)]
    data = b"".join(m + b"".join(v.ljust(w) for v, w in zip(t, widths)) for m, t in zip(marks, texts))
    return struct.pack("<4BIHH", 3, 26, 1, 1, len(rows), 33 + len(fields), 1 + sum(widths)) + b"\0" * 20 + fields + b"\r" + data


def tables(rows: DataFrame, names: list[str]) -> DataFrame:
    """path, content of dBASE tables from path, record, deleted, values (array of texts, one for each name)."""
    return _each(rows, lambda r: table_bytes(r, names), ["record", "deleted", "values"])


def column_letters(c: int) -> str:
    out = ""
    c += 1
    while c:
        c, rest = divmod(c - 1, 26)
        out = chr(65 + rest) + out
    return out


def book_bytes(cells: list[tuple[int, int, int]]) -> bytes:
    """A workbook of one sheet from (r, c, d)."""
    rows: dict[int, list] = {}
    for r, c, d in sorted(cells):
        rows.setdefault(r, []).append(f'<c r="{column_letters(c)}{r + 1}"><v>{d}</v></c>')
    body = "".join(f'<row r="{r + 1}">{"".join(v)}</row>' for r, v in rows.items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(cells: DataFrame) -> DataFrame:
    """path, content of workbooks from path, r, c, d."""
    return _each(cells, book_bytes, ["r", "c", "d"])


def label_bytes(cells: list[tuple]) -> bytes:
    """An archive of a label matrix and its review mask from (r, c, d, reviewed)."""
    rows, cols = 1 + max(r for r, *_ in cells), 1 + max(c for _, c, *_ in cells)
    matrix, mask = np.zeros((rows, cols), np.uint8), np.zeros((rows, cols), np.uint8)
    for r, c, d, seen in cells:
        matrix[r, c], mask[r, c] = d, seen
    out = io.BytesIO()
    np.savez_compressed(out, matrix=matrix, review_mask=mask)
    return out.getvalue()


def label_archives(cells: DataFrame) -> DataFrame:
    """path, content of label archives from path, r, c, d, reviewed."""
    return _each(cells, label_bytes, ["r", "c", "d", "reviewed"])
