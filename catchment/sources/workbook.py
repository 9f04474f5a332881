"""Direction grids in .xlsx workbooks: the first sheet's numeric cells, read from the zip's XML."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = "path string, r int, c int, d int, error string"
NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_number(letters: str) -> int:
    """A: 0, Z: 25, AA: 26."""
    n = 0
    for ch in letters.upper():
        n = 26 * n + ord(ch) - 64
    return n - 1


def sheet_cells(content: bytes) -> list[tuple[int, int, int]]:
    """(row, column, code) of the cells with a code 1..4; 0 and blanks are skipped, anything else is an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{NS}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{NS}si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        if not sheets:
            raise ValueError("no sheet")
        out = []
        for cell in ElementTree.fromstring(book.read(sheets[0])).iter(f"{NS}c"):
            letters, digits = re.fullmatch(r"([A-Za-z]+)(\d+)", cell.get("r")).groups()
            value = cell.find(f"{NS}v")
            text = "".join(t.text or "" for t in cell.iter(f"{NS}t")) if cell.get("t") == "inlineStr" else (value.text if value is not None else "")
            if cell.get("t") == "s" and text:
                text = shared[int(text)]
            if text.strip():
                code = int(float(text))
                if code:
                    if not 1 <= code <= 4:
                        raise ValueError(f"code {code} in {cell.get('r')}")
                    out.append((int(digits) - 1, column_number(letters), code))
    return out


def read_cells(files: DataFrame) -> DataFrame:
    """CELLS of workbooks (path, content); a workbook that can't be read gives one row with its error."""

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += [(path, *cell, None) for cell in sheet_cells(content)]
                except Exception as e:  # one bad file must not end the batch: its error is its row
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["path", "r", "c", "d", "error"])

    return files.mapInArrow(parse, CELLS)


def basins(cells: DataFrame) -> DataFrame:
    """One row a workbook: extents, cells, sinks, connected and disconnected cells, status.

    A basin needs exactly one sink: a cell whose flow leaves the active cells.
    """
    from catchment.operators import graph

    good = cells.where("error IS NULL").select(F.col("path").alias("grid_id"), "r", "c", "d")
    traced = graph.trace(good)
    sinks = traced.where("depth = 0").groupBy("grid_id").agg(F.count("*").alias("sinks"), F.min("sink").alias("sink"))
    reach = traced.join(sinks.select("grid_id", "sink"), ["grid_id", "sink"], "left_semi").groupBy("grid_id").agg(F.count("*").alias("connected"))
    size = good.groupBy("grid_id").agg((F.max("r") - F.min("r") + 1).alias("rows"), (F.max("c") - F.min("c") + 1).alias("cols"), F.count("*").alias("cells"))
    out = size.join(sinks, "grid_id", "left").join(reach, "grid_id", "left").fillna(0, ["sinks", "connected"])
    status = F.when(F.col("sinks") == 1, "ok").otherwise(F.format_string("error: %d sinks", "sinks"))
    summary = out.select(F.col("grid_id").alias("path"), "rows", "cols", "cells", "sinks", "connected", (F.col("cells") - F.col("connected")).alias("disconnected"), status.alias("status"))
    failed = cells.where("error IS NOT NULL").select("path", F.concat(F.lit("error: "), "error").alias("status"))
    return summary.unionByName(failed, allowMissingColumns=True)
