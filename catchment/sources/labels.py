"""Review labels, settings, companion files and sets of layers."""

from __future__ import annotations

import io
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.sources import shapefile

LABELS = "path string, r int, c int, d int, reviewed boolean, error string"


def read_npz(files: DataFrame, matrix: str = "matrix", mask: str = "review_mask") -> DataFrame:
    """LABELS of .npz files (path, content). Pickled content is refused; without a mask nothing counts as reviewed."""

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as held:
                        d = np.asarray(held[matrix])
                        seen = np.asarray(held[mask]).astype(bool) if mask in held.files else np.zeros(d.shape, bool)
                    if d.ndim != 2 or seen.shape != d.shape or not ((d >= 0) & (d <= 4)).all():
                        raise ValueError("not a label matrix")
                    rows += [(path, r, c, int(d[r, c]), bool(seen[r, c]), None) for r, c in np.ndindex(*d.shape)]
                except Exception as e:  # one bad file must not end the batch: its error is its row
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in LABELS.split(", ")])

    return files.mapInArrow(parse, LABELS)


def settings(text: str) -> dict:
    """A JSON object; anything else is no settings."""
    try:
        found = json.loads(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def companion(files: DataFrame) -> DataFrame:
    """path, nse of each curve table (a file name that ends in _width_functions.csv): the file of the same stem, else the folder's only *_NSE.txt."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    tables = files.where(F.col("path").endswith("_width_functions.csv")).select("path", folder.alias("folder"), F.regexp_replace("path", "_width_functions\\.csv$", "_NSE.txt").alias("wanted"))
    texts = files.where(F.col("path").endswith("_NSE.txt")).select(F.col("path").alias("nse"), folder.alias("folder"))
    only = texts.groupBy("folder").agg(F.count("*").alias("n"), F.min("nse").alias("sole")).where("n = 1")
    out = tables.join(texts.select(F.col("nse").alias("wanted"), F.lit(True).alias("there")), "wanted", "left").join(only, "folder", "left")
    return out.select("path", F.when(F.col("there"), F.col("wanted")).otherwise(F.col("sole")).alias("nse"))


def load_layers(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points of all readable shapefiles (columns of shapefile.POINTS; kind tells lines from polygons), and path, error of the others.

    One scan reads the headers of all files, and one the geometry of the good ones; nothing goes file by file. A path that doesn't exist
    is an error of Spark's.
    """
    files = shapefile.read_binary(spark, *paths)
    supported = (*shapefile.LINES, *shapefile.POLYGONS)
    heads = shapefile.inspect(files).select("path", F.coalesce("error", F.when(~F.col("kind").isin(*supported), F.concat(F.lit("shape type isn't supported: "), "kind_name"))).alias("error"))
    good = files.join(heads.where("error IS NULL").select("path"), "path", "left_semi")
    return shapefile.read_points(good.select("path", "content"), supported), heads.where("error IS NOT NULL")


def write_audit(records: list[DataFrame], path: str) -> None:
    """Records with different columns as one CSV with the union of their headers."""
    out = records[0]
    for more in records[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    out.write.option("header", True).csv(path)
