"""Text formats: direction matrices, engine results, curve tables. Input is a frame (path, text) of whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, text of whole files; a byte-order mark is dropped."""
    rows = spark.read.format("text").option("wholetext", True).load(list(paths))
    return rows.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 0), line."""
    return files.select("path", F.posexplode(F.split("text", r"\r?\n", -1)).alias("line_no", "line"))


def numbers(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def parse_matrix(files: DataFrame) -> DataFrame:
    """grid_id, rows, cols, outlet_r, outlet_c, cells [r, c, d] of text matrices.

    First line: rows and columns; second: the outlet, counted from 1; then the rows. Blank lines are dropped.
    A wrong count, or a code outside 0..4, is an error that names the file.
    """
    body = F.filter(F.split("text", r"\r?\n", -1), lambda s: F.trim(s) != "")
    rows = files.select("path", F.transform(body, lambda s: F.transform(numbers(s), lambda v: v.try_cast("int"))).alias("b"))
    size, outlet, grid = F.get("b", F.lit(0)), F.get("b", F.lit(1)), F.slice("b", F.lit(3), F.greatest(F.lit(0), F.size("b") - 2))
    out = rows.select("path", F.get(size, F.lit(0)).alias("rows"), F.get(size, F.lit(1)).alias("cols"), (F.get(outlet, F.lit(0)) - 1).alias("outlet_r"), (F.get(outlet, F.lit(1)) - 1).alias("outlet_c"), grid.alias("grid"))
    good = (F.size("grid") == F.col("rows")) & F.forall("grid", lambda g: (F.size(g) == F.col("cols")) & F.forall(g, lambda v: v.isNotNull() & v.between(0, 4)))
    good = good & F.col("outlet_r").between(0, F.col("rows") - 1) & F.col("outlet_c").between(0, F.col("cols") - 1)
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("grid")).otherwise(F.raise_error(F.concat(F.lit("not a direction matrix: "), F.col("path"))).cast("array<array<int>>"))
    cells = F.flatten(F.transform(checked, lambda g, r: F.transform(g, lambda v, c: F.struct(r.alias("r"), c.alias("c"), v.alias("d")))))
    return out.select(F.col("path").alias("grid_id"), "rows", "cols", "outlet_r", "outlet_c", F.filter(cells, lambda x: x["d"] > 0).alias("cells"))


def format_matrix(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """grid_id, text in the same layout; grids: grid_id, rows, cols, outlet_r, outlet_c."""
    rows = grids.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    codes = cells.groupBy("grid_id", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "d"))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0)).cast("string")), " ")
    text = rows.join(codes, ["grid_id", "r"], "left").select("grid_id", "rows", "cols", "outlet_r", "outlet_c", "r", line.alias("line"))
    head = F.concat_ws("\n", F.concat_ws(" ", "rows", "cols"), F.concat_ws(" ", F.col("outlet_r") + 1, F.col("outlet_c") + 1))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n")
    return text.groupBy("grid_id", "rows", "cols", "outlet_r", "outlet_c").agg(body.alias("body")).select("grid_id", F.concat_ws("\n", head, "body").alias("text"))


def parse_result(files: DataFrame, title: str = "Final Direction Matrix D") -> DataFrame:
    """path, r, c, d of the matrix that follows the line with the title, up to the first line that isn't whole numbers."""
    rows = lines(files)
    start = rows.where(F.contains("line", F.lit(title))).groupBy("path").agg(F.min("line_no").alias("start"))
    body = rows.join(start, "path").where("line_no > start")
    stop = body.where(~F.col("line").rlike(r"^\s*[-+]?\d+(\s+[-+]?\d+)*\s*$")).groupBy("path").agg(F.min("line_no").alias("stop"))
    kept = body.join(stop, "path", "left").where("stop IS NULL OR line_no < stop")
    return kept.select("path", (F.col("line_no") - F.col("start") - 1).alias("r"), F.posexplode(numbers(F.col("line"))).alias("c", "v")).select("path", "r", "c", F.col("v").cast("int").alias("d"))


def parse_nse(files: DataFrame) -> DataFrame:
    """path, line_no, k, beta, ok_total, mean_nse, nse_mean: rows of five or seven fields that start with a whole number."""
    f = F.col("f")
    rows = lines(files).where(~F.trim("line").rlike(r"^(\[|[kK]|$)")).select("path", "line_no", numbers(F.col("line")).alias("f"))
    value = F.when(F.size(f) >= 7, F.get(f, F.lit(6))).otherwise(F.get(f, F.lit(4)))
    out = rows.where((F.size(f) >= 5) & f[0].rlike(r"^[-+]?\d+$")).select("path", "line_no", f[0].cast("int").alias("k"), f[1].try_cast("double").alias("beta"), f[2].alias("ok_total"), f[3].try_cast("double").alias("mean_nse"), value.try_cast("double").alias("nse_mean"))
    return out.where("beta IS NOT NULL AND mean_nse IS NOT NULL AND nse_mean IS NOT NULL")


def best_beta(points: DataFrame) -> DataFrame:
    """path, k, beta with the largest mean (first k wins ties)."""
    return points.groupBy("path").agg(F.max_by(F.struct("k", "beta", "mean_nse"), F.struct("mean_nse", -F.col("k"))).alias("b")).select("path", "b.*")


def saved_paths(files: DataFrame, prefixes=("Done", "NSE saved", "Saved")) -> DataFrame:
    """path, name, value of `prefix: value` lines; the last line of a name wins."""
    pattern = "^\\s*(" + "|".join(prefixes) + ")\\s*:\\s*(.*\\S)\\s*$"
    rows = lines(files).select("path", "line_no", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("value"))
    return rows.where("name <> ''").groupBy("path", "name").agg(F.max_by("value", "line_no").alias("value"))


def header_k(label: Column) -> Column:
    compact = F.regexp_replace(label, " ", "")
    return F.coalesce(F.regexp_extract(compact, r"10\^([-+]?\d+)", 1).try_cast("int"), F.regexp_extract(compact, r"(?i)(?:^|[_-])k=?([-+]?\d+)(?:$|[_-])", 1).try_cast("int"))


def width_blocks(files: DataFrame, runs: int = 100, first_k: int = -4) -> DataFrame:
    """path, block, k, i, xi, original, mean, low, high, runs of wide curve tables (distance, original, runs ...).

    Adjacent columns whose headers name one k are a block; columns without k go by `runs` from first_k on.
    Fields that aren't numbers are 0; a distance column of zeros counts rows instead.
    """
    rows = lines(files).where("trim(line) <> ''").select("path", "line_no", F.split("line", ",").alias("f"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1
    rows = rows.select("path", place.alias("i"), "f")
    head = rows.where((F.col("i") == 0) & F.exists("f", lambda v: v.rlike("[A-Za-z^]"))).select("path", F.col("f").alias("labels"))
    data = rows.join(head, "path", "left").where("labels IS NULL OR i > 0").withColumn("i", F.col("i") - F.when(F.col("labels").isNotNull(), 1).otherwise(0))
    number = lambda v: F.coalesce(F.nanvl(v.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    zero = Window.partitionBy("path")
    xi = F.when(F.max(F.abs(number(F.col("f")[0]))).over(zero) <= 1e-8, F.col("i").cast("double")).otherwise(number(F.col("f")[0]))
    cells = data.select("path", "i", xi.alias("xi"), number(F.col("f")[1]).alias("original"), F.posexplode(F.slice("f", F.lit(3), F.size("f"))).alias("col", "v"))
    columns = cells.select("path", "col").distinct().join(head, "path", "left").select("path", "col", header_k(F.get("labels", F.col("col") + 2)).alias("named"))
    w = Window.partitionBy("path").orderBy("col")
    new = ~F.col("named").eqNullSafe(F.lag("named").over(w)) | (F.lag("col").over(w).isNull())
    marked = columns.withColumn("island", F.sum(new.cast("int")).over(w))
    inside = F.row_number().over(Window.partitionBy("path", "island").orderBy("col")) - 1
    marked = marked.withColumn("sub", F.when(F.col("named").isNull(), F.floor(inside / runs)).otherwise(0))
    block = F.dense_rank().over(Window.partitionBy("path").orderBy("island", "sub")) - 1
    blocks = marked.select("path", "col", block.alias("block"), "named").select("path", "col", "block", F.coalesce("named", F.col("block") + first_k).alias("k"))
    out = cells.join(blocks, ["path", "col"]).withColumn("v", number(F.col("v")))
    return out.groupBy("path", "block", "k", "i", "xi", "original").agg(F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("runs"))


def select_workbooks(files: DataFrame, low: int, high: int) -> DataFrame:
    """name, number of workbooks to run: .xlsx, no lock files, a leading number within the range; ordered by number, then name."""
    number = F.regexp_extract("name", r"^(\d+)", 1).try_cast("int")
    good = F.lower("name").endswith(".xlsx") & ~F.col("name").startswith("~$") & number.between(low, high)
    return files.where(good).select("name", number.alias("number")).orderBy("number", F.lower("name"))


def gamma_report(m: DataFrame) -> DataFrame:
    """grid_id, text: the summary lines of gamma_index."""
    return m.select("grid_id", F.format_string("cells=%d\nchains=%d\nlongest=%d\ncentre=%.10f\ngamma=%.10f", "cells", "chains", "longest", "centre", "gamma").alias("text"))


def parse_summary(files: DataFrame) -> DataFrame:
    """path, line_no, k, beta, ok_total, mean_run, low, high, mean_q (texts) of an engine's table by beta.

    The table follows the first line that holds its title, or both column names; a line that names a saved file ends it. Rows have five
    fields, or seven with the least and the largest value; lines that don't begin with a whole number are headers.
    """
    rows = lines(files).select("path", "line_no", F.trim("line").alias("line"))
    title = F.contains("line", F.lit("[Summary by beta]")) | (F.contains("line", F.lit("beta")) & F.contains("line", F.lit("meanNSE(run)")))
    start = rows.where(title).groupBy("path").agg(F.min("line_no").alias("start"))
    body = rows.join(start, "path").where("line_no > start")
    ends = F.col("line").startswith("NSE saved:") | F.col("line").startswith("Saved:") | F.contains("line", F.lit("width_functions.csv"))
    stop = body.where(ends).groupBy("path").agg(F.min("line_no").alias("stop"))
    f = F.col("f")
    kept = body.join(stop, "path", "left").where("stop IS NULL OR line_no < stop").select("path", "line_no", numbers(F.col("line")).alias("f"))
    kept = kept.where((F.size(f) >= 5) & f[0].rlike(r"^[-+]?\d+$"))
    wide = F.size(f) >= 7
    return kept.select("path", "line_no", f[0].alias("k"), f[1].alias("beta"), f[2].alias("ok_total"), f[3].alias("mean_run"), F.when(wide, F.get(f, F.lit(4))).alias("low"), F.when(wide, F.get(f, F.lit(5))).alias("high"), F.when(wide, F.get(f, F.lit(6))).otherwise(F.get(f, F.lit(4))).alias("mean_q"))


def best_run(summary: DataFrame) -> DataFrame:
    """path, beta, mean_run of the row with the largest mean; the first of equals; rows without a number don't count."""
    number = F.col("mean_run").try_cast("double")
    rows = summary.where(number.isNotNull() & ~F.isnan(number))
    return rows.groupBy("path").agg(F.max_by(F.struct("beta", "mean_run"), F.struct(number, -F.col("line_no"))).alias("b")).select("path", "b.*")


def progress_note(line: Column) -> Column:
    """What a line of a running engine tells: exponent, beta, run, the end of a batch; else its first 120 characters (null for a blank line)."""
    text = F.trim(line)
    found = lambda pattern, name: F.when(F.regexp_extract(text, pattern, 1) != "", F.concat(F.lit(name), F.regexp_extract(text, pattern, 1)))
    parts = F.array_compact(F.array(found(r"\bk\s*=?\s*([-+]?\d+)", "k="), found(r"beta\s*=?\s*([0-9.eE+-]+)", "beta="), found(r"(?i)\brun\s*=?\s*(\d+)", "run="), F.when(F.contains(text, F.lit("Batch completed")), "batch completed")))
    return F.when(text == "", F.lit(None).cast("string")).when(F.size(parts) > 0, F.array_join(parts, " / ")).otherwise(F.substring(text, 1, 120))


def length_lines(chains: DataFrame) -> DataFrame:
    """grid_id, place, line: the flow-line lengths of each grid as lines of a table, the longest first, with each one's share of all cells."""
    w = Window.partitionBy("grid_id")
    share = F.col("length") / F.sum("length").over(w)
    place = F.row_number().over(w.orderBy(F.desc("length"), "start"))
    return chains.select("grid_id", place.alias("place"), F.format_string("%d,%d,%.10f", place, F.col("length"), share).alias("line"))
