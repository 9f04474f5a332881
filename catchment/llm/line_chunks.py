"""Line dedup: chunks of lines that begin at content-defined boundaries and stand elsewhere are removed.

Only lines with text count; lines without any stay where they are, and so do the breaks between paragraphs. Lines are
hashed, and a window of `window` lines rolls over the hashes: the line with the smallest hash of a window is a boundary,
wherever the window stands. So an inserted line moves only the boundaries next to it, and no stretch of `window`
lines is without one. A boundary line that occurs again anywhere in the corpus is an anchor. From it chunks reach line
by line to both sides, 2 to `window` lines long; a chunk that occurs again is compared byte for byte and removed,
but for its first occurrence (smallest doc_id, then place). Chunks overlap, so what goes of a document is the union of
its repeated chunks: a repeated passage of `window` lines or more goes whole, whatever surrounds it. Lines of
`long_words` words or more are anchors and chunks by themselves; other single lines (headings) stay. The first
occurrence of a line in the corpus always stays, as a chunk that goes has an equal one before it.

Hashes of lines are written once. What crosses the network: the hashes of boundary lines (summed in the task), places of chunks at anchors, each
different line of a repeated chunk once a task for the comparison, and whole texts once, to meet their lists of
removed lines. The comparison is by lines: if all lines with one hash are the same bytes, equal hashes are equal
lines; hashes of which that isn't so are replaced by hashes of the lines' SHA-256, and all is done again. A bounded
Bloom filter picks the repeated hashes, up to FILTER_KEYS of them; beyond, places join them. Chunks with a thousandth of
all places or more are salted. Built-in expressions only.

Null and empty texts have no chunk and stay as they are; a document that loses all lines with text goes. Rows that
share doc_id and text are one document: they keep or lose a line together. A null doc_id comes first in order.
Other columns pass through, n_chars (if present) follows the new text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm import bloom_cascade, shared

FILTER_BITS = 1 << 23
FILTER_KEYS = 1_000_000
ROUNDS = 5


def line_hash(line: Column, shared_hashes: list[int]) -> Column:
    """A line's 64-bit hash; where lines are known to share one, that of its SHA-256."""
    own = F.xxhash64(line)
    return F.when(own.isin(shared_hashes), F.xxhash64(F.sha2(line.cast("binary"), 256))).otherwise(own) if shared_hashes else own


def with_text(line: Column) -> Column:
    """Whether a line has anything but white space."""
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""


def with_boundaries(docs: DataFrame, window: int, long_words: int, shared_hashes: list[int]) -> DataFrame:
    """doc_id, text_hash, marks (at, h, long: of the lines with text) and cuts, the numbers of the marks that are boundaries."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    # a line of so many words has so many bytes at least
    is_long = lambda x: F.when(F.octet_length(x) >= 2 * long_words - 1, F.regexp_count(x, F.lit(r"\S+")) >= long_words).otherwise(F.lit(False))
    marks = F.transform(lines, lambda x, i: F.when(with_text(x), F.struct(i.cast("int").alias("at"), line_hash(x, shared_hashes).alias("h"), is_long(x).alias("long"))))
    marks = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.filter(marks, lambda m: m.isNotNull()).alias("marks"))
    size = F.size("marks")

    def boundary(j: Column) -> Column:
        here = F.get(F.col("marks"), j)
        if window == 2:  # a window is a line and its neighbour
            least = (here["h"] <= F.get(F.col("marks"), j - 1)["h"]) | (here["h"] <= F.get(F.col("marks"), j + 1)["h"])
        else:
            starts = F.sequence(F.greatest(F.lit(0), j - (window - 1)), F.greatest(F.least(j, size - window), F.lit(0)))
            least = (size >= window) & F.exists(starts, lambda s: here["h"] <= F.array_min(F.transform(F.slice(F.col("marks"), s + 1, window), lambda m: m["h"])))
        return here["long"] | F.coalesce(least, F.lit(False))

    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return marks.withColumn("cuts", F.filter(places, boundary))


def with_chunks(rows: DataFrame, window: int) -> DataFrame:
    """Adds chunks [key, at (numbers of lines), hashes]: of each boundary in cuts those that reach from it to either side, and long lines."""
    size = F.size("marks")

    def chunk(first: Column, count: int) -> Column:
        own = F.slice(F.col("marks"), first + 1, count)
        hashes = F.transform(own, lambda m: m["h"])
        return F.struct(F.xxhash64(hashes).alias("key"), F.transform(own, lambda m: m["at"]).alias("at"), hashes.alias("hashes"))

    def reaching(more: int) -> list[Column]:
        after = F.transform(F.filter("cuts", lambda j: j + more < size), lambda j: chunk(j, more + 1))
        return [after, F.transform(F.filter("cuts", lambda j: j >= more), lambda j: chunk(j - more, more + 1))]

    found = [F.transform(F.filter("cuts", lambda j: F.get(F.col("marks"), j)["long"]), lambda j: chunk(j, 1))]
    for more in range(1, window):
        found += reaching(more)
    return rows.withColumn("chunks", F.array_distinct(F.concat(*found)))


def exploded(rows: DataFrame, array: Column, *columns: str) -> DataFrame:
    # explode_outer: for explode the optimiser infers a filter and copies the whole expression below every projection
    return rows.select(*columns, F.explode_outer(array).alias("one")).where("one IS NOT NULL")


def picked(rows: DataFrame, repeated: DataFrame, total: int, spread: Column) -> DataFrame:
    """rows whose key is in repeated(key, n), by a bounded Bloom filter (with some others) or a salted join."""
    if total <= FILTER_KEYS:
        return rows.where(bloom_cascade.Level(repeated.select("key"), max(1, total), 0.02, 77, FILTER_BITS).holds("key"))
    hot = shared.hot_keys(repeated, "key", "n")
    return shared.salted_join(rows, repeated.select("key"), "key", hot, spread, shared.width(rows.sparkSession))


def anchored(cut: DataFrame, work: str) -> DataFrame:
    """cut with only the boundaries whose line occurs again (and a few others)."""
    spark = cut.sparkSession
    hashes = exploded(cut, F.transform("cuts", lambda j: F.get(F.col("marks"), j)["h"])).withColumnRenamed("one", "key")
    repeated = shared.stash(hashes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{work}/anchors")
    total = repeated.count()
    if total <= FILTER_KEYS:
        known = bloom_cascade.Level(repeated.select("key"), max(1, total), 0.02, 77, FILTER_BITS)
        # no filter on cuts: the optimiser would copy it below the columns that it is made from, and make these anew for each line
        return cut.withColumn("cuts", F.filter("cuts", lambda j: known.holds(F.get(F.col("marks"), j)["h"])))
    places = exploded(cut, F.transform("cuts", lambda j: F.struct(j.alias("j"), F.get(F.col("marks"), j)["h"].alias("key"))), "doc_id", "text_hash").select("doc_id", "text_hash", "one.*")
    hot = shared.hot_keys(repeated, "key", "n")
    found = shared.salted_join(places, repeated.select("key"), "key", hot, F.xxhash64("doc_id", "text_hash", "j"), shared.width(spark))
    found = found.groupBy(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")).agg(F.array_sort(F.collect_set("j")).alias("cuts"))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("text_hash").eqNullSafe(F.col("own_hash"))
    return cut.drop("cuts").join(found, same).drop("own_id", "own_hash")


def removals(docs: DataFrame, work: str, window: int, long_words: int) -> DataFrame:
    """doc_id, text_hash, gone = numbers of the removed lines, for the documents that lose some."""
    docs = docs.select("doc_id", "text")
    shared_hashes: list[int] = []
    for again in range(ROUNDS):
        gone, collided = once(docs, f"{work}/{again}", window, long_words, shared_hashes)
        if not collided:
            return gone
        shared_hashes += collided
    raise ValueError(f"lines whose hashes {ROUNDS} hash functions can't tell apart")


def once(docs: DataFrame, work: str, window: int, long_words: int, shared_hashes: list[int]) -> tuple[DataFrame, list[int]]:
    """The removals if lines with one hash are one line, and the hashes (64 bits: hardly ever any) of which that isn't so."""
    cut = shared.stash(with_boundaries(docs, window, long_words, shared_hashes), f"{work}/marks")
    places = exploded(with_chunks(anchored(cut, work), window), F.col("chunks"), "doc_id", "text_hash")
    place = F.struct("doc_id", "text_hash", F.get("one.at", F.lit(0)).alias("first"))
    chunks = shared.stash(places.select("one.key", place.alias("place"), F.get("one.at", F.size("one.at") - 1).alias("last"), "one.at", "one.hashes"), f"{work}/chunks")
    counts = chunks.groupBy("key").agg(F.count("*").alias("n"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))
    repeated = shared.stash(counts.where("n > 1 AND first_place != last_place").drop("last_place"), f"{work}/repeated")
    hot = shared.hot_keys(repeated.select("key", "n"), "key", "n")
    found = shared.salted_join(chunks.drop("last"), repeated.drop("n"), "key", hot, F.xxhash64("place"), shared.width(docs.sparkSession))
    later = shared.stash(found.where("place != first_place").select("place", "at", "hashes"), f"{work}/later")
    # each hash of a line in these chunks must stand for one line
    wanted = exploded(later, F.col("hashes")).groupBy(F.col("one").alias("key")).agg(F.count("*").alias("n"))
    wanted = shared.stash(wanted, f"{work}/wanted")
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(line_hash(x, shared_hashes).alias("key"), x.alias("bytes")))
    texts = exploded(docs, lines).select("one.*")
    different = picked(texts, wanted, wanted.count(), F.monotonically_increasing_id()).distinct()
    collided = different.groupBy("key").count().where("count > 1").join(wanted, "key", "left_semi").select("key")
    gone = later.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.text_hash").alias("text_hash")).agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))
    return gone, [x.key for x in collided.collect()]


def dedup_lines(docs: DataFrame, work: str, window: int = 2, long_words: int = 50) -> DataFrame:
    """docs with repeated chunks removed and the number of removed lines in removed_lines (a column of that name is replaced)."""
    gone = removals(docs, work, window, long_words)
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("hash"))
    same = F.col("hash").eqNullSafe(F.col("text_hash")) & F.col("row.doc_id").eqNullSafe(F.col("doc_id"))
    rows = rows.join(gone, same, "left").select("row", "gone")
    lines = F.split("row.text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    left = rows.withColumn("left", F.when(F.col("gone").isNotNull(), F.transform(stay, lambda i: F.get(lines, i))))
    left = left.where(F.col("gone").isNull() | F.exists("left", with_text))
    changed = F.col("gone").isNotNull()
    out = left.select("row", F.when(changed, F.size("gone")).otherwise(0).alias("removed"), F.when(changed, F.array_join("left", "\n")).otherwise(F.col("row.text")).alias("left"))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("removed") > 0, F.length("left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    columns = [new.get(c, F.col("row")[c]).alias(c) for c in docs.columns if c != "removed_lines"]
    return out.select(*columns, F.col("removed").alias("removed_lines"))


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, shared.work_dir(spark, "line-chunks"))
