"""Fill-in-middle: documents cut into prefix, middle and suffix at units, and written in one of two orders.

A unit is a run of ASCII letters or any other single code point. For each batch of texts the maximal runs of
one character class (letters, or other code points of one UTF-8 width) are stored with the units, code points
and bytes before each. A cut after k units is a binary search for the run that holds it; the place in the run
is arithmetic, as each unit of a run is as wide as the next. No list of units is made.

Cuts and form of a document follow from the SHA-256 of "<seed>:<doc_id>" alone, so rows repeat exactly in any
partitioning, and rows that share a doc_id share the draw (null: the draw of "<seed>:"). The form is `plain`,
`psm` (prefix, suffix, middle) or `spm` (suffix, prefix, middle). Null text counts as empty; empty texts and
texts that hold a mark stay plain, so an output can always be read back (`restored`). Either of the three
parts may be empty. An empty table gives an empty result; further columns are not read.

Rows are worked on where they are: no shuffle. A task holds one Arrow batch and one slice of SLICE bytes of
it, or one longer text, with about 30 bytes for each byte of a slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm import shared

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE = 4 << 20
LETTER, INNER = 0, 255
#: The class of a byte: a letter, the width of the code point that it begins, or a byte inside one.
CLASS = np.ones(256, np.uint8)
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[0x80:0xC0] = INNER
CLASS[0xC0:0xE0] = 2
CLASS[0xE0:0xF0] = 3
CLASS[0xF0:] = 4


class Runs:
    """The maximal runs of one class in each of several texts; text i is data[edges[i]:edges[i + 1]]."""

    def __init__(self, data: np.ndarray, edges: np.ndarray):
        kind = CLASS[data]
        at = np.flatnonzero(kind != INNER)
        kind = kind[at]
        first = np.searchsorted(at, edges)  # code points before each text
        new = np.ones(len(at), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[first[first < len(at)]] = True
        start = np.flatnonzero(new)
        self.width = np.append(kind[start], 0)
        self.char, self.byte = np.append(start, len(at)), np.append(at[start], len(data))
        units = np.where(self.width[:-1] == LETTER, 1, np.diff(self.char))
        self.before = np.concatenate([[0], np.cumsum(units)])
        self.text = self.before[np.searchsorted(start, first)]  # units before each text
        self.units, self.first = np.diff(self.text), first[:-1]

    def cut(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first k[i] units of text i end: code points of the text before it, and its byte in data."""
        target = self.text[:-1] + k
        run = np.searchsorted(self.before, target, "right") - 1
        inside = target - self.before[run]  # 0 in a run of letters, which is one unit
        return self.char[run] + inside - self.first, self.byte[run] + inside * self.width[run]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four groups of eight hexadecimal digits of the SHA-256 of "<seed>:<doc_id>"."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4]) for i in range(4)]


def slices(edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most SLICE bytes together, or one row."""
    low = 0
    while low < len(edges) - 1:
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + SLICE, "right")) - 1)
        yield low, high
        low = high


def transformed(ids: list[int | None], texts: pa.Array, seed: int, fim_percent: int, spm_percent: int) -> Iterator[pa.RecordBatch]:
    texts = texts.fill_null("").cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    for low, high in slices(edges):
        part = data[edges[low] : edges[high]]
        own = edges[low : high + 1] - edges[low]
        runs, whole = Runs(part, own), part.tobytes()
        drawn = np.array([draws(i, seed) for i in ids[low:high]], np.int64)
        cuts = np.sort(drawn[:, :2] % (runs.units + 1)[:, None], axis=1)
        (chars, a), (ends, b) = runs.cut(cuts[:, 0]), runs.cut(cuts[:, 1])
        form, out = [], []
        for i in range(high - low):
            text = whole[own[i] : own[i + 1]]
            if not text or drawn[i, 2] % 100 >= fim_percent or any(x in text for x in marks):
                form.append("plain")
                out.append(text)
                continue
            prefix, middle, suffix = whole[own[i] : a[i]], whole[a[i] : b[i]], whole[b[i] : own[i + 1]]
            form.append("spm" if drawn[i, 3] % 100 < spm_percent else "psm")
            out.append(b"".join((s, suffix, p, prefix, m, middle) if form[-1] == "spm" else (p, prefix, s, suffix, m, middle)))
        plain = np.array(form) == "plain"
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[low:high], pa.int64()), pa.array(runs.units, pa.int64()), pa.array(form, pa.string()), pa.array(chars, pa.int64(), mask=plain), pa.array(ends - chars, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def fill_middle(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain) and output of each row of docs(doc_id, text)."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield from transformed(batch.column(0).to_pylist(), batch.column(1), seed, fim_percent, spm_percent)

    rows = shared.bound_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: a part ends where the next mark first occurs, as texts with marks are plain."""

    def after(text: Column, head: Column) -> Column:
        return F.substring(text, F.length(head) + 4, F.length(text))

    rest = F.substring(output, F.lit(4), F.length(output))
    one = F.when(form == "psm", F.substring_index(rest, SUFFIX, 1)).otherwise(F.substring_index(rest, PREFIX, 1))
    rest = after(rest, one)
    two = F.substring_index(rest, MIDDLE, 1)
    middle = after(rest, two)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
         ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM units),
parts AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
written AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts),
marked AS (SELECT *, strpos(output, '<P>') AS at_p, strpos(output, '<S>') AS at_s, strpos(output, '<M>') AS at_m FROM written)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN output[at_p + 3:at_s - 1] || output[at_m + 3:] || output[at_s + 3:at_m - 1]
              ELSE output[at_p + 3:at_m - 1] || output[at_m + 3:] || output[at_s + 3:at_p - 1] END) AS restored_sha256
FROM marked
"""
