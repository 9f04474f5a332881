"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Seeds of an item are all its n-grams, however frequent in the corpus. A document that holds a seed is aligned
with the item around it, if enough of the item's words stand there: local alignment of words (match +2,
other -1, gap -1), scored against the item aligned with itself. A copy that keeps one n-gram is a candidate,
however much it was edited elsewhere.

The corpus is never shuffled: hashes of the benchmark's n-grams go to it. A block of the benchmark holds about
`max_bytes` of text (an item is never cut), so a task holds about 6 times that in hashes and at most some 30
times for the words of the items it aligns; a larger benchmark takes a pass over the documents for each block.

Words are runs of [0-9a-z] and non-ASCII, A-Z lower-cased. Items of under `min_words` words (null and
empty ones too) are never reported; documents without words match nothing. A repeated document row or
item is reported for each repetition. Either table may be empty.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm import hashing, shared, tokens

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "doc_id long, item_id long, score double, first_word long, last_word long, seeds long"
MATCH, OTHER, GAP = 2, -1, -1


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and the first and last position in window of that alignment's rows (linear gaps)."""
    steps = -GAP * np.arange(len(window) + 1)
    above, above_from = np.zeros(len(window) + 1, np.int64), np.arange(len(window) + 1)
    best = (0, 0, 0)
    for word in item:
        score = np.where(window == word, MATCH, OTHER)
        diagonal = above[:-1] + score
        fresh, origin = np.zeros_like(above), np.arange(len(window) + 1)
        up = above + GAP
        take = up > 0
        fresh[take], origin[take] = up[take], above_from[take]
        take = diagonal >= np.maximum(fresh[1:], 1)
        fresh[1:][take], origin[1:][take] = diagonal[take], above_from[:-1][take]
        # a run of gaps to the right: the best of all cells on the left, less the distance
        lifted = fresh + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(len(top)), 0))
        moved = top - steps
        origin = np.where((moved > fresh) & (moved > 0), origin[source], origin)
        fresh = np.maximum(fresh, moved)
        at = int(fresh.argmax())
        if fresh[at] > best[0]:
            best = (int(fresh[at]), int(origin[at]), at - 1)
        above, above_from = fresh, origin
    return best


class Finder:
    """A block of items, their seeds and the thresholds, as they travel to the tasks."""

    def __init__(self, items: list[tuple[int, bytes]], n: int, threshold: float):
        self.items, self.n, self.threshold = items, n, threshold
        found = [hashing.grams(hashing.words_at(text.lower(), hashing.NO_WORD)[0], n) for _, text in items]
        own = np.repeat(np.arange(len(items), dtype=np.int32), [len(g) for g in found])
        at = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(g), dtype=np.int32) for g in found)])
        seeds = np.concatenate([np.zeros(0, np.uint64), *found])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.own, self.at = seeds[order], own[order], at[order]
        self.table_bits = max(10, (8 * len(seeds)).bit_length())
        self.held: dict = {}

    def item(self, k: int) -> tuple[list[bytes], Counter]:
        if k not in self.held:
            words = words_of(self.items[k][1])
            self.held[k] = words, Counter(words)
        return self.held[k]

    def hits(self, texts: list[bytes], table: np.ndarray):
        """For each text with seeds: its number, and the first words and seed numbers of all hits."""
        joined = b"\n".join(texts)
        words, places = hashing.words_at(joined.lower(), hashing.NO_WORD)
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(ends, places, "right")
        found = hashing.grams(words, self.n)
        some = np.flatnonzero(table[found >> np.uint64(64 - self.table_bits)])
        some = some[doc[some] == doc[some + self.n - 1]]
        low, high = (np.searchsorted(self.seeds, found[some], side) for side in ("left", "right"))
        count = high - low
        some, low, count = some[count > 0], low[count > 0], count[count > 0]
        seed = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        word = np.repeat(some, count)
        owner = doc[word]
        cuts = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else []
        firsts = np.searchsorted(doc, np.arange(len(texts)))
        for a, b in zip(cuts, [*cuts[1:], len(owner)]):
            k = int(owner[a])
            yield k, word[a:b] - firsts[k], seed[a:b]

    def align(self, words: list[bytes], starts: np.ndarray, seeds: np.ndarray) -> list[tuple]:
        """(item number, score, first word, last word, seeds) of the items found in a document."""
        near: dict[int, list[int]] = {}
        for k, shift in zip(self.own[seeds].tolist(), (starts - self.at[seeds]).tolist()):
            near.setdefault(k, []).append(shift)
        out, held = [], set(words)
        for k, shifts in near.items():
            item, need = self.item(k)
            if sum(n for w, n in need.items() if w in held) < self.threshold * len(item):  # bounds the score in any window
                continue
            slack, best = len(item) // 2 + 4, None
            shifts.sort()
            low = 0
            for i in range(1, len(shifts) + 1):
                if i == len(shifts) or shifts[i] - shifts[i - 1] > slack:
                    start = max(0, shifts[low] - slack)
                    window = words[start : shifts[i - 1] + len(item) + slack]
                    if sum((need & Counter(window)).values()) >= self.threshold * len(item):  # bounds the score
                        ids = {w: j for j, w in enumerate(need)}
                        score, first, last = smith_waterman(np.array([ids[w] for w in item]), np.array([ids.get(w, -1) for w in window]))
                        share = score / (MATCH * len(item))
                        if share >= self.threshold and (best is None or share > best[1]):
                            best = (k, share, start + first, start + last, i - low)
                    low = i
            if best:
                out.append(best)
        return out

    def leaks(self, batches):
        """Each batch with the found items of each of its rows."""
        table = np.zeros(1 << self.table_bits, bool)
        table[self.seeds >> np.uint64(64 - self.table_bits)] = True
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for low, column in tokens.slices(batch.column(batch.schema.get_field_index("text")), 1_000_000):
                texts = tokens.utf8(column)
                for k, starts, seeds in self.hits(texts, table):
                    found[low + k] = self.align(words_of(texts[k]), starts, seeds)
            yield batch, found
        tokens.trim()

    def find(self, batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("seeds", pa.int64())])
        for batch, found in self.leaks(batches):
            out = [(name, self.items[k][0], *rest) for name, some in zip(batch.column("doc_id").to_pylist(), found) for k, *rest in some]
            columns = list(zip(*out)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def drop(self, batches):
        import pyarrow as pa

        for batch, found in self.leaks(batches):
            yield batch.filter(pa.array([not some for some in found], pa.bool_()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, min_words: int = 8, max_bytes: int = 8_000_000) -> DataFrame:
    """FOUND: a row for each document and item whose alignment reaches the threshold."""
    out = docs.sparkSession.createDataFrame([], FOUND)
    for finder in finders(benchmark, n, threshold, min_words, max_bytes):
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(finder.find, FOUND))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, min_words: int = 8, max_bytes: int = 8_000_000) -> DataFrame:
    """The rows of docs, all columns, in which no item is found."""
    out = docs
    for finder in finders(benchmark, n, threshold, min_words, max_bytes):
        out = out.mapInArrow(finder.drop, docs.schema)
    return out


def finders(benchmark: DataFrame, n: int, threshold: float, min_words: int, max_bytes: int):
    """A Finder for each block of the benchmark."""
    items = shared.bound_batches(benchmark).select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-max(1, size) // max_bytes)
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        held = [(i, t.encode()) for i, t in block.collect() if len(words_of(t.encode())) >= min_words]  # about max_bytes of text
        if held:
            yield Finder(held, n, threshold)


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(shared.table(spark, sf_dir, "documents").select("doc_id", "text"), shared.table(spark, sf_dir, "benchmark").select("item_id", "text"))
