"""License scans: an exact set-similarity join of text blocks with license templates.

The blocks tested against a template of n words are all runs of n consecutive words of a text, across line
ends (a shorter text is one block). A block's set is its distinct words; a template is found where a block
holds at least `threshold` of the template's distinct words (containment). Words are ordered by the number of
the corpus's documents that hold them, rarest first. With c the least overlap of a template of t words, a
block that has it must hold one of the template's first t - c + 1 words (prefix filter: only runs around such
a word are looked at), at least c of its words (length filter), and, if the rarest word that they share is the
template's i-th, t - i + 1 must reach c, as must the block's words from there on (positional filter); what
remains is verified by counting over the sliding block. Templates are a parameter (a dict, or a table with
columns label and text), checked against `max_templates`; the corpus stays where it is read.

Besides, base phrases are found wherever their words stand consecutively in the text.

Null text counts as empty: no word, no label, score 0. A repeated row is reported again. An empty table
gives an empty result. Other columns of the input are never read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm import shared, tokens

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "no-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

ROW = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Template:
    """A template's distinct words as ranks in the word order (rarest first), the length of its blocks and its least overlap."""

    def __init__(self, ranks: list[int], length: int, threshold: float):
        self.place = {r: i for i, r in enumerate(sorted(ranks))}
        self.size, self.length = len(ranks), length
        self.least = max(1, math.ceil(threshold * len(ranks) - 1e-9))
        self.prefix = frozenset(sorted(ranks)[: self.size - self.least + 1])

    def overlap(self, places: dict[int, list[int]]) -> int:
        """The largest overlap of a block, if it is enough (else 0). places: where the text holds each word of any template, by rank."""
        if sum(r in places for r in self.place) < self.least:  # length filter on the whole text
            return 0
        centres = sorted(p for r in self.prefix if r in places for p in places[r])
        own = sorted((p, i) for r, i in self.place.items() if r in places for p in places[r])
        best = low = 0
        for a in self.runs(centres):
            while low < len(own) and own[low][0] < a[0]:
                low += 1
            high = low
            while high < len(own) and own[high][0] <= a[1]:
                high += 1
            # length and positional filter on the run
            if min(high - low, self.size - min((i for _, i in own[low:high]), default=self.size)) >= self.least:
                best = max(best, self.slide(own[low:high]))
        return best if best >= self.least else 0

    def runs(self, centres: list[int]):
        """Ranges of word places that blocks around the centres cover, merged."""
        first = last = None
        for c in centres:
            if first is None or c - self.length + 1 > last + 1:
                if first is not None:
                    yield first, last
                first = c - self.length + 1
            last = c + self.length - 1
        if first is not None:
            yield first, last

    def slide(self, own: list[tuple[int, int]]) -> int:
        """The most distinct words within `length` consecutive places."""
        counts, best, high = [0] * self.size, 0, 0
        held = 0
        for low, (p, i) in enumerate(own):
            while high < len(own) and own[high][0] < p + self.length:
                held += not counts[own[high][1]]
                counts[own[high][1]] += 1
                high += 1
            best = max(best, held)
            counts[i] -= 1
            held -= not counts[i]
        return best


class Templates:
    def __init__(self, templates: dict[str, str], threshold: float, counts: dict[str, int]):
        order = sorted({w for t in templates.values() for w in t.split()}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w.encode(): i for i, w in enumerate(order)}
        self.vocabulary = frozenset(self.rank)
        self.held = {label: Template([self.rank[w.encode()] for w in set(t.split())], len(t.split()), threshold) for label, t in templates.items() if t.split()}
        self.keys = frozenset(order[r].encode() for t in self.held.values() for r in t.prefix)

    def find(self, words: list[bytes], distinct: set[bytes]) -> dict[str, float]:
        """Label -> containment of the templates found in a text's words."""
        if self.keys.isdisjoint(distinct):
            return {}
        places: dict[int, list[int]] = {}
        for p, w in enumerate(words):
            if w in self.rank:
                places.setdefault(self.rank[w], []).append(p)
        found = {}
        for label, t in self.held.items():
            if not t.prefix.isdisjoint(places) and (common := t.overlap(places)):
                found[label] = common / t.size
        return found


def read_templates(templates, max_templates: int) -> dict[str, str]:
    """Label -> lower-cased words of a dict, or of a table with columns label and text."""
    if isinstance(templates, DataFrame):
        templates = dict(map(tuple, templates.select("label", "text").where("label IS NOT NULL AND text IS NOT NULL").limit(max_templates + 1).collect()))
    if len(templates) > max_templates:
        raise ValueError(f"more than {max_templates} templates, which go to every task")
    return {k: b" ".join(WORD.findall(t.encode().lower())).decode() for k, t in templates.items()}


def document_counts(docs: DataFrame, vocabulary: frozenset) -> dict[str, int]:
    """For each word of the templates, the documents that hold it (a row for each such word comes back)."""

    def count(batches):
        import pyarrow as pa

        seen: dict[bytes, int] = {}
        for batch in batches:
            for text in tokens.each(batch.column("text")):
                for w in vocabulary.intersection(WORD.findall(text.lower())):
                    seen[w] = seen.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n")).collect()
    return dict(map(tuple, rows))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, threshold: float = 0.9, base: dict[str, str] = BASE, max_templates: int = 10_000) -> DataFrame:
    """ROW for each document."""
    templates = read_templates(templates, max_templates)
    docs = shared.bound_batches(docs)
    held = Templates(templates, threshold, document_counts(docs, Templates(templates, threshold, {}).vocabulary))
    phrases = [(tuple(p.encode().split()), label) for p, label in base.items()]
    starts = frozenset(p[0] for p, _ in phrases)

    def scan(batches):
        import pyarrow as pa

        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for n, k in (c.split() for c in ROW.split(", "))])
        for batch in batches:
            rows = []
            for name, text in zip(batch.column("doc_id").to_pylist(), tokens.each(batch.column("text"))):
                words = WORD.findall(text.lower())  # bytes: A-Z only
                all_words = set(words)
                places, labels = [], set()
                if not starts.isdisjoint(all_words):
                    for phrase, label in phrases:
                        at = [i for i, w in enumerate(words) if w == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase] if phrase[0] in all_words else []
                        if at:
                            places += at
                            labels.add(label)
                found = held.find(words, all_words)
                score = max([1.0 if labels else 0.0, *found.values()])
                rows.append((name, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels.union(found))), score))
            columns = list(zip(*rows)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(scan, ROW)


def op3_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    here = "list_filter(range(len(w)), lambda i: w[i + 1 : i + {}] = {})"
    base = ", ".join(f"{here.format(len(p.split()), p.split())} AS b{k}" for k, p in enumerate(BASE))
    templates = ", ".join(f"('{label}', {sorted(set(t.split()))}, {len(t.split())})" for label, t in TEMPLATES.items())
    labels = ", ".join(f"CASE WHEN len(b{k}) > 0 THEN '{label}' END" for k, label in enumerate(BASE.values()))
    every = " || ".join(f"b{k}" for k in range(len(BASE)))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS MATERIALIZED (SELECT r, doc_id, {words.format("text")} AS w FROM docs),
based AS (SELECT r, doc_id, len(w) AS n_words, {base} FROM words),
places AS (SELECT r, doc_id, n_words, {every} AS places, list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM based),
templates AS (SELECT *, ceil(0.9 * len(tokens) - 1e-9) AS least FROM (VALUES {templates}) t(label, tokens, n)),
maybe AS (SELECT r, label, tokens, n, least, w FROM words, templates WHERE len(list_intersect(list_distinct(w), tokens)) >= least),
hits AS (SELECT r, label, list_max(list_transform(list_filter(range(len(w)), lambda i: list_contains(tokens, w[i + 1])),
                lambda i: len(list_intersect(list_distinct(w[i + 1 : i + n]), tokens)))) AS common, least, len(tokens) AS size FROM maybe),
own AS (SELECT r, list(label) AS own, max(common / size) AS share FROM hits WHERE common >= least GROUP BY r)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(own, []))), ',') AS labels,
       greatest(CASE WHEN len(places) > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0.0))::DOUBLE AS score
FROM places LEFT JOIN own USING (r)
"""


SQL = _sql()
