"""Collocations against counts of all n-grams."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from catchment.llm import collocations, shared

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_n=4, min_count=30, top=2000):
    f, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words[lang] += len(w)
            for n in range(1, max_n + 1):
                f[lang].update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        found = []
        candidates = {p: a for p, a in counts.items() if " " in p and a >= min_count}
        longer = defaultdict(list)
        for p in candidates:
            w = p.split(" ")
            for n in range(2, len(w)):
                for i in range(len(w) - n + 1):
                    longer[" ".join(w[i : i + n])].append(p)
        for p, a in candidates.items():
            if any(100 * candidates[x] >= 80 * a for x in longer[p]):
                continue
            w = p.split(" ")
            cuts = [(counts[" ".join(w[:k])], counts[" ".join(w[k:])]) for k in range(1, len(w))]
            score, k = min((2_000_000 * a // (x + y), k) for k, (x, y) in enumerate(cuts))
            found.append((-score, -a, p.encode(), p, a, *cuts[k], words[lang], score))
        for rank, x in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, *x[3:]))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = "New york city the of and in Straße naïve été  x \x00 a b run-of".split(" ")
    out = []
    for i in range(300):
        words = [rng.choice(base) for _ in range(rng.choice([0, 1, 5, 60]))]
        words += rng.choice([["big", "red", "bus", "stop"], ["big", "red"], ["Big", "RED", "bus"], []])
        out.append((rng.choice(["en", "en", "fr", None, "und"]), rng.choice([" ", "  ", "\t"]).join(w + rng.choice(["", "", "", ".", "\n", ";", "\r"]) for w in words)))
    out += [("en", "again and again " * 2000), ("en", None), (None, ""), ("de", "...  \n"), ("fr", "echo " * 40)]
    return out + out[:30]


@pytest.mark.parametrize("slice_bytes", [300, collocations.SLICE])
def test_collocations(spark, texts, work, monkeypatch, slice_bytes):
    monkeypatch.setattr(collocations, "SLICE", slice_bytes)
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(4).withColumns({c: F.lit(1) for c in ("gram", "words", "count", "rank", "a", "k", "left")})
    got = sorted(tuple(x) for x in collocations.collocations(docs, f"{work}/4").collect())
    assert got == brute(texts) and len(got) > 5
    for max_n, least, top in ((2, 3, 50), (3, 10, 7), (5, 40, 2000)):
        got = sorted(tuple(x) for x in collocations.collocations(docs, f"{work}/{max_n}-{least}", max_n, least, top).collect())
        assert got == brute(texts, max_n, least, top)


def test_filter_only_saves_rows(spark, texts, work, monkeypatch):
    """A filter of the least size, which lets nearly all pairs through, gives the same phrases."""
    monkeypatch.setattr(collocations, "MOST_BITS", 7)
    docs = spark.createDataFrame(texts, "lang string, text string")
    assert sorted(tuple(x) for x in collocations.collocations(docs, work).collect()) == brute(texts)


def test_filter_holds_its_pairs(spark):
    grams = [("en", "a b"), ("fr", "é ü"), ("und", "x  y"), ("en", "big red")]
    known = collocations.PairFilter.of(spark.createDataFrame(grams, "lang string, gram string"))
    assert all(known.holds(lang, [g.encode()])[0] for lang, g in grams)
    assert known.holds("en", [f"a {i}".encode() for i in range(2000)]).sum() < 20


def test_no_phrases(spark, empty, work):
    assert collocations.collocations(empty, f"{work}/1").count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "one two"), ("en", None)], "lang string, text string"), f"{work}/2").count() == 0


def test_large_counts_stay_exact(spark):
    """Products over 64 bits."""
    a, l, r = 9_000_000_000_000_000, 9_100_000_000_000_000, 9_000_000_000_000_001
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(F.expr("cast(2000000 AS decimal(18, 0)) * cast(a AS decimal(19, 0)) div (l + r)").alias("s")).first()
    assert row.s == 2_000_000 * a // (l + r)
