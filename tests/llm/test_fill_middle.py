"""Fill-in-middle against lists of units, and the way back from an output."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.llm import fill_middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
ODD = ["", "a", "Z", "é", "aé", "éa", "🙂a🙂🙂b", "a\n\nb", "x" * 5000 + "é" * 700, "日本 語b c", "a<P>b", "<S>", "t <M", "<P", "a<", "\x00a\x00"]


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_cuts_at_every_unit():
    """Each number of units of each text, empty texts between them, gives the length of the joined units."""
    texts = ["", *ODD, "", "", "b"]
    raw = [t.encode() for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    runs = fill_middle.Runs(np.frombuffer(b"".join(raw), np.uint8), edges)
    units = [UNIT.findall(t) for t in texts]
    assert runs.units.tolist() == [len(u) for u in units]
    for k in range(max(map(len, units)) + 1):
        cut = np.minimum(k, runs.units)
        chars, at = runs.cut(cut)
        heads = ["".join(u[:k]) for u in units]
        assert chars.tolist() == [len(x) for x in heads]
        assert (at - edges[:-1]).tolist() == [len(x.encode()) for x in heads]
        if k > 60:
            break


@pytest.mark.parametrize("size", [1 << 8, fill_middle.SLICE])
def test_fill_middle(spark, rows, docs, monkeypatch, size):
    monkeypatch.setattr(fill_middle, "SLICE", size)
    odd = [(1000 + 10 * i + j, t) for i, t in enumerate(ODD) for j in range(10)]
    frame = docs.union(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit("x") for c in ("n", "form", "output", "prefix_chars")})
    out = fill_middle.fill_middle(frame)
    got = out.withColumn("text", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(x)[:6] for x in got) == Counter(brute(i, t) for i, t in rows + odd)
    assert Counter((x.doc_id, x.text) for x in got) == Counter((i, t or "") for i, t in rows + odd)
    assert {x.form for x in got} == {"plain", "psm", "spm"}


def test_fill_middle_rates(spark, docs, empty):
    assert fill_middle.fill_middle(empty).count() == 0
    assert {x.form for x in fill_middle.fill_middle(docs.where("text != ''"), fim_percent=0).collect()} == {"plain"}
    assert {x.form for x in fill_middle.fill_middle(docs.where("text != ''"), fim_percent=100, spm_percent=100).collect()} == {"spm"}
    one, two = (fill_middle.fill_middle(docs, seed=k).select("doc_id", "output") for k in (1, 2))
    assert one.exceptAll(two).count() > 50
