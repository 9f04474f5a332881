"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.llm import bloom_cascade, decontaminate, exact_index, hashing, jaccard_join, langid, license_join, line_chunks, packing, shared, sharding, token_planes, tokens

from .conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def clashing(docs):
    """Extra columns named like the operators' own."""
    return docs.withColumns({c: F.lit("x") for c in ("key", "digest", "size", "lines", "gone", "entity", "hot", "removed_lines", "start", "group")})


# 1 exact dedup

def brute_groups(rows):
    """keep_id and group size of each text, and all rows as (doc_id, keep_id, size, kept, digest): one kept row a text."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((x for x in ids if x is not None), default=None)
        digest = hashlib.sha256(t.encode()).hexdigest()
        want.update((i, keep, len(ids), False, digest) for i in ids)
        want[keep, keep, len(ids), False, digest] -= 1
        want[keep, keep, len(ids), True, digest] += 1
    return +want


def test_exact_dedup(spark, docs, rows, work):
    index = exact_index.DigestIndex(spark, f"{work}/index")
    held = exact_index.digested(clashing(docs), f"{work}/rows")
    index.add(held)
    got = Counter((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in index.resolve(held).collect())
    assert got == brute_groups(rows)


def test_index_persists_and_batches_merge(spark, rows, work):
    """Batches added by sessions with other partition counts; an index knows its own number of buckets."""
    path, held = f"{work}/index", []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k, width in enumerate((8, 4, 3, 16)):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            index = exact_index.DigestIndex(spark, path)
            assert index.buckets == 8
            batch = spark.createDataFrame(rows[k::4], "doc_id long, text string")
            held.append(exact_index.digested(batch, f"{work}/rows-{k}", k))
            index.add(held[-1])
            index.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    index = exact_index.DigestIndex(spark, path)
    assert index.entries().count() == len({t or "" for _, t in rows})
    assert index.held(index.name).count() == len({t or "" for _, t in rows})  # no digest is appended twice
    found = index.resolve(held[0].union(held[1]).union(held[2]).union(held[3]))
    index.close()
    assert Counter(tuple(x) for x in found.collect()) == brute_groups(rows)
    assert not [t for t in spark.catalog.listTables() if t.name in (index.name, index.more)]
    with pytest.raises(ValueError):
        exact_index.DigestIndex(spark, path, 5)


def test_index_does_not_grow_with_repeats(spark, docs, rows, work):
    """Ten batches of the same rows leave as many rows as one; a compacted bucket is one file."""
    index = exact_index.DigestIndex(spark, f"{work}/index", 4, compact_after=4)
    held = exact_index.digested(docs, f"{work}/rows")
    texts = len({t or "" for _, t in rows})
    for k in range(10):
        index.add(held.withColumn("batch", F.lit(k).cast("long")))
        assert index.held(index.name).count() == texts and index.held(index.more).count() <= texts * 4
    index.compact()
    assert index.held(index.more).count() == 0 and len(spark.table(index.name).inputFiles()) <= 4
    got = {x.digest: x.rows for x in index.entries().collect()}
    assert sum(got.values()) == 10 * len(rows)
    index.close()


def test_a_batch_that_died_does_not_count(spark, docs, rows, work, monkeypatch):
    index = exact_index.DigestIndex(spark, f"{work}/index", 4)
    held = exact_index.digested(docs, f"{work}/rows")
    with monkeypatch.context() as m:
        m.setattr(index, "_commit", lambda part: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            index.add(held)
    index.close()
    again = exact_index.DigestIndex(spark, f"{work}/index")
    assert again.entries().count() == 0
    again.add(held)
    assert Counter(tuple(x) for x in again.resolve(held).collect()) == brute_groups(rows)
    again.close()


# 2 token planes

@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 4096])
def test_block_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32 if n == 7 else 49_408, n, dtype=np.uint32)
    assert np.array_equal(token_planes.unpack_block(token_planes.pack_block(ids, kind)), ids)


def test_joined_checksums():
    raw = [bytes(range(40)), b"", b"abcd" * 5]
    import pandas as pd

    got = token_planes.joined_crc(pd.Series([[len(x) // 4 for x in raw]]), pd.Series([[zlib.crc32(x) for x in raw]]))
    assert got[0] == zlib.crc32(b"".join(raw))


def reference_ids(tokenizer, text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer).encode(text or "", add_special_tokens=False).ids, 1]


def test_parts_encode_like_whole_texts(tokenizer, rows):
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    odd = ["İstanbul ΣΑΣ ς\u00a0x\u2003y", "e\u0301 \u0301a", "a\x0bb\x0cc\x1cd\x85e", "it's we'll 12 3½ <|endoftext|> <|start oftext|>", "日本語 テスト🙂👍🏽 ﬀ", "", " \n ", "क़ख़ Å K' a's.' x.'s", "İ. İİ, ab.. .ab a.b $$"]
    texts = odd + [x for _, x in rows if len(x or "") < 5000]
    own = tokens.Encoder(tokenizer)
    assert own.by_parts
    for by_parts in (True, False):
        own.by_parts = by_parts
        got = [ids[a:b].tolist() for _, ids, edges in own.encode(pa.chunked_array([pa.array(["skipped", *texts])]).chunk(0).slice(1)) for a, b in zip(edges, edges[1:])]
        assert got == [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_other_tokenizers_encode_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    own, t = tokens.Encoder(path), Tokenizer.from_file(path)
    texts = [None, "a  b\n\n c", " lead", "trail "] * 100
    got = [ids[a:b].tolist() for _, ids, edges in own.encode(pa.array(texts)) for a, b in zip(edges, edges[1:])]
    assert not own.by_parts and got == [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_token_planes(spark, docs, rows, work, tokenizer):
    token_planes.write_planes(clashing(docs), work, tokenizer, block_ids=1000, shards=3)
    got = token_planes.read_planes(spark, work).collect()
    want, at = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = reference_ids(tokenizer, t)
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == Counter(want)
    ordered = sorted(got, key=lambda x: x.start)
    for x in ordered:
        assert x.start == at
        at += x.n_tokens
    ids = [x.doc_id for x in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


# 3 licences

def brute_templates(words, templates, threshold):
    """Label -> largest share of the template's words in a run of as many consecutive words."""
    out = {}
    for label, text in templates.items():
        t, n = set(text.split()), len(text.split())
        share = max((len(t & set(words[i : i + n])) / len(t) for i in range(max(1, len(words) - n + 1))), default=0)
        if share >= threshold - 1e-12:
            out[label] = share
    return out


def test_licence_filters_match_all_blocks():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(14)]
    templates = {f"t{i}": " ".join(rng.choices(vocabulary, k=rng.randint(1, 12))) for i in range(40)}
    counts = {w: rng.randrange(50) for w in vocabulary}
    for threshold in (0.5, 0.75, 0.9, 1.0):
        held = license_join.Templates(templates, threshold, counts)
        for _ in range(150):
            words = rng.choices([*vocabulary, *(f"x{i}" for i in range(rng.choice([1, 30])))], k=rng.randint(0, 60))
            code = [w.encode() for w in words]
            assert held.find(code, set(code)) == brute_templates(words, templates, threshold)


def test_licence_texts_across_lines(spark):
    """Wrapped texts are found; a template's words scattered in a long line are not. Repeated rows, clashing columns, a very long text."""
    t = license_join.TEMPLATES
    rng = random.Random(8)
    far = prose(rng, 300, 400).split()
    for k, w in enumerate(t["mit"].split()):
        far.insert(60 * k, w)
    wrap = lambda x: "\n * ".join(" ".join(x.split()[i : i + 7]) for i in range(0, len(x.split()), 7))
    rows = [(1, "x\n" + wrap(t["mit-text"]).replace("copy", "copy,")), (2, " ".join(far)), (3, wrap(t["bsd"])), (4, prose(rng, 80_000) + "\n" + wrap(t["mpl-2.0"])), (1, "x\n" + wrap(t["mit-grant"]))]
    docs = clashing(spark.createDataFrame(rows * 2, "doc_id long, text string").withColumns({"words": F.lit(1), "labels": F.lit("x"), "score": F.lit(2)}))
    got = Counter((x.doc_id, x.labels) for x in license_join.scan_licenses(docs).collect())
    assert got == Counter({(1, "mit-text"): 2, (2, ""): 2, (3, "bsd"): 2, (4, "mpl-2.0"): 2, (1, "mit-grant,mit-text"): 2})
    table = spark.createDataFrame([("own", "Alpha, bravo\ncharlie"), (None, "x"), ("none", None)], "label string, text string")
    found = license_join.scan_licenses(spark.createDataFrame([(1, "x bravo\nalpha CHARLIE"), (2, "alpha x bravo charlie")], "doc_id long, text string"), table)
    assert {x.doc_id: x.labels for x in found.collect()} == {1: "own", 2: ""}
    with pytest.raises(ValueError):
        license_join.scan_licenses(docs, table, max_templates=0)


def test_licences(spark):
    texts = {1: "x\nReleased under the MIT License.\ny", 2: "CC\nby cc by", 3: None, 4: "All rights reserved", 5: "Licensed under the Apache License, Version 2.0.", 6: "gnu GENERAL public-license"}
    got = {x.doc_id: x for x in license_join.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].n_base, got[1].first_word, got[1].score) == ("mit", 0, None, 1.0)
    assert (got[2].base_labels, got[2].n_base, got[2].first_word, got[2].last_word) == ("cc-by", 2, 0, 2)
    assert (got[3].n_words, got[3].labels, got[3].score) == (0, "", 0.0)
    assert got[4].labels == "reserved" and got[5].labels == "apache-2.0" and got[6].base_labels == "gpl"


# 4 line chunks

def i64(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def brute_line_chunks(text, window, long_words):
    """Numbers of the lines of each chunk: all pairs of neighbouring lines with text for a window of two, else those at a boundary."""
    import xxhash

    marks = [k for k, x in enumerate((text or "").split("\n")) if x.strip()]
    lines = (text or "").split("\n")
    long = [len(re.findall(r"\S+", lines[k])) >= long_words for k in marks]
    out = [[k] for k, x in zip(marks, long) if x]
    if window == 2:
        return out + [marks[j : j + 2] for j in range(len(marks) - 1)]
    h = [i64(xxhash.xxh64_intdigest(lines[k].encode(), 42)) for k in marks]
    cuts = {s + d for s in range(len(h) - window + 1) for d in range(window) if h[s + d] == min(h[s : s + window])} | {j for j, x in enumerate(long) if x}
    for j in cuts:
        for d in range(1, window):
            out += [marks[a : a + d + 1] for a in (j, j - d) if a >= 0 and a + d < len(marks)]
    return out


def brute_line_dedup(rows, window=2, long_words=50):
    """(doc_id, text, length, removed) after the removal of chunks of which an equal one stands before, each row as often as it is there."""
    seen, out = {}, Counter()
    order = sorted(Counter(rows).items(), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] or ""))
    for at, ((i, t), _) in enumerate(order):
        lines = (t or "").split("\n")
        for c in brute_line_chunks(t, window, long_words):
            body = tuple(lines[k] for k in c)
            seen[body] = min(seen.get(body, (at, c[0])), (at, c[0]))
    for at, ((i, t), n) in enumerate(order):
        lines = (t or "").split("\n")
        gone = {k for c in brute_line_chunks(t, window, long_words) if seen[tuple(lines[k] for k in c)] != (at, c[0]) for k in c}
        left = [x for k, x in enumerate(lines) if k not in gone]
        new = "\n".join(left) if gone else t
        if not gone or any(x.strip() for x in left):
            out[i, new, None if new is None else len(new), len(gone)] = n
    return out


def line_rows():
    """Passages of 2 to 6 short lines and one long line in different contexts, headings between blank lines, repeated rows."""
    rng = random.Random(21)
    passages = [prose(rng, 9 * n, 9) for n in (2, 3, 4, 5, 6)] + [prose(rng, 60, 60)]
    passages.append("\n\n".join(prose(rng, 8, 8) for _ in range(4)))  # paragraphs
    single = "one short line that many documents hold"
    rows = []
    for i in range(42):
        own = [prose(rng, rng.randint(9, 50), 8) + f" {i} {k}" for k in range(2)]
        rows.append((i, "\n".join([own[0], passages[i % 7], own[1] + f"\n{single}\nend {i}"])))
    rows += [(50 + k, f"text {k}\n\nIntro\n\nbody {k}") for k in range(5)]  # headings and paragraph breaks
    rows += [(60, "x\nx\nx\nx"), (61, passages[0]), (62, None), (63, ""), (64, single), (65, "a b\n\n\n\nc d"), (66, "\n \n\n"), (67, "a b\n\nc d\n"), (None, f"new\n{passages[4]}"), (None, None), rows[7], (8, rows[9][1])]
    return passages, single, rows


@pytest.mark.parametrize("window", [2, 3, 4])
@pytest.mark.parametrize("filter_keys", [line_chunks.FILTER_KEYS, 0])
def test_line_chunks(spark, work, monkeypatch, window, filter_keys):
    monkeypatch.setattr(line_chunks, "FILTER_KEYS", filter_keys)
    _, _, rows = line_rows()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")).repartition(3))
    got = Counter((x.doc_id, x.text, x.n_chars, x.removed_lines) for x in line_chunks.dedup_lines(docs, work, window).collect())
    assert got == brute_line_dedup(rows, window)


def test_repeated_passages_go_whole(spark, tmp_path):
    """The query: no line of a passage is left but in its first occurrence; headings, short lines and paragraph breaks stay."""
    passages, single, rows = line_rows()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((x.doc_id, x.text, x.removed_lines) for x in line_chunks.op4_line_chunks(spark, str(tmp_path)).collect())
    assert got == Counter({(i, t, n): k for (i, t, _, n), k in brute_line_dedup(rows).items()})
    texts = [t for i, t, _ in got.elements() if t]
    for p in passages:
        assert all(sum(line in t.split("\n") for t in texts) == 1 for line in p.split("\n") if line)
    assert sum(single in t.split("\n") for t in texts) >= 42
    assert all((50 + k, f"text {k}\n\nIntro\n\nbody {k}", 0) in got for k in range(5))
    assert (65, "a b\n\n\n\nc d", 0) in got and not any(i == 67 for i, *_ in got)  # the same two lines, whatever is between them


def test_lines_with_one_hash_are_told_apart(spark, work, monkeypatch):
    """A hash of seven values: all lines collide, and are known by their SHA-256 in a second round."""

    def weak(line, known):
        own = F.pmod(F.xxhash64(line), F.lit(7))
        return F.when(own.isin(known), F.xxhash64(F.sha2(line.cast("binary"), 256))).otherwise(own) if known else own

    monkeypatch.setattr(line_chunks, "line_hash", weak)
    _, _, rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = Counter((x.doc_id, x.text, x.n_chars, x.removed_lines) for x in line_chunks.dedup_lines(docs, work).collect())
    assert got == brute_line_dedup(rows)


# 5 decontamination

def word_grams(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def test_alignment_matches_plain_recurrence():
    rng = random.Random(6)
    for _ in range(60):
        a = np.array([rng.randrange(5) for _ in range(rng.randint(1, 14))])
        b = np.array([rng.randrange(5) for _ in range(rng.randint(1, 20))])
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.smith_waterman(a, b)[0] == h.max()


def test_leaks_found_and_clean_documents_left(spark):
    rng = random.Random(12)
    items = [(k, prose(rng, rng.randint(20, 60), 11)) for k in range(12)] + [(90, None), (91, "too short"), (92, "")]
    rows, want = [], set()
    for i in range(60):
        text = prose(rng, 120)
        if i % 3 == 0:
            k = rng.randrange(12)
            words = items[k][1].split()
            if i % 2:  # edited: some words replaced, dropped, added
                for _ in range(len(words) // 7):
                    words[rng.randrange(len(words))] = "changed"
                words.insert(5, "added")
            text = text + "\n" + " ".join(w.upper() for w in words) + " " + prose(rng, 30)
            want.add((i, k))
        rows.append((i, text))
    docs = spark.createDataFrame(rows + [(98, None), (99, "")], "doc_id long, text string").withColumn("score", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(docs, bench).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench, max_bytes=700).collect()} == want  # in blocks
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in rows if i % 3} | {98, 99}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_edited_copies_of_frequent_items(spark):
    """Edited copies of items that many documents hold, against alignment with whole documents."""
    rng = random.Random(31)
    items = [(k, [f"i{k}w{j}" for j in range(n)]) for k, n in enumerate((16, 24))]
    texts = [" ".join(w) + " " + prose(rng, 20, 20) for _, w in items for _ in range(30)]  # every 3-gram is frequent
    for _, w in items:
        for edits in [*([[at + 2 for at in range(0, len(w) - 2, 6)]] * 2), *([rng.sample(range(len(w)), len(w) // 4) for _ in range(60)])]:
            texts.append(" ".join([prose(rng, 15, 15), *(f"changed{j}" if j in edits else x for j, x in enumerate(w)), prose(rng, 15, 15)]))
        own = word_grams(w, 3)
        seeds = [min(range(at, min(at + 6, len(own))), key=lambda j: own[j]) for at in range(0, len(own), 6)]
        texts.append(" ".join("changed" if j - 1 in seeds else x for j, x in enumerate(w)))  # one word in the first 3-gram of each 6 places
    want = set()
    for i, t in enumerate(texts):
        words = decontaminate.words_of(t.encode())
        for k, w in items:
            item = [x.encode() for x in w]
            ids = {x: j for j, x in enumerate(item)}
            score = decontaminate.smith_waterman(np.arange(len(item)), np.array([ids.get(x, -1) for x in words]))[0]
            if score >= len(item) and set(word_grams(item, 3)) & set(word_grams(words, 3)):
                want.add((i, k))
    assert len(want) > 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench).collect()} == want
    assert {x.doc_id for x in decontaminate.drop_leaks(docs, bench).collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_leaks_match_all_pairs(spark, tables):
    """Every document of the small table against every item, without seeds: recall and precision are 1."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    items = [(x.item_id, decontaminate.words_of((x.text or "").encode())) for x in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    want = set()
    for doc_id, text in docs:
        words = decontaminate.words_of((text or "").encode())
        held = Counter(words)
        for item_id, item in items:
            if len(item) < 8 or sum(min(n, held[w]) for w, n in Counter(item).items()) * 2 < len(item):
                continue
            ids = {w: j for j, w in enumerate(dict.fromkeys(item))}
            code = np.array([ids.get(w, -1) for w in words])
            if decontaminate.smith_waterman(np.array([ids[w] for w in item]), code)[0] >= len(item):
                want.add((doc_id, item_id))
    got = {(x.doc_id, x.item_id) for x in decontaminate.op5_benchmark_leaks(spark, tables).collect()}
    assert got == want and len(want) > 10


# 6 url filters

def test_cascade_is_exact(spark, work):
    rng = random.Random(1)
    keys = [(f"key{i}", rng.random() < 0.3) for i in range(4000)] + [("", False)]
    rows = spark.createDataFrame([*keys, *keys[:300], (None, False)], "key string, want boolean").withColumn("listed", F.lit("a column of that name"))
    listed = rows.where("want").select("key").unionByName(spark.createDataFrame([("not in the universe",), (None,)], "key string"))
    for most, per in ((100_000, 8), (150, 3)):  # one cascade; several, in several passes
        got = bloom_cascade.CascadeFilter(rows, listed, f"{work}/{most}", most, per).mark(rows).collect()
        assert Counter((x.key, x.listed) for x in got) == Counter([*keys, *keys[:300], (None, False)])
    none = bloom_cascade.CascadeFilter(rows, listed.limit(0), f"{work}/none").mark(rows)
    assert not any(x.listed for x in none.collect())


def test_cascade_stays_small(spark, work):
    """With ten times the other keys, the levels grow by the logarithm only."""
    bits = []
    for n in (20_000, 200_000):
        universe = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"))
        held = bloom_cascade.CascadeFilter(universe, universe.where("key in ('k1') or hash(key) % 200 = 0").limit(100), f"{work}/{n}")
        assert held.mark(universe).where("listed").count() <= 100
        bits.append(held.cascades[0].bits())
    assert bits[1] < 2 * bits[0]


def test_urls(spark, work):
    urls = {1: "http://a.EXAMPLE.com/en/7x?y", 2: "x://spam-farm.example.org", 3: None, 4: "no scheme", 5: "https://b.net/de/1#f", 6: "q://example.net/de/8", 7: "u://org/es/", 8: "u://xorg/es/", 9: "a://com/en/é\nb", 10: "http://plain.test/a", 11: "http://plain.test/b"}
    pages = spark.createDataFrame([*urls.items(), (10, urls[10])], "page_id long, url string").withColumns({"key": F.lit(1), "listed": F.lit(2), "host": F.lit("x"), "part": F.lit(0)})
    listed = spark.createDataFrame([("spam-farm.example.org",), ("plain.test/a",), ("plain.test/a",), (None,), ("a.example.com/en/7x",)], "key string")
    rows = bloom_cascade.judge_urls(pages, listed, work).collect()
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in rows}
    assert len(rows) == 12 and got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2] == ("spam-farm.example.org", "", None, "block")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5][2:] == ("net/de/", "allow") and got[6][2:] == ("example.net/de/8", "block")
    assert got[7][2:] == ("org/es/", "block") and got[8][2] is None and got[9] == ("com", "/en/é\nb", "com/en/", "block")
    assert got[10][2:] == (None, "block") and got[11][2:] == (None, "allow")


# 7 packing

def test_first_fit_matches_a_scan():
    rng = random.Random(2)
    for n in (0, 1, 2, 5, 100):
        sizes = sorted((rng.randint(1, 50) for _ in range(n)), reverse=True)
        bins, offsets = packing.first_fit(np.array(sizes, int), 50)
        room, want = [], []
        for s in sizes:
            k = next((k for k, x in enumerate(room) if x >= s), len(room))
            if k == len(room):
                room.append(50)
            want.append((k, 50 - room[k]))
            room[k] -= s
        assert list(zip(bins.tolist(), offsets.tolist())) == want


def test_packing(docs, rows, work, tokenizer):
    got = packing.pack_documents(clashing(docs), work, tokenizer, 256, group_pieces=100).collect()
    whole = Counter((i, len(reference_ids(tokenizer, t))) for i, t in rows)
    ends = Counter((x.doc_id, x.doc_tokens) for x in got if x.start + x.length == x.doc_tokens)
    assert ends == whole
    assert Counter(i for i, n in whole.elements() for _ in range(-(-n // 256))) == Counter(x.doc_id for x in got)
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    used, total = len(bins) * 256, sum(x.length for x in got)
    assert total / used > 0.9
    ids = np.array(reference_ids(tokenizer, dict(rows)[405]), "<u4")
    for x in got:
        if x.doc_id == 405:
            assert x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes())


# 8 sharding

def test_byte_shards(docs, rows, work):
    got = sharding.shard_by_bytes(clashing(docs), work, 4, 3).collect()
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sums, slots = Counter(), defaultdict(list)
    for x in got:
        sums[x.shard] += x.size
        slots[x.shard].append((x.slot, x.doc_id))
    largest = max(x.size for x in got)
    assert all(abs(sums[k] - sum(sums.values()) / 4) <= largest for k in range(4))
    order = []
    for k in sorted(slots):
        assert [s for s, _ in sorted(slots[k], key=lambda x: x[0])] == list(range(len(slots[k])))
        order += [i for _, i in sorted(slots[k], key=lambda x: x[0])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


# 9 language

def test_mixtures():
    rng = random.Random(7)
    syllables = {"aa": "ka lo mi tu re".split(), "bb": "schn ach eit ung ver".split(), "cc": "qué ión ado ñar ezo".split()}
    text = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    model = langid.Mixture({k: sum(langid.histogram(text(k, 200)) for _ in range(20)).astype(float) for k in syllables})
    for k in syllables:
        assert all(model.infer(text(k, n))[0] == k for n in (3, 30, 300))
    lang, score, found = model.infer(text("aa", 200) + " " + text("bb", 100))
    assert lang == "aa" and {k for k, _ in found} == {"aa", "bb"} and 0.5 < score < 0.85
    assert len(model.infer(text("cc", 200))[2]) == 1


def brute_mixture(table, langs, text, penalty=2.0, rounds=12, least=0.03):
    """The same inference in plain Python: EM over all trigrams, nested sets by penalised likelihood."""
    from math import log

    counts = [(b, int(n)) for b, n in enumerate(langid.histogram(text)) if n]
    total = sum(n for _, n in counts)

    def fit(some, share):
        for _ in range(rounds):
            new = [0.0] * len(some)
            for b, n in counts:
                mixed = sum(s * table[k][b] for s, k in zip(share, some))
                for j, k in enumerate(some):
                    new[j] += n * share[j] * table[k][b] / mixed
            share = [x / total for x in new]
        return share, sum(n * log(sum(s * table[k][b] for s, k in zip(share, some))) for b, n in counts)

    alone = [fit([k], [1.0])[1] for k in range(len(langs))]
    first = max(range(len(langs)), key=lambda k: (round(alone[k], 6), -k))
    chosen, value = ([first], [1.0]), alone[first]
    share, _ = fit(list(range(len(langs))), [1 / len(langs)] * len(langs))
    order = sorted(range(len(langs)), key=lambda k: -round(share[k], 9))
    for size in range(2, sum(s >= least for s in share) + 1):
        some = order[:size]
        fitted, likely = fit(some, [share[k] / sum(share[j] for j in some) for k in some])
        likely -= penalty * (size - 1) * log(total)
        if likely <= value:
            break
        chosen, value = (some, fitted), likely
    return sorted(((langs[k], s) for k, s in zip(*chosen)), key=lambda x: (-x[1], x[0]))


def test_mixtures_match_plain_inference():
    rng = random.Random(13)
    syllables = ["ka lo mi tu re".split(), "schn ach eit ung ver".split(), "qué ión ado ñar ezo".split(), "ka lo ach eit ado".split()]
    text = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    counts = {f"l{k}": sum(langid.histogram(text(k, 100)) for _ in range(10)).astype(float) for k in range(4)}
    counts["l4"] = counts["l0"].copy()  # a tie: the first by name wins
    model = langid.Mixture(counts)
    table = model.chance.T.astype(float).tolist()
    for _ in range(40):
        sample = " ".join(text(rng.randrange(4), rng.randint(1, 40)) for _ in range(rng.randint(1, 3)))
        lang, score, found = model.infer(sample)
        want = brute_mixture(table, model.langs, sample)
        assert [k for k, _ in found] == [k for k, _ in want] and lang == want[0][0]
        assert np.allclose([s for _, s in found], [s for _, s in want])
    assert model.infer(text(0, 50))[0] == "l0"


def test_held_out_accuracy(spark, tables):
    got = langid.op9_language_mixture(spark, tables).where("held_out").join(spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "lang"), "doc_id")
    got = got.where("lang IS NOT NULL AND lang_pred != 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got[0] >= 0.99 and got[1] > 100


def test_stage_needs_labels(spark, docs, empty):
    with pytest.raises(ValueError):
        langid.keep_identified(docs.withColumn("lang", F.lit(None).cast("string")))
    assert langid.keep_identified(empty).count() == 0


def test_language_rows(spark, docs, empty):
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx"))
    got = langid.identify(labelled, langid.fold()).collect()
    assert len(got) == docs.count()
    for x in got:
        assert (x.lang_pred == "und") == (x.score == 0)
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2)
    und = {x.doc_id for x in got if x.lang_pred == "und"}
    assert {400, 401, 402, 403, 404} <= und and 1 not in und
    kept = langid.keep_identified(labelled.withColumn("score", F.lit(0)))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and {400, 404}.isdisjoint({x.doc_id for x in kept.collect()})
    assert langid.identify(empty, langid.fold()).count() == 0
    assert {x.lang_pred for x in langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), langid.fold()).collect()} == {"und"}


@pytest.mark.parametrize("doc_id", [1, 2, 3, 4, 5, 6, 7, None])
def test_rows_that_share_an_id_are_drawn_by_their_texts(spark, doc_id):
    """More rows than are learned from, all with one id, or all the same row."""
    rng = random.Random(5)
    rows = [(doc_id, prose(rng, 12), "en") for _ in range(700)]
    counts = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=200)
    whole = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=10_000)
    assert 0.15 < counts["en"].sum() / whole["en"].sum() < 0.45
    same = [(doc_id, "always the same words", "en")] * 3000
    one = langid.learn(spark.createDataFrame(same, "doc_id long, text string, lang string"), per_language=200)
    assert one["en"].sum() == langid.learn(spark.createDataFrame(same[:1], "doc_id long, text string, lang string"))["en"].sum() > 0


# 10 near duplicates

def brute_components(rows, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return Counter((i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows))


def test_components(docs, rows, work):
    got = jaccard_join.Join(clashing(docs), work).result().collect()
    assert Counter(tuple(x) for x in got) == brute_components(rows)


@pytest.mark.parametrize("most", [0, 100_000, 20])
def test_components_in_blocks(spark, work, monkeypatch, most):
    """Chains of edits around the threshold, with small limits so that stars, blocks and rounds all take part."""
    monkeypatch.setattr(jaccard_join, "SMALL_RUN", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "MAX_LAST", most)
    rng = random.Random(5)
    rows, words = [], prose(rng, 90).split()
    shared_lines = prose(rng, 20)
    for i in range(70):
        if i % 5:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = f"e{i}"
        else:
            words = prose(rng, 90).split()
        rows.append((i, shared_lines + " " + " ".join(words)))
    rng.shuffle(rows)
    got = jaccard_join.Join(spark.createDataFrame(rows, "doc_id long, text string"), work).result().collect()
    assert Counter(tuple(x) for x in got) == brute_components(rows)


def test_components_match_all_pairs_of_the_tables(spark, tables):
    """Every pair of documents of the small tables: no link is lost, none is added."""
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    got = jaccard_join.op10_jaccard_components(spark, tables).collect()
    assert Counter(tuple(x) for x in got) == brute_components(rows)


def test_components_with_shared_names(docs, rows, work):
    """Names of ten bits: most sets share one with others and are named anew."""
    got = jaccard_join.Join(docs, work, name_bits=10).result().collect()
    assert Counter(tuple(x) for x in got) == brute_components(rows)


@pytest.mark.parametrize("percent", [50, 90])
def test_links_at_other_percents(spark, work, percent):
    rng = random.Random(percent)
    rows = []
    for g in range(12):
        base = prose(rng, 120, 120).split()
        for k in range(5):
            words = list(base)
            for at in rng.sample(range(120), 2 * k):
                words[at] = f"c{g}x{k}x{at}"
            rows.append((5 * g + k, " ".join(words)))
    got = jaccard_join.Join(spark.createDataFrame(rows, "doc_id long, text string"), work, percent=percent).result().collect()
    want = brute_components(rows, percent)
    assert Counter(tuple(x) for x in got) == want and 12 < len({c for _, _, c in want}) < 60


@pytest.mark.parametrize("percent", [20, 40, 60, 90])
def test_parts_meet_at_any_percent(percent):
    """Sets whose similarity just reaches percent have a common key."""
    rng = np.random.default_rng(percent)
    for size in (3, 15, 16, 60, 63, 250, 255, 900):
        for _ in range(40):
            b = rng.integers(0, 2**64, size, dtype=np.uint64)
            common = -(-size * percent // 100)
            union = common * 100 // percent
            for a in (b[:common], np.concatenate([b[:common], rng.integers(0, 2**64, max(0, union - size), dtype=np.uint64)])):
                assert np.intersect1d(jaccard_join.part_keys(np.unique(a), percent), jaccard_join.part_keys(np.unique(b), percent)).size


def test_sketch_bounds_difference():
    rng = np.random.default_rng(3)
    for size in (1, 5, 100, 3000):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 4 // 5], rng.integers(0, 2**64, size // 4, dtype=np.uint64)]))
        assert jaccard_join.distances([jaccard_join.sketch(a)], [jaccard_join.sketch(b)])[0] <= len(np.setxor1d(a, b))


def test_words_hash_apart():
    words = [f"{a}{b}".encode() for a in range(300) for b in "abcé"]
    assert len(set(hashing.words_at(b" ".join(words))[0].tolist())) == len(set(words))
    one = hashing.words_at(b"alpha \t\n beta")[0]
    assert np.array_equal(one, hashing.words_at(b"  alpha\x0bbeta ")[0])
    text = b"x" * 700_000 + b" mid " + b"y" * 300_000 + b" end"  # words longer than a segment
    found, places = hashing.words_at(text)
    assert places.tolist() == [0, 700_001, 700_005, 1_000_006] and np.array_equal(found[1::2], hashing.words_at(b"mid end")[0])
    assert np.array_equal(hashing.words_at(b"a-b,c", hashing.NO_WORD)[0], hashing.words_at(b"a b c")[0])


def test_one_row_of_each_component_stays(spark, work):
    """Repeated and null ids: near copies, equal rows and unique texts that share an id with a copy."""
    rng = random.Random(17)
    near = [[prose(rng, 60, 60) + f" v{g} {k}" for k in range(3)] for g in range(4)]
    alone = [prose(rng, 60, 60) for _ in range(3)]
    rows = [(1, near[0][0]), (2, near[0][1]), (2, alone[0])]  # id 2: a copy, and a unique text
    rows += [(5, near[1][0])] * 3  # equal rows
    rows += [(None, near[2][0]), (None, near[2][1]), (None, alone[1])]  # null ids
    rows += [(7, near[3][0]), (7, near[3][1]), (None, near[3][2]), (8, alone[2]), (9, None), (9, ""), (9, None)]
    # prose gives another text each call: make the copies near
    base = {t: g for g, some in enumerate(near) for t in some}
    first = {g: some[0].rsplit(" ", 2)[0] for g, some in enumerate(near)}
    rows = [(i, first[base[t]] + " " + t.split(" ")[-1] if t in base else t) for i, t in rows]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, hash int").repartition(3)
    kept = jaccard_join.drop_near_duplicates(docs, work)
    assert kept.columns == docs.columns
    got = kept.collect()
    group = lambda t: next((g for g, f in first.items() if t and t.startswith(f)), None)
    assert Counter(group(x.text) for x in got if group(x.text) is not None) == {0: 1, 1: 1, 2: 1, 3: 1}
    assert {group(x.text): x.doc_id for x in got if group(x.text) is not None} == {0: 1, 1: 5, 2: None, 3: 7}
    assert Counter((x.doc_id, x.text) for x in got if group(x.text) is None) == Counter((i, t) for i, t in rows if group(t) is None)


# empty tables

def test_empty_tables(spark, empty, work, tokenizer):
    index = exact_index.DigestIndex(spark, f"{work}/1")
    nothing = exact_index.digested(empty, f"{work}/1-rows")
    index.add(nothing)
    assert index.resolve(nothing).count() == 0
    token_planes.write_planes(empty, f"{work}/2", tokenizer)
    assert token_planes.read_planes(spark, f"{work}/2").count() == 0
    assert license_join.scan_licenses(empty).count() == 0
    assert line_chunks.dedup_lines(empty, f"{work}/4").count() == 0
    assert bloom_cascade.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "key string"), f"{work}/6").count() == 0
    assert packing.pack_documents(empty, f"{work}/7", tokenizer).count() == 0
    assert sharding.shard_by_bytes(empty, f"{work}/8").count() == 0
    assert jaccard_join.Join(empty, f"{work}/10").result().count() == 0
