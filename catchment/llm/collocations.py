"""Phrase collocations: word n-grams that occur together far more often than their parts allow, for each language.

Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`.
All n-grams of 1 to max_n words are exploded into rows (lang, gram, words, count) and hash-aggregated for each
language; the empty gram counts the words. A phrase of two words or more with min_count occurrences is a
candidate. Its counts are joined with those of the parts of each of its cuts, its score is the least
floor(scale * a / (l + r)) of its cuts in Decimal (ties: the first cut). An anti-join takes off candidates that
stand inside a phrase of one word more with drop_percent of their occurrences; longer phrases need no look, as a
phrase between the two occurs at least as often as the longer one. A window ranks what is left, in parts of a
language first.

No phrase occurs more often than its parts, so of the n-grams of three words and more only those are exploded
whose every word pair may have min_count occurrences: the pairs are counted first, and a Bloom filter over the
frequent ones, of a bounded size, goes to the second pass over the texts. It never leaves out a frequent pair;
what it lets through is counted like the rest. Counts are of all texts and exact: equal n-grams are told by
their words, not by hashes. Every Arrow batch counts its own rows first, Spark combines them in the task and
after the shuffle, so a word that is half the corpus is a row for each batch.

Null text counts as empty, null lang as `und`. Repeated rows count as often as they stand. Texts without words
give nothing, an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catchment.llm import shared

BREAK = b"\n"
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 9 + b" ")
#: Bytes of text of one language that are counted together.
SLICE = 4 << 20
MOST_BITS, LEAST_BITS = 28, 16
PARTS = 64
SCHEMA = "lang string, gram string, words int, count long"


class PairFilter:
    """A Bloom filter over (lang, gram): two bits of the 64-bit hash of each, about 16 bits a key, 2 ** MOST_BITS in all at most."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, len(words) * 64 - 1

    @classmethod
    def of(cls, grams: DataFrame) -> PairFilter:
        """Of grams(lang, gram). Bits are set in Spark; the words that have some, 2 ** (MOST_BITS - 6) at most, go to the driver."""
        bits = min(MOST_BITS, max(LEAST_BITS, (16 * grams.count()).bit_length()))
        h = F.xxhash64(F.concat_ws("\n", "lang", "gram"))
        at = F.explode(F.array(*(F.shiftrightunsigned(h, s).bitwiseAND(F.lit((1 << bits) - 1)) for s in (0, 32))))
        rows = grams.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
        words = np.zeros(1 << (bits - 6), np.uint64)
        found = rows.toArrow()
        words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return cls(words)

    def holds(self, lang: str, grams: list[bytes]) -> np.ndarray:
        head = lang.encode() + b"\n"
        h = np.fromiter((xxhash.xxh64_intdigest(head + g, 42) for g in grams), np.uint64, len(grams))
        out = np.ones(len(h), bool)
        for s in (0, 32):
            at = (h >> np.uint64(s)) & np.uint64(self.mask)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def codes(data: bytes) -> tuple[np.ndarray, pa.Array]:
    """A number for each word of data in order, -1 between pieces, and the words by number."""
    tokens = [w for w in data.translate(TABLE).replace(BREAK, b" \n ").split(b" ") if w]
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    breaks = pc.index(coded.dictionary, pa.scalar(BREAK, pa.binary())).as_py()
    return np.where(at == breaks, -1, at), coded.dictionary


def counted(lang: str, data: bytes, first: int, last: int, known: PairFilter | None) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA for the n-grams of first to last words in data; first = 1 adds the empty gram."""

    def rows(grams: pa.Array, n: int, counts: np.ndarray) -> pa.RecordBatch:
        size = len(grams)
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(size, np.int64))), grams.cast(pa.string()), pa.array(np.full(size, n, np.int32)), pa.array(counts, pa.int64())], ["lang", "gram", "words", "count"])

    at, grams = codes(data)
    ids = at  # of the n-gram that begins at each place; -1 for none
    if first == 1:
        yield rows(pa.array([b""], pa.binary()), 0, np.array([(at >= 0).sum()]))
    for n in range(1, last + 1):
        if n > 1:  # a gram is the one that is a word shorter and the next word
            size = len(at) - n + 1
            if size < 1:
                return
            ends = at[n - 1 :]
            ids = np.where((ids[:size] >= 0) & (ends >= 0), ids[:size] * len(words) + ends, -1)
            if n > 2 and known is not None:
                ids[~pairs[n - 2 : n - 2 + size]] = -1  # the other pairs are those of the shorter gram
            there, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
            cut = int(len(there) > 0 and there[0] < 0)
            there, counts, ids = there[cut:], counts[cut:], inverse - cut
            grams = pc.binary_join_element_wise(grams.take(pa.array(there // len(words))), words.take(pa.array(there % len(words))), b" ")
            if n == 2 and known is not None:
                held = known.holds(lang, grams.to_pylist())
                pairs = np.where(ids >= 0, held[ids] if len(held) else False, False)
                ids = np.where(pairs, ids, -1)
        else:
            words = grams
            counts = np.bincount(at[at >= 0], minlength=len(words))
        if n >= first:
            some = counts > 0
            yield rows(grams.filter(pa.array(some)), n, counts[some])


def exploded(docs: DataFrame, first: int, last: int, known: PairFilter | None = None) -> DataFrame:
    """Rows of SCHEMA, each batch's own counts, from docs(lang, text) without nulls."""
    held = docs.sparkSession.sparkContext.broadcast(None if known is None else known.words)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if held.value is None else PairFilter(held.value)
        for batch in found:
            lang, text = batch.column(0), batch.column(1)
            for own in lang.unique().to_pylist():
                parts, size = [], 0
                for t in text.filter(pc.equal(lang, own)):
                    parts.append(t.as_py().encode())
                    size += len(parts[-1])
                    if size >= SLICE:
                        yield from counted(own, BREAK.join(parts), first, last, known)
                        parts, size = [], 0
                if parts:
                    yield from counted(own, BREAK.join(parts), first, last, known)

    return docs.mapInArrow(batches, SCHEMA)


def collocations(docs: DataFrame, work: str, max_n: int = 4, min_count: int = 30, top: int = 2000, drop_percent: int = 80, scale: int = 2_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language of docs(lang, text); work is a folder for small tables."""
    texts = shared.bound_batches(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total = lambda rows: rows.groupBy("lang", "gram", "words").agg(F.sum("count").alias("count")).where((F.col("count") >= min_count) | (F.col("words") == 0))
    frequent = shared.stash(total(exploded(texts, 1, min(2, max_n))), f"{work}/short")
    if max_n > 2:
        known = PairFilter.of(frequent.where("words = 2").select("lang", "gram"))
        longer = shared.stash(total(exploded(texts, 3, max_n, known)), f"{work}/long")
        frequent = frequent.union(longer)
    words = frequent.where("words = 0").select("lang", F.col("count").alias("n"))
    phrases = frequent.where("words > 1").select("lang", F.col("gram").alias("phrase"), "words", F.col("count").alias("a"))

    split = F.split("phrase", " ")
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).withColumn("w", split)
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(frequent.select("lang", F.col("gram").alias(side), F.col("count").alias(name)), ["lang", side])
    score = F.expr(f"cast({scale} AS decimal(18, 0)) * cast(a AS decimal(19, 0)) div (l + r)")
    best = cuts.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = phrases.where("words > 2").withColumn("w", F.split("phrase", " "))
    inside = F.array(F.array_join(F.expr("slice(w, 1, words - 1)"), " "), F.array_join(F.expr("slice(w, 2, words - 1)"), " "))
    extended = longer.select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    weak = (best["lang"] == extended["lang"]) & (best["phrase"] == extended["phrase"]) & (F.expr("cast(b AS decimal(20, 0))") * 100 >= F.expr("cast(a AS decimal(20, 0))") * drop_percent)
    left = best.join(extended, weak, "left_anti").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best_first = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # a language's phrases are ranked in PARTS first, of which no more than top can be among its best
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best_first)
    left = left.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(shared.table(spark, sf_dir, "documents").select("lang", "text"), shared.work_dir(spark, "collocations"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
pieces AS (SELECT id, lang, generate_subscripts(pieces, 1) AS p, regexp_extract_all(unnest(pieces), '[^ \t]+') AS w FROM docs),
placed AS (SELECT id, lang, p, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM pieces),
runs AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM placed WINDOW o AS (PARTITION BY id, p ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, 1 AS k, w1 AS gram, count(*) AS a FROM runs GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, gram, k, a, string_split(gram, ' ') AS w FROM f WHERE k > 1),
keyed AS MATERIALIZED (SELECT lang || ' ' || gram AS key, a FROM f WHERE a >= 30),
cuts AS MATERIALIZED (SELECT lang, gram, a, c, lang || ' ' || array_to_string(w[1:c], ' ') AS lkey, lang || ' ' || array_to_string(w[c + 1:], ' ') AS rkey FROM candidates, range(1, 4) t(c) WHERE c < k),
scored AS (
  SELECT x.lang, x.gram, x.a, x.c, y.a AS l, z.a AS r, ((2000000::HUGEINT * x.a) // (y.a + z.a))::BIGINT AS score
  FROM cuts x JOIN keyed y ON y.key = x.lkey JOIN keyed z ON z.key = x.rkey),
best AS MATERIALIZED (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, c) = 1),
inner_phrases AS MATERIALIZED (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS gram, max(a) AS b FROM candidates, range(1, 5) s(i), range(2, 4) t(n) WHERE n < k AND i + n - 1 <= k GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_phrases USING (lang, gram) WHERE b IS NULL OR 100 * b < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
