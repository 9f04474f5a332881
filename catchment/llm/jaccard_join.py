"""N-gram Jaccard join: parity sketches, pigeonholed by size band, then verified.

A document's set is its distinct `width`-word shingles (with fewer words the whole sequence; no words: the
empty set, which links with nothing). Equal sets are one entity. Sets of similarity 0.75 differ in at most
(a + b) / 7 shingles, so after XOR-hashing the shingles of a set into the parts of a sketch, two linked
sets differ in at most that many parts. Each entity lists its parts in an order that all entities share
(fullest first, empty last) and keeps one third of its size plus one; linked entities then keep a common
part. Entities with a common part are candidates; candidates whose bit sketches differ in more bits than
the bound allows are dropped (the Hamming distance never exceeds the difference); the rest are verified on
the whole sets.

A key with few entities gives all its pairs. A larger one gives a star around one of its entities (keys take
turns in which comes first, so a cluster gets several centres), and its members are set down; the stars are verified.
Then the texts that hold a large key with two components list their parts anew, those of such keys last (the
order is again one for all of them), and meet by what they keep now: texts that share a passage with many
others meet by the rest of them. What is still large and split is compared by sketches, in blocks of
bounded size: the members outside of the key's largest component with all others. Each hands on one partner, the
closest of another component that may be a link; after these are verified, the members that still have such a
partner meet with their whole sets, and a task hands on a forest of the links, no more rows than it read.
So no link between components is lost, and no group's pairs are ever made. Keys are combined before the
shuffle: a batch sends one pivot of a large key, and its members go to tasks of their own.

Null text is empty. Rows that share a doc_id are separate documents; a null doc_id never names a
component that has another. Sets have names of 64 bits; sets that share one, found by a second hash, are named
by that, in another pass (a bounded list).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catchment.llm import bloom_cascade, shared, tokens
from catchment.llm.hashing import U, grams, mix, words_at

SMALL_RUN = 32
BLOCK = 2048
MAX_RENAMED = 100_000
#: Large keys whose parts are put last (a sorted array that goes to every task); 0: parts are listed once.
MAX_LAST = 200_000


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words, _ = words_at(text.lower())  # bytes: A-Z only
    return np.unique(grams(words, min(width, len(words)))) if len(words) else words


def entity(found: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of a set."""
    return tuple(int(np.bitwise_xor.reduce(mix(found + U(c))).view(np.int64)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


class Names:
    """The 64-bit name of a set: its first hash, or a mixture of the second for sets (first, second) that share the first with another."""

    def __init__(self, bits: int = 64, renamed: frozenset = frozenset()):
        self.bits, self.renamed = bits, renamed

    def __call__(self, found: np.ndarray) -> tuple[int, int]:
        name, extra = entity(found)
        if self.bits < 64:
            name &= (1 << self.bits) - 1
        if self.renamed and (name, extra) in self.renamed:
            name = int(mix(np.array([extra ^ 0x2545F4914F6CDD1D], np.int64).view(U)).view(np.int64)[0])
        return name, extra


def turn(keys: np.ndarray, ents: np.ndarray) -> np.ndarray:
    """A rank of entities that differs between keys, in one of four ways."""
    return mix(ents ^ ((keys & U(3)) * U(0x9E3779B97F4A7C15)))


def sketch_bits(size):
    """Bits of a set's sketch: a power of two, at least twice its size. Works on arrays too."""
    return 1 << np.maximum(6, np.ceil(np.log2(2.0 * np.maximum(size, 1))).astype(np.int64))


def sketch(found: np.ndarray) -> bytes:
    """Parity of the shingles at each bit; halving the bits by XOR gives the sketch of half the size."""
    bits = int(sketch_bits(len(found)))
    at = (found >> U(20)).astype(np.int64) & (bits - 1)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def fold(words: np.ndarray, to: int) -> np.ndarray:
    """Rows of 64-bit words brought down to `to` words."""
    while words.shape[-1] > to:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def band(size: int) -> int:
    return (size.bit_length() - 1) // 2  # sizes 4^k up to 4^(k+1) - 1


def part_keys(found: np.ndarray, percent: int = 75, last: np.ndarray | None = None, buckets: int = 1) -> np.ndarray:
    """The keys an entity keeps, in its own band and, if larger partners reach into them, the next ones.

    Sets of a and b >= a shingles that reach `percent` have b <= 100 a / percent, so they differ in at most
    (a + b) (100 - percent) / (100 + percent) <= a (100 - percent) / percent shingles: one third of a at 75.
    last: sorted short keys whose parts come last in the order.
    """
    size, out = len(found), []
    for k in range(band(size), band(size * 100 // percent) + 1):
        keep = size * (100 - percent) // percent + 1
        parts = max(16, 2 * 4**k, 4 ** (k + 1) * (100 - percent) // percent + 2)  # more than any set of the band keeps
        at = (found % U(parts)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at, values = at[order], mix(found[order])
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        full = np.diff(np.concatenate([first, [size]]))
        name = at[first].astype(U) * U(64) + U(k)
        keys = mix(np.bitwise_xor.reduceat(values, first) + mix(name))
        rank = (U(3) - np.minimum(full, 3).astype(U)) << U(61) | keys >> U(3)
        if last is not None and len(last):
            rank |= among(last, short(keys, buckets)).astype(U) << U(63)
        if len(keys) > keep:
            keys = keys[np.argpartition(rank, keep - 1)[:keep]]
        elif len(keys) < keep:  # empty parts come last in the order
            empty = np.setdiff1d(np.arange(parts), at[first])
            more = mix(mix(empty.astype(U) * U(64) + U(k)) + U(1))
            keys = np.concatenate([keys, np.sort(more)[: keep - len(keys)]])
        out.append(keys)
    return np.concatenate(out)


def among(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is in a sorted array that isn't empty."""
    return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys


def short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys as their bucket and 32 more bits, the form in which they meet."""
    return (keys // U(buckets)).astype(np.uint32).astype(U) * U(buckets) + keys % U(buckets)


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.concatenate([first, [len(keys)]]))


SHUFFLED = "bucket int, keys binary, entities binary, pivot_keys binary, pivots binary, big_keys binary, members binary, docs binary, sketches binary"
OUT = "kind int, key long, a long, b long, doc_id long, n int, entity long, extra long, text_hash long, sketch binary"


def candidates(docs: DataFrame, buckets: int, width: int, percent: int, name_of: Names, last: np.ndarray | None = None, batch_keys: int = 500_000) -> DataFrame:
    """OUT: kind 0 the documents, 1 candidate pairs a < b, 2 members (a) of large keys. With last: kinds 1 and 2 of the texts that keep one of these keys, by parts listed anew."""

    def spread(batches):
        import pyarrow as pa

        keys, ents, rows, sketches, held = [], [], [], [], 0
        flushed = 0

        def flush():
            nonlocal flushed
            k, e = (np.concatenate(x) if x else np.zeros(0, U) for x in (keys, ents))
            order = np.lexsort((turn(k, e), k))
            k, e = k[order], e[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (e[1:] != e[:-1])]) if len(k) else np.zeros(0, bool)
            k, e = k[new], e[new]
            first, size = runs_of(k)
            big = np.repeat(size > SMALL_RUN, size)
            pivots = first[size > SMALL_RUN]
            names = [c.split()[0] for c in SHUFFLED.split(", ")]
            own_k, own_e, own_cut = dealt(k[~big], e[~big])
            piv_k, piv_e, piv_cut = dealt(k[pivots], e[pivots])
            out = []
            for i in np.flatnonzero((np.diff(own_cut) > 0) | (np.diff(piv_cut) > 0)):
                s, t = slice(own_cut[i], own_cut[i + 1]), slice(piv_cut[i], piv_cut[i + 1])
                out.append((int(i), packed(own_k[s]), own_e[s].tobytes(), packed(piv_k[t]), piv_e[t].tobytes(), b"", b"", b"", b""))
            big_k, big_e = k[big], e[big]
            for i in range(0, len(big_k), 50_000):  # members of large keys go anywhere
                out.append((spot(), b"", b"", b"", b"", big_k[i : i + 50_000].tobytes(), big_e[i : i + 50_000].tobytes(), b"", b""))
            for i in range(0, len(rows), 2_000):
                out.append((spot(), b"", b"", b"", b"", b"", b"", b"".join(rows[i : i + 2_000]), b"".join(sketches[i : i + 2_000])))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if j == 0 else pa.binary()) for j, c in enumerate(zip(*out))], names) if out else None

        def dealt(k, e):
            """Keys and entities ordered by bucket, and where each bucket begins."""
            b = (k % U(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            return k[order], e[order], np.searchsorted(b[order], np.arange(buckets + 1))

        def packed(k):
            return (k // U(buckets)).astype(np.uint32).tobytes()  # 32 bits besides the bucket

        def spot():
            nonlocal flushed
            flushed += 1
            return (flushed * 40503 + seed) % buckets

        seed = 0
        tokens.forget()
        for batch in batches:
            texts, names = tokens.each(batch.column("text")), batch.column("doc_id")
            missing, names = names.is_null().to_pylist(), names.fill_null(0).to_pylist()
            seed = seed or int(batch.num_rows) * 7919 + (names[0] if names else 0)
            for text, name, null, text_hash in zip(texts, names, missing, batch.column("text_hash").to_pylist()):
                found = shingles(text, width)
                ent, check = name_of(found) if len(found) else (0, 0)
                if last is None:
                    rows.append(doc_record(name, null, len(found), ent, check, text_hash))
                    sketches.append(sketch(found))
                if len(found):
                    kept = part_keys(found, percent)
                    if last is not None:
                        if not among(last, short(kept, buckets)).any():
                            continue
                        kept = part_keys(found, percent, last, buckets)
                    keys.append(kept)
                    ents.append(np.full(len(kept), ent, np.int64).view(U))
                    held += len(kept)
                if held >= batch_keys or len(rows) >= 20_000:
                    if (out := flush()) is not None:
                        yield out
                    keys, ents, rows, sketches, held = [], [], [], [], 0
        if (out := flush()) is not None:
            yield out
        keys, ents, rows, sketches = [], [], [], []
        tokens.forget()

    def meet(frame):
        import pyarrow as pa

        bucket = frame.column("bucket")[0].as_py()
        load = lambda c, kind: np.frombuffer(b"".join(x for x in frame.column(c).to_pylist() if x), kind)
        k = np.concatenate([load("keys", np.uint32), load("pivot_keys", np.uint32)]).astype(U)
        e = np.concatenate([load("entities", np.int64), load("pivots", np.int64)])
        flag = np.zeros(len(k), bool)
        flag[len(load("keys", np.uint32)) :] = True
        order = np.lexsort((turn(k, e.view(U)), k))
        k, e, flag = k[order], e[order], flag[order]
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (e[1:] != e[:-1])])) if len(k) else np.zeros(0, np.int64)
        k, e, flag = k[new], e[new], np.logical_or.reduceat(flag, new) if len(new) else flag  # copies in other batches
        first, size = runs_of(k)
        some = size > 1
        large = (size > SMALL_RUN) | (np.logical_or.reduceat(flag, first) if len(k) else False)
        a, b = [], []
        for step in range(1, SMALL_RUN):  # all pairs of small runs, `step` places apart
            at = np.flatnonzero(np.repeat(some & ~large, size))
            at = at[at + step < len(k)]
            at = at[k[at] == k[at + step]]
            a.append(e[at])
            b.append(e[at + step])
        wide = np.repeat(large, size)
        a.append(np.repeat(e[first], size)[wide])
        b.append(e[wide])
        member_key, member = k[wide] * U(buckets) + U(bucket), e[wide]
        # members that a batch set down on their own: star around the batch's pivot
        bk, bm = load("big_keys", np.uint64), load("members", np.int64)
        bf, bs = runs_of(bk)
        a.append(np.repeat(bm[bf], bs))
        b.append(bm)
        member_key, member = np.concatenate([member_key, short(bk, buckets)]).view(np.int64), np.concatenate([member, bm])
        a, b = np.concatenate(a), np.concatenate(b)
        low, high = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([low, high], 1)[low != high], axis=0) if len(low) else np.zeros((0, 2), np.int64)
        members = np.unique(np.stack([member_key, member], 1), axis=0) if len(member) else np.zeros((0, 2), np.int64)
        docs_raw = np.frombuffer(b"".join(x for x in frame.column("docs").to_pylist() if x), DOC)
        ends = np.cumsum(sketch_bits(docs_raw["n"]) // 8)
        flat = b"".join(x for x in frame.column("sketches").to_pylist() if x)
        n, m, d = len(pairs), len(members), len(docs_raw)
        del k, e, flag, order, a, b, low, high, wide, member_key, member
        tokens.forget()
        full = lambda kind, x, y, z: pa.concat_arrays([part if part is not None else pa.nulls(size, kind) for part, size in ((x, d), (y, n), (z, m))])
        longs, ints = pa.int64(), pa.int32()
        return pa.Table.from_arrays(
            [
                pa.array(np.repeat(np.array([0, 1, 2], np.int32), [d, n, m])),
                full(longs, None, None, pa.array(members[:, 0])),
                full(longs, None, pa.array(pairs[:, 0]), pa.array(members[:, 1])),
                full(longs, None, pa.array(pairs[:, 1]), None),
                full(longs, pa.array(docs_raw["doc_id"], mask=docs_raw["null"].astype(bool)), None, None),
                full(ints, pa.array(docs_raw["n"]), None, None),
                full(longs, pa.array(docs_raw["entity"]), None, None),
                full(longs, pa.array(docs_raw["extra"]), None, None),
                full(longs, pa.array(docs_raw["text_hash"]), None, None),
                full(pa.binary(), pa.array([flat[x:y] for x, y in zip(np.concatenate([[0], ends]).astype(int), ends)], pa.binary()), None, None),
            ],
            [c.split()[0] for c in OUT.split(", ")],
        )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(spread, SHUFFLED).groupBy("bucket").applyInArrow(meet, OUT)


DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<i4"), ("entity", "<i8"), ("extra", "<i8"), ("text_hash", "<i8")])


def doc_record(name, null, n, ent, check, text_hash) -> bytes:
    return np.array([(name, null, n, ent, check, text_hash)], DOC).tobytes()


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that differ, over the last axis of arrays of 64-bit words."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Hamming distance of each pair of sketches, the longer one brought down to the shorter one's size."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b)]).reshape(-1, 2)
    for la, lb in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes[:, 0] == la) & (sizes[:, 1] == lb))
        x, y = (np.frombuffer(b"".join([side[i] for i in at]), np.uint64).reshape(len(at), -1) for side in (a, b))
        to = min(la, lb) // 8
        out[at] = hamming(fold(x, to), fold(y, to))
    return out


class Possible:
    """Strays (members outside of the key's largest component) and the members at home in a block: which of them, in different components, may be links."""

    def __init__(self, frame, percent: int):
        self.percent = percent
        self.ent, self.comp, self.n = (frame.column(c).to_numpy() for c in ("entity", "comp", "n"))
        self.stray, self.guest = (frame.column(c).to_numpy().astype(bool) for c in ("stray", "guest"))
        words = [np.frombuffer(x, U) for x in frame.column("sketch").to_pylist()]
        self.width = np.array([len(w) for w in words])
        self.levels = {int(v): np.zeros((len(words), v), U) for v in np.unique(self.width)}
        for v, rows_of in self.levels.items():
            for x in np.flatnonzero(self.width >= v):
                rows_of[x] = fold(words[x], v)

    def pairs(self):
        """For each stray that has some: its place, the places of the others, and the bits in which their sketches differ."""
        n, percent = self.n, self.percent
        home = np.flatnonzero(~self.guest)
        for at in np.flatnonzero(self.guest):
            # two strays meet where the one with the larger name is at home
            to = home[(self.comp[home] != self.comp[at]) & (~self.stray[home] | (self.ent[home] > self.ent[at]))]
            to = to[100 * np.minimum(n[to], n[at]) >= percent * np.maximum(n[to], n[at])]
            bits = np.zeros(len(to), np.int64)
            for v in np.unique(self.width[to]):
                some, low = self.width[to] == v, self.levels[int(min(v, self.width[at]))]
                bits[some] = hamming(low[to[some]], low[at])
            good = bits * (100 + percent) <= (n[to] + n[at]) * (100 - percent)
            if good.any():
                yield at, to[good], bits[good]


def drop_near_duplicates(docs: DataFrame, work: str, **options) -> DataFrame:
    """The rows of docs, all columns, but one row only of each component: that of the smallest doc_id (null after all
    others), by the text's hash where ids are repeated, any one of rows with the same id and text."""
    marks = shared.stash(Join(docs, f"{work}/join", **options).spare(), f"{work}/spare")
    shared.remove(docs.sparkSession, f"{work}/join")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("hash"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    if not marks.where("stays").limit(1).count():
        return rows.join(marks, same, "left_anti").select("row.*")
    rows = rows.join(marks, same, "left").select("row", "hash", "stays")
    tied = Window.partitionBy("row.doc_id", "hash").orderBy("hash")
    one = rows.where("stays").withColumn("place", F.row_number().over(tied)).where("place = 1")
    return rows.where("stays IS NULL").select("row.*").unionByName(one.select("row.*"))


class Join:
    """The state of one join: its written tables, the links found so far and their components."""

    def __init__(self, docs: DataFrame, work: str, percent: int = 75, width: int = 5, name_bits: int = 64):
        if not 0 < percent <= 100:
            raise ValueError(f"percent is {percent}; 1 to 100 are possible")
        self.docs, self.work, self.percent, self.width, self.step = shared.bound_batches(docs).select("doc_id", "text"), work, percent, width, 0
        spark = self.spark = docs.sparkSession
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # about 400 thousand keys a bucket: a word has six bytes and 0.4 keys
        buckets = max(shared.width(spark), size // 6_000_000)
        self.name_of = Names(name_bits)
        while True:
            found = self.keep(candidates(self.docs, buckets, width, percent, self.name_of))
            self.rows = found.where("kind = 0").select("doc_id", "n", "entity", "extra", "text_hash")
            reps = found.where("kind = 0 AND n > 0").groupBy("entity").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("extra").alias("extra"), F.max("extra").alias("high"))
            self.entities = self.keep(reps)
            shared_names = self.entities.where("extra != high").select("entity", F.col("extra").alias("first"))
            clashes = self.rows.where("n > 0").join(F.broadcast(shared_names), "entity").where("extra != first").select("entity", "extra").distinct()
            clashes = frozenset(map(tuple, clashes.limit(MAX_RENAMED + 1).collect())) if shared_names.limit(1).count() else frozenset()
            if not clashes:
                break
            if len(clashes) > MAX_RENAMED:
                raise ValueError(f"more than {MAX_RENAMED} sets share a name")
            self.name_of = Names(name_bits, self.name_of.renamed | clashes)
        self.buckets = buckets
        self.labels = spark.createDataFrame([], "entity long, comp long")
        self.run(found)

    def keep(self, df: DataFrame) -> DataFrame:
        self.step += 1
        return shared.stash(df, f"{self.work}/{self.step}")

    def run(self, found: DataFrame) -> None:
        members = self.meet(found, True)
        named = self.name(members, "entity").groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        sizes = self.keep(named.where("low != high").select("key", "size"))
        total = sizes.agg(F.sum("size")).first()[0] or 0
        last = np.zeros(0, U)
        if MAX_LAST and total:
            large = sizes.where(F.col("size") >= max(SMALL_RUN, -(-total // MAX_LAST))).select("key")  # MAX_LAST at most
            last = np.unique(large.toArrow().column("key").to_numpy().view(U))
        if len(last):
            rest = self.split(members.join(F.broadcast(large), "key", "left_anti"))
            again = self.meet(self.keep(candidates(self.docs, self.buckets, self.width, self.percent, self.name_of, last)), False)
            members = self.split(again).unionByName(rest)
        else:
            members = self.split(members)
        left = self.partners(members)
        ordered = left.select(F.least("entity", "partner").alias("a"), F.greatest("entity", "partner").alias("b"))
        self.verify(self.keep(ordered.distinct()))
        # two members that were of the largest component still are of one, so the strays stay those to test
        members = self.keep(self.name(members.join(left.select("key", "entity").distinct(), ["key", "entity"], "left_semi"), "entity"))
        left = self.partners(members)
        if left.limit(1).count():
            self.close(members.join(left.select("key", "entity").distinct(), ["key", "entity"], "left_semi"))

    def meet(self, found: DataFrame, stars: bool) -> DataFrame:
        """Verifies the pairs of written candidates, stars first if there are many; the members (key, entity) of their large keys."""
        near = self.near(found.where("kind = 1").select("a", "b").distinct())
        if stars:
            self.verify(self.keep(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")))
        self.verify(self.keep(self.apart(near)))
        return found.where("kind = 2").select("key", F.col("a").alias("entity")).distinct()

    def split(self, members: DataFrame) -> DataFrame:
        """Written members (key, entity, comp, size, strays, stray, n, sketch) of the keys that hold two components."""
        named = self.name(members, "entity")
        comps = named.groupBy("key", "comp").agg(F.count("*").alias("own"))
        held = comps.groupBy("key").agg(F.max(F.struct("own", "comp")).alias("main"), F.sum("own").alias("size"), F.count("*").alias("comps")).where("comps > 1")
        held = held.select("key", "main.comp", "size", (F.col("size") - F.col("main.own")).alias("strays")).withColumnRenamed("comp", "main")
        rows = named.join(held, "key").withColumn("stray", F.col("comp") != F.col("main")).drop("main")
        return self.keep(rows.join(self.entities.select("entity", "n", "sketch"), "entity"))

    def blocks(self, members: DataFrame) -> DataFrame:
        """members dealt to (key, i, j): block i of the key's strays (guest) meets block j of its members; about 2 * BLOCK rows at most."""
        guests, homes = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("strays", "size"))
        rows = members.withColumns({"guests": guests, "homes": homes, "hash": F.xxhash64("entity")}).drop("size", "strays")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        home = rows.withColumns({"guest": F.lit(False), "j": F.pmod("hash", "homes").cast("int")}).withColumn("i", every("guests"))
        guest = rows.where("stray").withColumns({"guest": F.lit(True), "i": F.pmod("hash", "guests").cast("int")}).withColumn("j", every("homes"))
        return home.unionByName(guest).drop("guests", "homes", "hash")

    def partners(self, members: DataFrame) -> DataFrame:
        """Written (key, entity, partner): members with a partner in another component that may be a link, the closest one of each block."""
        percent = self.percent

        def test(frame):
            import pyarrow as pa

            ent, near = frame.column("entity").to_numpy(), Possible(frame, percent)
            best, closest = np.full(len(ent), np.iinfo(np.int64).max), np.zeros(len(ent), np.int64)
            for at, to, bits in near.pairs():
                if bits.min() < best[at]:
                    best[at], closest[at] = bits.min(), to[bits.argmin()]
                nearer = bits < best[to]
                best[to[nearer]], closest[to[nearer]] = bits[nearer], at
            some = np.flatnonzero(best < np.iinfo(np.int64).max)
            names = np.full(len(some), frame.column("key")[0].as_py(), np.int64)
            return pa.Table.from_arrays([pa.array(names), pa.array(ent[some]), pa.array(ent[closest[some]])], ["key", "entity", "partner"])

        found = self.blocks(members).groupBy("key", "i", "j").applyInArrow(test, "key long, entity long, partner long")
        return self.keep(found)

    def close(self, members: DataFrame) -> None:
        """Merges the components of all links between members of one key, tested on their whole sets."""
        held = self.sets(members.select("entity").distinct())
        both = self.blocks(members).join(held, "entity")
        percent = self.percent

        def test(frame):
            import pyarrow as pa

            ent, comp, near = frame.column("entity").to_numpy(), frame.column("comp").to_numpy(), Possible(frame, percent)
            found = [np.frombuffer(x, U) for x in frame.column("found").to_pylist()]
            over: dict[int, int] = {}

            def top(x: int) -> int:
                while x in over:
                    x = over[x]
                return x

            links = []
            for at, to, bits in near.pairs():
                for other in to[np.argsort(bits, kind="stable")].tolist():
                    x, y = top(int(comp[at])), top(int(comp[other]))
                    if x != y:
                        common = len(np.intersect1d(found[at], found[other], assume_unique=True))
                        if 100 * common >= percent * (len(found[at]) + len(found[other]) - common):
                            over[x] = y
                            links.append((int(ent[at]), int(ent[other])))
            a, b = zip(*links) if links else ((), ())
            return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        self.merge(self.keep(both.groupBy("key", "i", "j").applyInArrow(test, "a long, b long").distinct()))

    def near(self, pairs: DataFrame) -> DataFrame:
        """Written pairs whose sizes and sketches allow a link."""
        a, b = (self.entities.select(F.col("entity").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
        sizes = 100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")
        both = pairs.join(a, "a").join(b, "b").where(sizes)
        percent = self.percent

        def check(batches):
            import pyarrow as pa

            for batch in batches:
                n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
                bits = distances(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist())
                yield batch.filter(pa.array(bits * (100 + percent) <= n * (100 - percent))).select(["a", "b"])
            tokens.forget()

        return self.keep(both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(check, "a long, b long"))

    def name(self, df: DataFrame, column: str) -> DataFrame:
        names = self.labels.select(F.col("entity").alias(column), F.col("comp").alias("_comp"))
        return df.drop("comp").join(names, column, "left").withColumn("comp", F.coalesce("_comp", column)).drop("_comp")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs of different components."""
        left = self.name(pairs, "a").withColumnRenamed("comp", "comp_a")
        return self.name(left, "b").where("comp != comp_a").select("a", "b")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """entity, found (its shingles as 64-bit integers) of the wanted entities and some others, one row each."""
        wanted = self.keep(self.entities.join(wanted, "entity", "left_semi").select(F.col("rep").alias("key")))
        known = bloom_cascade.Level(wanted, wanted.count(), 0.02, 99, 1 << 23)
        width, name_of = self.width, self.name_of

        def sets(batches):
            import pyarrow as pa

            for batch in batches:
                for low in range(0, batch.num_rows, 256):
                    found = [s for s in (shingles(t, width) for t in tokens.each(batch.column("text").slice(low, 256))) if len(s)]
                    yield pa.RecordBatch.from_arrays([pa.array([name_of(s)[0] for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["entity", "found"])
            tokens.forget()

        held = self.docs.where(known.holds("doc_id")).mapInArrow(sets, "entity long, found binary")
        return held.groupBy("entity").agg(F.first("found").alias("found"))

    def verify(self, pairs: DataFrame) -> None:
        """Merges the components of the written pairs that reach the similarity."""
        if not pairs.limit(1).count():
            return
        held = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("entity")).distinct())
        a, b = (held.select(F.col("entity").alias(c), F.col("found").alias(f"f_{c}")) for c in "ab")
        hot = shared.hot_keys(self.keep(pairs.groupBy("a").count()), "a", "count")  # the centres of large stars
        both = shared.salted_join(pairs.join(b.hint("merge"), "b"), a, "a", hot, F.xxhash64("b"), shared.width(self.spark))
        percent = self.percent

        def check(batches):
            import pyarrow as pa

            for batch in batches:
                keep = []
                for x, y in zip(batch.column("f_a"), batch.column("f_b")):
                    x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
            tokens.forget()

        self.merge(self.keep(both.select("a", "b", "f_a", "f_b").mapInArrow(check, "a long, b long").distinct()))

    def merge(self, linked: DataFrame) -> None:
        """Merges the components of the written links a, b."""
        ends = self.name(linked, "a").withColumnRenamed("comp", "comp_a")
        ends = self.name(ends, "b").select(F.col("comp_a").alias("a"), F.col("comp").alias("b")).where("a != b").distinct()
        merged = components(ends, f"{self.work}/{self.step}-labels").select(F.col("entity").alias("comp"), F.col("comp").alias("to"))
        old = self.labels.join(merged, "comp", "left").select("entity", F.coalesce("to", "comp").alias("comp"))
        new = merged.join(self.labels.select(F.col("entity").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("entity"), F.col("to").alias("comp"))
        self.labels = self.keep(old.unionByName(new))

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every document."""
        named = self.name(self.entities.select("entity", "rep", "copies"), "entity")
        least = self.labels.join(self.entities.select("entity", "rep"), "entity").groupBy("comp").agg(F.min("rep").alias("least"))
        named = self.keep(named.join(least, "comp", "left").select("entity", "copies", F.coalesce("least", "rep").alias("component_id")))
        hot = shared.hot_keys(named, "entity", "copies")
        filled = self.rows.where("n > 0")
        out = shared.salted_join(filled, named, "entity", hot, F.xxhash64("doc_id"), shared.width(self.spark), "left")
        empty = self.rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
        columns = ["doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id"]
        return out.select(*columns).unionByName(empty.select(*columns))


    def spare(self) -> DataFrame:
        """doc_id, text_hash, stays: the rows to drop (stays is false), and those of which one of several equal ones stays."""
        keys = self.rows.where("n > 0").groupBy("doc_id", "text_hash", "entity").agg(F.count("*").alias("n_rows"))
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
        named = self.name(self.entities.select("entity"), "entity")
        own = self.keep(keys.groupBy("entity").agg(F.min(order).alias("least")))
        least = named.join(own, "entity").groupBy("comp").agg(F.min("least").alias("least"))
        named = self.keep(named.join(least, "comp").select("entity", F.col("least.doc_id").alias("best_id"), F.col("least.text_hash").alias("best_hash")))
        hot = shared.hot_keys(self.entities, "entity", "copies")
        found = shared.salted_join(keys, named, "entity", hot, F.xxhash64("doc_id", "text_hash"), shared.width(self.spark))
        best = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_hash") == F.col("best_hash"))
        return found.where(~best | (F.col("n_rows") > 1)).select("doc_id", "text_hash", best.alias("stays"))


def components(links: DataFrame, path: str) -> DataFrame:
    """entity, comp (the smallest entity reachable) by least labels and pointer jumps; every round is written."""
    edges = shared.stash(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{path}-edges")
    labels = shared.stash(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).select(F.col("a").alias("entity"), "comp"), f"{path}-0")
    turn = 0
    while True:
        turn += 1
        seen = edges.join(labels.select(F.col("entity").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        low = labels.join(seen.withColumnRenamed("a", "entity"), "entity").select("entity", F.least("comp", "near").alias("low"), F.col("comp").alias("was"))
        jump = low.join(labels.select(F.col("entity").alias("low"), F.col("comp").alias("far")), "low", "left")
        new = shared.stash(jump.select("entity", F.least("low", F.coalesce("far", "low")).alias("comp"), "was"), f"{path}-{turn}")
        labels = new.select("entity", "comp")
        if not new.where("comp != was").limit(1).count():
            return labels


def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    work = shared.work_dir(spark, "jaccard")
    found = shared.stash(Join(docs, f"{work}/join").result(), f"{work}/found")
    shared.remove(spark, f"{work}/join")
    return found
