"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Documents are encoded and cut every `length` ids; only the pieces' sizes go on, in a written table. Each
document draws a group from a hash of its row's number, so equal or id-less rows spread too, and the full pieces of
long documents, which fill a sequence each, draw their own; a group holds about `group_pieces` pieces. Inside a group the pieces, longest
first (ties by doc_id and start), each go to the first sequence with room, found in logarithmic time at
the root of a max tree over the capacities left. Each group's last sequence is padded most.

A sequence needs no padding if its ids are a power of two or `length`. Null text counts as empty: just
the end id. Rows that share a doc_id are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm import shared, tokens

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def first_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of the sizes, which must not increase."""
    leaves = 1 << max(0, (len(sizes) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - tree[at]
        tree[at] -= size
        while at > 1:
            at >>= 1
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return bins, offsets


def cut_documents(docs: DataFrame, tokenizer: str, length: int) -> DataFrame:
    """The pieces (PIECES) of every document, and the number `uid` of its row."""

    def cut(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "uid"]
        tokens.trim()
        for batch in tokens.gathered(batches):
            ids, uids = batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist()
            for low, found, edges in tokens.encoder(tokenizer).encode(batch.column("text")):
                code, rows = memoryview(found).cast("B"), []
                for row, (begin, end) in enumerate(zip(edges.tolist(), edges[1:].tolist()), low):
                    for at in range(begin, end, length):
                        stop = min(end, at + length)
                        rows.append((ids[row], at - begin, stop - at, zlib.crc32(code[4 * at : 4 * stop]), end - begin, uids[row]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    rows = shared.bound_batches(docs).select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id())
    return rows.mapInArrow(cut, PIECES + ", uid long")


def pack(pieces: DataFrame, pieces_count: int, length: int = 2048, group_pieces: int = 2048, seed: int = 7) -> DataFrame:
    """pieces (written, so that uid is fixed) with sequence_id and offset."""
    groups = max(1, round(pieces_count / group_pieces))
    own = F.when(F.col("length") == length, F.col("start")).otherwise(-1)
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("uid", own, F.lit(seed)), F.lit(groups)))

    def fill(frame):
        import pyarrow as pa
        import pyarrow.compute as pc

        frame = frame.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("uid", "ascending")])
        bins, offsets = first_fit(frame.column("length").to_numpy(), length)
        ids = pc.add(pc.multiply(frame.column("group"), pa.scalar(1 << 32)), pa.array(bins))
        return frame.drop_columns(["group", "uid"]).append_column("sequence_id", ids).append_column("offset", pa.array(offsets))

    return grouped.groupBy("group").applyInArrow(fill, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, work: str, tokenizer: str, length: int = 2048, group_pieces: int = 2048) -> DataFrame:
    pieces = shared.stash(cut_documents(docs, tokenizer, length), f"{work}/pieces")
    return pack(pieces, pieces.count(), length, group_pieces)


def op7_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, shared.work_dir(spark, "packing"), public_tokenizers.path("word_bpe_49k.json"))
