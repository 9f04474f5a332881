"""Token-ID output: blocks of ids, transposed into byte or bit planes, each plane compressed with zstandard.

File format of a block: magic `PLN1`, unsigned 32-bit little-endian number of ids, kind (0: byte planes,
1: bit planes) and number of planes as bytes, then 32-bit sizes of the compressed planes and the planes.
Byte planes: plane p holds byte p of each id. Bit planes: plane p holds bit p of each id, packed most
significant bit first. Planes that are zero throughout have size 0.

Documents are ordered by doc_id and cut into ranges ("shards"); each shard's ids form one stream, cut
every `block_ids` ids into blocks. The tables of a written set, below one folder: `blocks` (shard, block,
first = the block's first id's place in the shard, ids, payload, and the chunk index of the documents in
it: docs = [doc_id, ord, at = place in the shard, n]). A document that spans blocks has an entry in each.

Null text counts as empty (just the end id). Rows that share a doc_id, or have none (these come first),
are separate documents, in an order fixed by their text. An empty table writes no block.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm import shared, tokens

BLOCK_IDS = 65_536
BLOCKS = "shard int, block long, first long, ids int, payload binary, docs array<struct<doc_id: bigint, ord: bigint, at: bigint, n: int>>"
MAGIC = b"PLN1"


def pack_block(ids: np.ndarray, kind: str = "byte", level: int = 3) -> bytes:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = [np.ascontiguousarray(raw[:, p]) for p in range(4)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, p]) for p in range(32)]
    packer = zstandard.ZstdCompressor(level=level)
    packed = [packer.compress(p.tobytes()) if p.any() else b"" for p in planes]
    head = MAGIC + struct.pack("<IBB", len(ids), kind == "bit", len(packed)) + struct.pack(f"<{len(packed)}I", *map(len, packed))
    return head + b"".join(packed)


def unpack_block(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token planes")
    count, bit, planes = struct.unpack_from("<IBB", payload, 4)
    sizes = struct.unpack_from(f"<{planes}I", payload, 10)
    at, reader = 10 + 4 * planes, zstandard.ZstdDecompressor()
    raw = np.zeros((count, 4), np.uint8)
    bits = np.zeros((count, 32), np.uint8) if bit else None
    for p, size in enumerate(sizes):
        if size:
            plane = np.frombuffer(reader.decompress(payload[at : at + size]), np.uint8)
            if bit:
                bits[:, p] = np.unpackbits(plane)[:count]
            else:
                raw[:, p] = plane
        at += size
    if bit:
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


def write_planes(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte", block_ids: int = BLOCK_IDS, shards: int | None = None) -> None:
    """Encodes doc_id, text and writes the set's blocks as a table below folder. A task holds one batch and one block."""
    docs = shared.bound_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = docs.repartitionByRange(shards or shared.parts(docs), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, block, first, at, seen = TaskContext.get().partitionId(), 0, 0, 0, 0
        held: list[np.ndarray] = []
        inside: list[dict] = []

        def emit():
            ids = np.concatenate(held)
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "first": first, "ids": len(ids), "payload": pack_block(ids, kind), "docs": inside}], schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("ids", pa.int32()), ("payload", pa.binary()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("ord", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])))])
        for batch in tokens.gathered(batches):
            names = batch.column("doc_id").to_pylist()
            for low, found, edges in tokens.encoder(tokenizer).encode(batch.column("text")):
                for name, begin, end in zip(names[low : low + len(edges) - 1], edges.tolist(), edges[1:].tolist()):
                    while begin < end:
                        some = found[begin : min(end, begin + block_ids - (at - first))]
                        held.append(some)
                        inside.append({"doc_id": name, "ord": seen, "at": at, "n": len(some)})
                        at, begin = at + len(some), begin + len(some)
                        if at - first == block_ids:
                            yield emit()
                            block, first, held, inside = block + 1, at, [], []
                    seen += 1
        if held:
            yield emit()

    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_planes(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the blocks alone.

    Blocks are read apart from each other; what is read from them (a row for each document's part) is a table in
    folder. The offsets of the shards come from their totals (one row each). Documents that touch no edge of
    their block pass through; only the others (two for each block at most) are brought together again.
    """
    import pyarrow as pa

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    totals, start = [], 0
    for shard, ids in sorted(blocks.groupBy("shard").agg(F.sum("ids")).collect()):
        totals.append((shard, start))
        start += ids
    offsets = spark.createDataFrame(totals, "shard int, shard_start long")
    schema = pa.schema([("shard", pa.int32()), ("ord", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("whole", pa.bool_())])

    def pieces(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, out = unpack_block(row["payload"]), []
                for d in row["docs"]:
                    part = ids[d["at"] - row["first"] :][: d["n"]]
                    whole = d["at"] > row["first"] and d["at"] + d["n"] < row["first"] + len(ids)
                    out.append({"shard": row["shard"], "ord": d["ord"], "doc_id": d["doc_id"], "at": d["at"], "n": len(part), "crc": zlib.crc32(part.tobytes()), "whole": whole})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    found = blocks.mapInArrow(pieces, "shard int, ord long, doc_id long, at long, n long, crc long, whole boolean")
    found = shared.stash(found, f"{folder}/parts-{uuid.uuid4().hex[:8]}")
    # a document's number in its shard is unique, so these groups are small
    cut = found.where("not whole").groupBy("shard", "ord").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"))
    crc = F.when(F.size("parts") == 1, F.get(F.col("parts"), F.lit(0))["crc"]).otherwise(F.pandas_udf(joined_crc, "long")(F.transform("parts", lambda p: p["n"]), F.transform("parts", lambda p: p["crc"])))
    cut = cut.select("shard", "doc_id", F.get(F.col("parts"), F.lit(0))["at"].alias("at"), F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("n"), crc.alias("crc"))
    docs = found.where("whole").select("shard", "doc_id", "at", "n", "crc").unionByName(cut).join(F.broadcast(offsets), "shard")
    return docs.select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def crc_shift(crc: int, size: int) -> int:
    """The checksum register after `size` zero bytes, by squaring the one-bit operator over GF(2)."""

    def times(m, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v, i = v >> 1, i + 1
        return out

    op = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    size *= 8
    while size:
        if size & 1:
            crc = times(op, crc)
        op = [times(op, x) for x in op]
        size >>= 1
    return crc


def joined_crc(counts: pd.Series, crcs: pd.Series) -> pd.Series:
    out = []
    for n, c in zip(counts, crcs):
        whole = int(c[0])
        for more, crc in zip(n[1:], c[1:]):
            whole = crc_shift(whole, 4 * int(more)) ^ int(crc)
        out.append(whole)
    return pd.Series(out, dtype="int64")


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared.work_dir(spark, "token-planes")
    write_planes(shared.table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_planes(spark, folder)
