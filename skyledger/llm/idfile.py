"""Token ids in a file of fixed-width fields.

The file is a Parquet folder of blocks. A block holds whole texts, in ascending
order of their id, and closes once it has ``BLOCK_IDS`` token ids or more. Each token
id takes the fewest bits that hold every id of the vocabulary; 32 ids fill ``bits``
whole 32-bit words, so a place in the stream is found by arithmetic and any run of
ids is unpacked by a few array operations. A block names its shard, its number, the
ids of the shard before it and the offsets of its texts; shard totals give the
place of every text in the whole stream.

Defined cases: a null or empty text is the end id alone; rows with equal ids follow
each other in the order of their texts; null ids come first; columns besides id and
text are not read; an empty table gives an empty folder that reads as no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm import kernels
from skyledger.llm.store import keep, shared_folder, small
from skyledger.llm.tokens import SLICE, encoders

BLOCK_IDS = 1 << 16
GROUP = 32
SCHEMA = "shard int, block int, before long, n_ids long, bits int, keys array<long>, offsets array<long>, payload binary"


def width(vocabulary: int) -> int:
    """Bits that hold ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    n = -(-len(ids) // GROUP)
    rows = np.zeros((n, GROUP), np.uint64)
    rows.ravel()[:len(ids)] = ids
    words = np.zeros((n, bits + 1), np.uint64)
    for j in range(GROUP):
        w, s = divmod(j * bits, 32)
        value = rows[:, j] << np.uint64(s)
        words[:, w] |= value & np.uint64(0xFFFFFFFF)
        words[:, w + 1] |= value >> np.uint64(32)
    return words[:, :bits].astype("<u4").tobytes()


def unpack_ids(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """``n`` ids from place ``start`` on; reads only the words that hold them."""
    low, high = start // GROUP, -(-(start + n) // GROUP)
    words = np.frombuffer(payload, "<u4", (high - low) * bits, low * bits * 4).reshape(-1, bits).astype(np.uint64)
    words = np.concatenate([words, np.zeros((len(words), 1), np.uint64)], axis=1)
    out = np.empty((len(words), GROUP), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(GROUP):
        w, s = divmod(j * bits, 32)
        out[:, j] = ((words[:, w] | (words[:, w + 1] << np.uint64(32))) >> np.uint64(s)) & mask
    return out.ravel()[start - low * GROUP:start - low * GROUP + n]


def write_ids(docs: DataFrame, tokenizer: str, vocabulary: int, folder: str | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Encode every text and write the blocks to a new folder in the shared one; gives its path."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    bits = width(vocabulary)

    def run(batches):
        from pyspark import TaskContext

        encoder, shard, block, before = encoders(tokenizer), TaskContext.get().partitionId(), 0, 0
        keys, parts, offsets = [], [], [0]

        def close():
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "block": block, "before": before, "n_ids": offsets[-1], "bits": bits, "keys": keys, "offsets": offsets,
                "payload": pack_ids(np.frombuffer(b"".join(parts), "<u4"), bits)}], schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()),
                            ("keys", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])
        for batch in batches:
            for low, _, off in kernels.slices(batch.column(1), SLICE):
                rows = batch.slice(low, len(off) - 1)
                for k, coded in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist())):
                    keys.append(k)
                    parts.append(coded)
                    offsets.append(offsets[-1] + len(coded) // 4)
                    if offsets[-1] >= BLOCK_IDS:
                        yield close()
                        block, before = block + 1, before + offsets[-1]
                        keys, parts, offsets = [], [], [0]
        if keys:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    ordered = rows.repartitionByRange("k").sortWithinPartitions("k", "t")
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(folder)
    return folder


def placed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with ``start``: ids of the whole stream before the block."""
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row for each writing task
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = keep(totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "shards")
    return blocks.join(small(shards), "shard").withColumn("start", F.col("base") + F.col("before"))


def read_texts(spark: SparkSession, folder: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids): each text of the file; ``ids`` as an array, or null if not asked for."""
    names = [key, "start", "n_tokens", "ids_crc32", "ids"]

    def run(batches):
        for batch in batches:
            for bits, keys, offsets, payload, start in zip(*(batch.column(c).to_pylist() for c in range(5))):
                flat = unpack_ids(payload, bits, 0, offsets[-1]).astype("<u4")
                raw = memoryview(flat.tobytes())
                off = np.array(offsets, np.int64)
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(offsets, offsets[1:])]
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat.astype(np.int32))) if ids else pa.nulls(len(keys), pa.list_(pa.int32()))
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(off[:-1] + start), pa.array(np.diff(off)), pa.array(crc, pa.int64()), lists], names=names)

    blocks = placed_blocks(spark, folder).select("bits", "keys", "offsets", "payload", "start")
    return blocks.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def read_text(spark: SparkSession, folder: str, key: int) -> np.ndarray:
    """The ids of one text: the block is found by its keys, and only the text's words are unpacked."""
    row = spark.read.schema(SCHEMA).parquet(folder).where(F.array_contains("keys", key)).select("bits", "keys", "offsets", "payload").first()
    if row is None:
        raise KeyError(key)
    at = row["keys"].index(key)
    return unpack_ids(bytes(row["payload"]), row["bits"], row["offsets"][at], row["offsets"][at + 1] - row["offsets"][at])
