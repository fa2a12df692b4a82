"""Token ids in files of fixed-width bit-packed blocks.

A file set is a folder of two Parquet tables, so that any store Spark writes to will do
and a task that fails leaves nothing behind:

``blocks``    one row a block, ordered by (shard, block): ``start`` is the number of ids of
              the shard before it (the block offset), ``n_ids``, the ids and lengths of the
              documents in it, and ``data``: b"TLB1", one byte of width, then the ids with
              ``width`` bits each, low bits first, eight ids to ``width`` bytes.
``manifest``  one row a shard: the number of ids before it (``base``).

A document lies whole in one block. Id number k of a block begins at bit ``k * width``,
so any range is read by slicing the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import prepare_workers
from .tokens import encoder

MAGIC = b"TLB1"
BLOCK_IDS = 65_536

BLOCKS = "shard int, block int, start long, n_ids int, doc_ids array<long>, doc_lengths array<int>, data binary"
MANIFEST = "shard int, base long"


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits (1 to 32) an id."""
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.reshape(-1)[:len(ids)] = ids
    out = np.zeros((len(groups), width), np.uint8)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        v = groups[:, j] << np.uint64(shift)
        for k in range(-(-(shift + width) // 8)):
            out[:, byte + k] |= (v >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, width: int, first: int, count: int) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of packed data, without touching the others."""
    if count <= 0:
        return np.zeros(0, np.uint32)
    lo, hi = first // 8, -(-(first + count) // 8)
    groups = np.frombuffer(data, np.uint8, (hi - lo) * width, lo * width).reshape(-1, width)
    out = np.empty((hi - lo, 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        v = np.zeros(len(groups), np.uint64)
        for k in range(-(-(shift + width) // 8)):
            v |= groups[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (v >> np.uint64(shift)) & mask
    return out.reshape(-1)[first - lo * 8:][:count]


def _open(data: bytes) -> tuple[int, bytes]:
    if data[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    return data[4], memoryview(data)[5:]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents (doc_id, text) in ascending doc_id order under ``path``.

    ``end_id`` follows each document; a null or empty text is that id alone. Null ids come
    first; rows of equal id are ordered by a hash of the text, and rows that agree in both
    are the same to any reader. An empty table gives empty files. The sort's range bounds
    keep rows of one id apart by text, so no id makes a partition large.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    end = np.uint32(end_id).astype("<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        width = max(enc.id_bits, int(end_id).bit_length(), 1)
        block, start, n, doc_ids, lengths, held = 0, 0, 0, [], [], []

        def row() -> pa.RecordBatch:
            data = MAGIC + bytes([width]) + pack(np.frombuffer(b"".join(held), "<u4"), width)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([n], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([lengths], pa.list_(pa.int32())), pa.array([data], pa.binary())],
                names=["shard", "block", "start", "n_ids", "doc_ids", "doc_lengths", "data"])

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4 + 1)
                held += [ids, end]
                n += lengths[-1]
                if n >= block_ids:
                    yield row()
                    block, start, n, doc_ids, lengths, held = block + 1, start + n, 0, [], [], []
        if n:
            yield row()

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                           F.xxhash64("text").alias("tie"))
               .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie"))
    (ordered.select("doc_id", "text").mapInArrow(blocks, BLOCKS)
     .write.option("compression", "none").parquet(f"{path}/blocks"))
    # One row a shard goes through this window.
    shards = _blocks(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = F.sum("n").over(W.orderBy("shard")) - F.col("n")
    shards.select("shard", base.alias("base")).write.parquet(f"{path}/manifest")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def _based(spark: SparkSession, path: str) -> DataFrame:
    return _blocks(spark, path).join(spark.read.schema(MANIFEST).parquet(f"{path}/manifest"), "shard")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids are bytes of unsigned 32-bit
    little-endian numbers, start counts the ids of all documents before it."""
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n_ids, doc_ids, lengths, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                width, packed = _open(data)
                ids = memoryview(unpack(packed, width, 0, n_ids).astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + at, pa.int64()),
                     pa.array(lengths, pa.int64()),
                     pa.array([bytes(ids[s * 4:e * 4]) for s, e in zip(starts, ends)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    prepare_workers(spark)
    return (_based(spark, path)
            .select((F.col("base") + F.col("start")).alias("at"), "n_ids", "doc_ids", "doc_lengths", "data")
            .mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary"))


def read_range(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """(start, ids) of the ids numbered ``first`` to ``first + count`` of the whole file set,
    by block; only the blocks that hold them are read, and only their bytes in the range unpacked."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n_ids, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                lo, hi = max(first - at, 0), min(first + count - at, n_ids)
                width, packed = _open(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at + lo], pa.int64()),
                     pa.array([unpack(packed, width, lo, hi - lo).astype("<u4").tobytes()], pa.binary())],
                    names=["start", "ids"])

    at = F.col("base") + F.col("start")
    return (_based(spark, path).where((at < first + count) & (at + F.col("n_ids") > first))
            .select(at.alias("at"), "n_ids", "data").mapInArrow(cut, "start long, ids binary"))
