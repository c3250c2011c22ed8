"""Token-id output with bit-plane shuffling.

A store is a Parquet dataset of segments in ascending doc_id order. A segment holds whole documents: their ids are cut
into blocks of a fixed number of ids, each block is transposed into byte (or bit) planes, and each plane is compressed
with zstandard by itself. ``chunks`` is the chunk index of a segment: place, ids and compressed bytes of each block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_range, id_splits, map_batches, text_frame, text_partitions
from .tokens import encode_batches, encoding

_CHUNK = pa.struct([("first", pa.int64()), ("n", pa.int32()), ("bytes", pa.int64()), ("crc32", pa.int64())])
_FIELDS = [
    ("shard", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("plane", pa.string()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("chunks", pa.list_(_CHUNK)), ("planes", pa.list_(pa.list_(pa.binary()))),
]
_SCHEMA = (
    "shard int, segment int, start long, n_ids long, plane string, doc_ids array<long>, lengths array<long>, "
    "chunks array<struct<first:long,n:int,bytes:long,crc32:long>>, planes array<array<binary>>"
)


def split_planes(block: bytes, plane: str) -> list[bytes]:
    """Transpose little-endian unsigned 32-bit ids into 4 byte planes or 32 bit planes."""
    rows = np.frombuffer(block, "u1").reshape(-1, 4)
    if plane == "byte":
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int, plane: str) -> bytes:
    if plane == "byte":
        return np.stack([np.frombuffer(p, "u1") for p in planes], axis=1).tobytes()
    bits = np.stack([np.unpackbits(np.frombuffer(p, "u1"), count=n) for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").tobytes()


def write_token_store(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = 16384, segment_ids: int = 1 << 19,
    plane: str = "byte", level: int = 3,
) -> None:
    """Encode every whole text, append ``end_id``, and write the ids in ascending doc_id order to ``path``.

    Texts are shuffled once, into ranges of doc_id (shard numbers ascend); a task holds one segment of about
    ``segment_ids`` ids at a time, or one document where that is longer. Null text: only the end id. Null doc_ids come
    first; rows of one doc_id stay together, ordered by text. An empty table gives an empty store.
    ``tokenizer`` is a file that executors can read. Writing goes through Spark's commit protocol, so lost tasks
    are simply run again.
    """
    parts = text_partitions(docs)
    splits = id_splits(docs, parts)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=level)
        shard, segment, start, ids, held, lengths = 0, 0, 0, [], [], []

        def flush():
            nonlocal segment, start, ids, held, lengths
            data = b"".join(ids)
            chunks, planes = [], []
            for at in range(0, len(data), 4 * block_ids):
                block = data[at : at + 4 * block_ids]
                packed = [pack.compress(p) for p in split_planes(block, plane)]
                chunks.append({"first": at // 4, "n": len(block) // 4, "bytes": sum(map(len, packed)), "crc32": zlib.crc32(block)})
                planes.append(packed)
            row = [shard, segment, start, len(data) // 4, plane, held, lengths, chunks, planes]
            segment, start, ids, held, lengths = segment + 1, start + len(data) // 4, [], [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, _FIELDS)], [n for n, _ in _FIELDS])

        n = 0
        for b in batches:
            who = b.column(0).to_pylist()
            if who:
                shard = b.column(2)[0].as_py()
            for doc, found in zip(who, encode_batches(tokenizer, b.column(1).to_pylist(), end)):
                ids.append(found)
                held.append(doc)
                lengths.append(len(found) // 4)
                n += len(found) // 4
                if n >= segment_ids:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    ordered = (
        text_frame(docs)
        .withColumn("shard", id_range(splits).cast("int"))
        .repartitionById(parts, F.col("shard"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    map_batches(ordered, encoding(tokenizer, run), _SCHEMA).write.parquet(path)


def read_chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """Place and size of every block; the planes themselves aren't read."""
    store = spark.read.schema(_SCHEMA).parquet(path)
    return store.select("shard", "segment", "start", F.posexplode("chunks").alias("block", "c")).select(
        "shard", "segment", "block", (F.col("start") + F.col("c.first")).alias("start"), "c.n", "c.bytes", "c.crc32"
    )


def read_token_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 and, if asked for, ids (array<long>).

    Each segment is decoded by itself. Starts across shards come from the index: one total per shard, a number of rows
    that the writer's partition count bounds.
    """
    store = spark.read.schema(_SCHEMA).parquet(path)
    totals = {r.shard: r.n for r in store.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    base, before = {}, 0
    for shard in sorted(totals):
        base[shard] = before
        before += totals[shard]

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(n)[k].as_py() for n in ("shard", "start", "plane", "doc_ids", "lengths", "chunks", "planes")}
                blocks = []
                for c, packed in zip(row["chunks"], row["planes"]):
                    block = join_planes([unpack.decompress(p) for p in packed], c["n"], row["plane"])
                    if zlib.crc32(block) != c["crc32"]:
                        raise ValueError(f"shard {row['shard']}: a block's checksum doesn't match")
                    blocks.append(block)
                data = b"".join(blocks)
                at = np.concatenate([[0], np.cumsum(row["lengths"], dtype="i8")])
                docs = [data[4 * s : 4 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                cols = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(at[:-1] + (base[row["shard"]] + row["start"]), pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(d) for d in docs], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(d, "<u4").astype("i8") for d in docs], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return map_batches(store, run, schema)
