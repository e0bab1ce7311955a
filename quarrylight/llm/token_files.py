"""Token-id files: fixed-size blocks of ids, bit-plane shuffled, each plane compressed with zstandard.

A token file is a folder of Parquet parts, so that it can lie in any store and a lost task leaves no half-written
part. Each row is one block of `BLOCK` ids of one shard (its last block may be shorter): the compressed planes one
after the other, and, as the chunk index, the shard, the block's number in it, its first id's place in the shard,
its ids, the length of every plane, and the documents that begin in it: their ids, places and lengths. Ids are
stored in ascending order of document id over the shards and within them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path
from .tokens import library_encoder

BLOCK = 1 << 16
SCHEMA = (
    "shard int, block int, first long, n_ids int, plane_bits int, plane_bytes array<int>, planes binary, "
    "doc_ids array<long>, doc_first array<long>, doc_tokens array<long>"
)


def to_planes(ids: np.ndarray, plane_bits: int = 8, level: int = 3) -> tuple[bytes, list[int]]:
    """Bit planes (`plane_bits` 1) or byte planes (8) of 32-bit ids, from the lowest; an empty plane is all zero."""
    import zstandard

    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    planes = raw if plane_bits == 8 else [np.packbits((row >> k) & 1, bitorder="little") for row in raw for k in range(8)]
    pack = zstandard.ZstdCompressor(level=level)
    parts = [pack.compress(p.tobytes()) if p.any() else b"" for p in planes]
    return b"".join(parts), [len(p) for p in parts]


def from_planes(planes: bytes, plane_bytes: list[int], n: int, plane_bits: int = 8) -> np.ndarray:
    """The ids that `to_planes` was given."""
    import zstandard

    unpack, raw, at = zstandard.ZstdDecompressor(), np.zeros((4, n), np.uint8), 0
    for k, size in enumerate(plane_bytes):
        if size:
            part = np.frombuffer(unpack.decompress(planes[at : at + size], max_output_size=n), np.uint8)
            if plane_bits == 8:
                raw[k] = part
            else:
                raw[k // 8] |= np.unpackbits(part, count=n, bitorder="little") << (k % 8)
        at += size
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


def _encoder(path: str, end_id: int | None, plane_bits: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), library_encoder(path)
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        held, docs, block, first, place = bytearray(), [], 0, 0, 0

        def row(n: int) -> pa.RecordBatch:
            nonlocal docs, block, first
            planes, sizes = to_planes(np.frombuffer(bytes(held[: 4 * n]), "<u4"), plane_bits)
            mine = [d for d in docs if d[1] < first + n or not n]
            docs = docs[len(mine) :]
            del held[: 4 * n]
            values = [shard, block, first, n, plane_bits, sizes, planes, *([d[k] for d in mine] for k in range(3))]
            block, first = block + 1, first + n
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), *[pa.list_(pa.int64())] * 3]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(texts), 256):
                some = [t or "" for t in texts.slice(lo, 256).to_pylist()]
                for doc_id, raw in zip(ids.slice(lo, 256).to_pylist(), encoder(some)):
                    held += raw + end
                    docs.append((doc_id, place, (len(raw) + len(end)) // 4))
                    place += docs[-1][2]
                    while len(held) >= 4 * BLOCK:
                        yield row(BLOCK)
        if held or docs:
            yield row(len(held) // 4)

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, plane_bits: int = 8, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text, append `end_id`, and write a token file at `path`; returns `path`.

    A null text counts as empty, and so has `end_id` alone. Documents are dealt to shards by ranges of their id,
    null ids first; rows that repeat an id may lie in several shards, in no order among them; repeated rows are each
    written. Very long texts are encoded whole and may fill several blocks. Other columns are not read. An empty table
    gives a file without rows.
    """
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # rows of one id, such as all null ones, are dealt by their text
    dealt = pairs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    dealt.mapInArrow(_encoder(tokenizer, end_id, plane_bits), SCHEMA).write.mode("overwrite").option("compression", "none").parquet(path)
    return path


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a token file without their planes: where each begins and what it holds."""
    return spark.read.schema(SCHEMA).parquet(path).drop("planes")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of shards whose blocks come in order; a document may lie in several blocks."""
    shard, carry, open_docs = None, bytearray(), []
    for batch in batches:
        for r in batch.to_pylist():
            if r["shard"] != shard:
                shard, carry, open_docs = r["shard"], bytearray(), []
            carry += from_planes(r["planes"], r["plane_bytes"], r["n_ids"], r["plane_bits"]).tobytes()
            open_docs += zip(r["doc_ids"], r["doc_first"], r["doc_tokens"])
            done, at = [], 0
            for doc_id, first, n in open_docs:
                if at + 4 * n > len(carry):
                    break
                done.append((doc_id, r["before"] + first, n, bytes(carry[at : at + 4 * n])))
                at += 4 * n
            del carry[:at], open_docs[: len(done)]
            cols = list(zip(*done)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Read a token file back: doc_id, start (ids of all documents before it), n_tokens, ids (32-bit, little-endian).

    The blocks of a shard meet in one task in order, as much as one task wrote; the offsets of the shards are summed
    over one row per shard.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    # one row per shard, that is per task that wrote: small enough to broadcast whatever the corpus holds
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    placed = blocks.join(F.broadcast(starts), "shard")
    return placed.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """Write `docs` as a token file in the shared folder and read it back."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, new_path(spark, "tokens"), tokenizer, end_id))
