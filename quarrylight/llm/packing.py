"""Packing by power-of-two decomposition.

Each document is cut into pieces whose lengths are powers of two: as many full ones as it holds, then the binary
digits of what is left, largest first. Every piece is a sequence of its own, so no sequence crosses documents and
none is padded; sequences of equal length form a bucket, from which batches of equal length are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import library_encoder

LONGEST = 2048
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"


def lengths(counts: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the pieces of documents of so many ids, one document after the other, and how many pieces each has.

    `longest` is a power of two. A document has as many pieces of it as it holds, and one of each smaller power of two
    that is a binary digit of the rest.
    """
    powers = np.arange(longest.bit_length() - 2, -1, -1)
    digits = (counts[:, None] % longest >> powers) & 1
    repeats = np.concatenate([counts[:, None] // longest, digits], 1)
    sizes = np.concatenate([[longest], 1 << powers])
    return np.repeat(np.tile(sizes, len(counts)), repeats.ravel()), repeats.sum(1)


def pieces(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    size = lengths(np.array([n]), longest)[0]
    return list(zip((np.cumsum(size) - size).tolist(), size.tolist()))


def _packer(path: str, end_id: int | None, longest: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library_encoder(path), b"" if end_id is None else end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                coded = encoder([t or "" for t in part.column(1).to_pylist()])
                counts = np.fromiter((len(raw) + len(end) for raw in coded), np.int64, len(coded)) // 4
                size, cut = lengths(counts, longest)
                of = np.repeat(np.arange(len(counts)), cut)  # the document of each piece
                stops = np.cumsum(size)
                begin = stops - size
                # pieces follow one another as the ids do: the documents' bytes are cut by offsets alone
                held = b"".join([raw + end for raw in coded])
                offsets = np.concatenate([[0], 4 * stops]).astype(np.int64)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
                cols = [
                    part.column(0).take(pa.array(of)), begin - (np.cumsum(counts) - counts)[of], size, ids.cast(pa.binary()),
                    counts[of], np.log2(size).astype(np.int32), sequence + np.arange(len(size)), np.zeros(len(size), np.int64),
                ]
                sequence += len(size)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])

    return pack


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = None, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (32-bit, little-endian), doc_tokens, bucket, sequence_id, offset.

    `bucket` is the binary logarithm of the length. `sequence_id` is the number of the task that made the piece,
    times 2**40, plus the piece's number there: unique, and the same when a task is run again; `offset` is 0, as a
    sequence holds one piece. A null text counts as empty: with `end_id` it is one piece of length 1, without it has
    none. Repeated rows are packed each, a null id is kept. Other columns are not read. No shuffle: a hot source or
    a very long text is read whole and costs only the task that reads it. An empty table gives none.
    """
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pairs.mapInArrow(_packer(tokenizer, end_id, longest), SCHEMA)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences with a folder for each length, for a loader that batches equal lengths."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)
