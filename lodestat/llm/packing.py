"""Packing by power-of-two decomposition.

A document of n tokens becomes n // size pieces of the full size and one piece for each bit of the rest,
longest first. Every piece is a sequence of its own in the bucket of its length, so no sequence crosses documents and none is padded.
Training batches are then drawn from one bucket at a time.

No shuffle is needed: sequence ids hold the bucket (highest bits), the task's partition and a count, so they are
unique and sorted by bucket.

Defined results: a null or empty text has the end id alone. Each row is packed by itself, so repeated rows give
repeated pieces in sequences of their own; a null doc_id is kept. Very long texts give many pieces, in order of ``start``. An
empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words_bpe

PIECES = "doc_id long, start long, length long, ids array<int>, doc_tokens long, bucket int, sequence_id long, offset long"


def lengths(n: int, size: int) -> list[int]:
    """Power-of-two lengths that sum to n, none above size (a power of two)."""
    return [size] * (n // size) + [1 << b for b in range(size.bit_length() - 2, -1, -1) if (n % size) >> b & 1]


def _pieces(it: Iterator[pa.RecordBatch], path: str, end: int, size: int):
    """For each batch: doc_id column, ids, and numpy columns row, start, length, total."""
    coder = words_bpe.load(path)
    for b in it:
        for i, j, ids, at in coder.encode(b.column(1)):
            n = np.diff(at) + 1
            ids = np.insert(ids, at[1:], end)
            cuts = [lengths(int(x), size) for x in n]
            row = np.repeat(np.arange(j - i), [len(c) for c in cuts])
            length = np.fromiter((x for c in cuts for x in c), np.int64, len(row))
            stop = np.cumsum(length)
            yield b.column(0).slice(i, j - i).take(pa.array(row)), ids, (stop - length) - (at[:-1] + np.arange(j - i))[row], length, n[row], stop


class _Numbers:
    """Sequence ids of one task: bucket, partition, count in that bucket."""

    def __init__(self):
        self.base, self.next = TaskContext.get().partitionId() << 33, {}

    def take(self, bucket: np.ndarray) -> np.ndarray:
        out = np.empty(len(bucket), np.int64)
        for b in np.unique(bucket):
            at = np.flatnonzero(bucket == b)
            n = self.next.get(b, 0)
            out[at] = (int(b) << 57) + self.base + n + np.arange(len(at))
            self.next[b] = n + len(at)
        return out


def _digest(ids: np.ndarray, length: np.ndarray, stop: np.ndarray) -> pa.Array:
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(length.tolist(), stop.tolist(), strict=True)], pa.int64())


def _arrays(ids: np.ndarray, length: np.ndarray, stop: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, stop], pa.int32()), pa.array(ids.astype(np.int32)))


def pack(docs: DataFrame, path: str, end: int = 2, size: int = 4096, text: str = "text", digest: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (or, with digest, ids_crc32), doc_tokens, bucket, sequence_id, offset."""
    if size & (size - 1) or size < 1:
        raise ValueError("size must be a power of two")
    make, name, kind = (_digest, "ids_crc32", "ids_crc32 long") if digest else (_arrays, "ids", "ids array<int>")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for doc, ids, start, length, total, stop in _pieces(it, path, end, size):
            bucket = np.log2(length).astype(np.int32)
            yield pa.record_batch(
                [doc, pa.array(start), pa.array(length), make(ids, length, stop), pa.array(total), pa.array(bucket), pa.array(numbers.take(bucket)), pa.array(np.zeros(len(length), np.int64))],
                ["doc_id", "start", "length", name, "doc_tokens", "bucket", "sequence_id", "offset"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, PIECES.replace("ids array<int>", kind))
