"""Bloom filters of bounded size, built in tasks; they only screen, an exact join follows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame

PROBES = 2


def sum_blobs(blobs: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: type) -> np.ndarray | None:
    """Arrays of one fixed length, one in each row, merged in tasks and then on the driver."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in frames:
            for x in batch.column(0).to_pylist():
                one = np.frombuffer(zlib.decompress(x), dtype)
                total = one if total is None else merge(total, one)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["blob"])

    total = None
    for r in blobs.toDF("blob").repartition(8).mapInArrow(run, "blob binary").collect():  # 8 arrays of that length
        one = np.frombuffer(zlib.decompress(r.blob), dtype)
        total = one if total is None else merge(total, one)
    return total


def _probes(name: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(name)
    return [(h >> (31 * d)) & (bits - 1) for d in range(PROBES)]


def bloom_of(rows: DataFrame, column: str) -> Broadcast:
    """Of a binary column: at most 32 MB, 16 bits for each row below that."""
    bits = 1 << max(20, min(28, int(16 * max(rows.count(), 1) - 1).bit_length()))

    def mark(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits, bool)
        for batch in frames:
            field[[p for x in batch.column(0).to_pylist() for p in _probes(x, bits)]] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(field).tobytes(), 1)], pa.binary())], names=["blob"])

    blob = sum_blobs(rows.select(column).mapInArrow(mark, "blob binary"), np.bitwise_or, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(zlib.compress((np.zeros(bits // 8, np.uint8) if blob is None else blob).tobytes(), 1))


def may_hold(held: bytes) -> Callable[[bytes], bool]:
    field = np.frombuffer(zlib.decompress(held), np.uint8)
    bits = 8 * len(field)
    table = field.tobytes()
    return lambda name: all(table[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(name, bits))
