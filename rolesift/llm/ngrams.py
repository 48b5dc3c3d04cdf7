"""Hashed character n-grams of whole texts, and vectors summed over all partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.common import forget_in_worker

#: Characters of a text that are hashed at once; longer texts go block by block.
BLOCK = 1 << 20
#: Entries of a summed vector in one row.
PIECE = 1 << 14


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, one space before and after it, line ends and tabs as spaces: a word's start and end show in its n-grams."""
    out = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    out[(out >= 9) & (out <= 13)] = 32
    return out


def hashes(chars: np.ndarray, sizes: tuple[int, ...], buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of every n-gram, block by block. buckets is a power of two."""
    most = max(sizes)
    for at in range(0, max(1, len(chars)), BLOCK):
        part = chars[at : at + BLOCK + most - 1]
        for n in sizes:
            # n-grams that start in this block
            count = min(len(part) - n + 1, BLOCK)
            if count <= 0:
                continue
            h = np.full(count, 2166136261 + n, np.uint32)
            for k in range(n):
                h ^= part[k : k + count]
                h *= np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            h ^= h >> np.uint32(13)
            yield h & np.uint32(buckets - 1)


class Distinct:
    """Distinct buckets of a text in linear time, with one array for all texts of a worker."""

    def __init__(self, buckets: int):
        forget_in_worker()
        self.place = np.zeros(buckets, np.int32)
        self.stamp = 0

    def __call__(self, chunks: Iterator[np.ndarray]) -> np.ndarray:
        self.stamp -= 1
        if self.stamp < -(1 << 30):
            self.place[:] = 0
            self.stamp = -1
        out = []
        for h in chunks:
            fresh = h[self.place[h] != self.stamp]
            order = np.arange(len(fresh), dtype=np.int32)
            self.place[fresh] = order
            fresh = fresh[self.place[fresh] == order]
            self.place[fresh] = self.stamp
            out.append(fresh)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


VECTOR_SCHEMA = "piece int, share int, sums binary"

#: Tasks' vectors are first added within so many shares, so that no group holds more than a share of the tasks' pieces.
SHARES = 8


def pieces_of(vector: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of VECTOR_SCHEMA for one partition's int64 vector, without its empty pieces."""
    share = TaskContext.get().partitionId() % SHARES
    keys, values = [], []
    for k in range(0, len(vector), PIECE):
        part = vector[k : k + PIECE]
        if part.any():
            keys.append(k // PIECE)
            values.append(_packed(part))
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([share] * len(keys), pa.int32()), pa.array(values, pa.binary())], names=["piece", "share", "sums"])


def _packed(part: np.ndarray) -> bytes:
    """The numbers as two, four or eight bytes each, and which."""
    most = int(np.abs(part).max())
    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return part.astype(f"<i{size}").tobytes() + str(size).encode()


def _numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x[:-1], f"<i{x[-1:].decode()}")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal pieces that stand one after the other; one vector is held at a time."""
    key, total = None, np.zeros(PIECE, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([_packed(total)], pa.binary())], names=["piece", "share", "sums"])

    for b in batches:
        for piece, share, x in zip(*(b.column(c).to_pylist() for c in ("piece", "share", "sums")), strict=True):
            if (piece, share) != key:
                if key is not None:
                    yield out()
                key, total = (piece, share), np.zeros(PIECE, np.int64)
            part = _numbers(x)
            total[: len(part)] += part
    if key is not None:
        yield out()


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all partitions' vectors, in two steps: within shares of the tasks, then over the shares. The driver gets one vector of a fixed size."""
    added = rows.repartition("piece", "share").sortWithinPartitions("piece", "share").mapInArrow(_added, VECTOR_SCHEMA)
    added = added.withColumn("share", F.lit(0)).repartition("piece").sortWithinPartitions("piece").mapInArrow(_added, VECTOR_SCHEMA)
    out = np.zeros(-(-size // PIECE) * PIECE, np.int64)
    for row in added.toLocalIterator():
        part = _numbers(bytes(row["sums"]))
        out[row["piece"] * PIECE : row["piece"] * PIECE + len(part)] = part
    return out[:size]
