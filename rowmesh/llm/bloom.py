"""Bloom filters of a chosen size, over 64-bit hashes: of what a table holds, and of what comes once or more than once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmesh.functions.ranking import input_bytes

#: Fewest and most bits of a filter (64 MB), both powers of two, and bytes of input for each bit between.
FEWEST_BITS, MOST_BITS, BYTES_A_BIT = 1 << 20, 1 << 29, 16
_BLOCK = 8192


def bits_for(df: DataFrame) -> int:
    """A filter's size by the bytes that df reads. A filter that is too small passes more, and never stops what it holds."""
    return min(MOST_BITS, max(FEWEST_BITS, 1 << (input_bytes(df) // BYTES_A_BIT).bit_length()))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(min(bits, 1 << 31) - 1)
    return h & low, h >> np.uint64(32) & low


def passes(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter (bytes) may hold each hash."""
    ok = np.ones(len(h), bool)
    for at in _places(h, 8 * len(held)):
        ok &= (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return ok


def put(held: np.ndarray, h: np.ndarray) -> None:
    for at in _places(h, 8 * len(held)):
        np.bitwise_or.at(held, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


class OnceTwice:
    """Two filters: of hashes that came, and of those that came again."""

    def __init__(self, bits: int):
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, h: np.ndarray) -> None:
        found, n = np.unique(h, return_counts=True)
        put(self.twice, found[(n > 1) | passes(self.once, found)])
        put(self.once, found)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """(block, once, twice) of every block with a bit set."""
        once, twice = self.once.reshape(-1, _BLOCK), self.twice.reshape(-1, _BLOCK)
        used = np.flatnonzero(once.any(axis=1))
        for at in range(0, len(used), 256):
            some = used[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([_packed(x[k]) for k in some], pa.binary()) for x in (once, twice))], ["block", "once", "twice"])


def _packed(block: np.ndarray) -> bytes:
    """A block's set bits as numbers of two bytes, or as they are where that is no longer."""
    n = int(np.bitwise_count(block).sum())
    if 2 * n >= _BLOCK:
        return block.tobytes()
    return np.flatnonzero(np.unpackbits(block, bitorder="little")).astype(np.uint16).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == _BLOCK:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(8 * _BLOCK, np.uint8)
    bits[np.frombuffer(data, np.uint16)] = 1
    return np.packbits(bits, bitorder="little")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, once, twice) in order of block: the bits of each block that came twice in one task, or in two tasks."""
    here, once, twice = -1, None, None
    done: list[tuple[int, bytes]] = []
    for batch in batches:
        for block, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if block != here:
                if here >= 0:
                    done.append((here, _packed(twice)))
                here, once, twice = block, np.zeros(_BLOCK, np.uint8), np.zeros(_BLOCK, np.uint8)
            a, b = _unpacked(a), _unpacked(b)
            twice |= b | once & a
            once |= a
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int32()), pa.array([x for _, x in done], pa.binary())], ["block", "twice"])
            done = []
    if here >= 0:
        yield pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([_packed(twice)], pa.binary())], ["block", "twice"])


def twice_filter(parts: DataFrame, bits: int) -> np.ndarray:
    """The filter of all hashes that came twice, from the blocks(block int, once binary, twice binary) of all tasks; the driver holds `bits` bits."""
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merged, "block int, twice binary").toArrow()
    held = np.zeros((bits // 8 // _BLOCK, _BLOCK), np.uint8)
    for block, data in zip(merged["block"].to_pylist(), merged["twice"].to_pylist()):
        held[block] = _unpacked(data)
    return held.ravel()


def table_filter(table: DataFrame, column: str, bits: int) -> np.ndarray:
    """The filter of a column of hashes (long); the driver holds `bits` bits."""
    low = F.lit(bits - 1).cast("long")
    places = F.array(F.col(column).bitwiseAND(low), F.shiftrightunsigned(column, 32).bitwiseAND(low))
    at = table.select(F.explode(places).alias("at")).select((F.col("at") + 1).alias("at"))
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    held = np.zeros((bits // 32768, 4096), np.uint8)
    for k, part in zip(maps["k"].to_pylist(), maps["bits"].to_pylist()):
        held[k - 1] = np.frombuffer(part, np.uint8)
    return held.ravel()
