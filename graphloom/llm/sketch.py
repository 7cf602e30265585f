"""Count-min sketches built in partitions and merged by blocks of cells.

A partition sends only the cells it touched, so small partitions send little;
blocks are merged in sorted streams, so no task holds more than one block.
What reaches the driver is the merged result, whose size has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BITS = 16
#: Items held by a task before their cells are sent.
HELD = 1 << 21
#: Bounds of the number of cells: at most 64 MB of bits reach the driver.
LEAST_BITS, MOST_BITS = 16, 29

SCHEMA = "block int, cells binary"


def cell_bits(df: DataFrame, cells_per_byte: float, most: int = MOST_BITS) -> int:
    """Cells, as a power of two, in proportion to the planned size of the input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(most, max(LEAST_BITS, int(np.ceil(np.log2(max(1.0, size * cells_per_byte))))))


class Cells:
    """Counts of one partition on their way out."""

    def __init__(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((hashes >> self.shift).astype(np.uint32))
        self.held += len(hashes)
        if self.held >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        cells, counts = np.unique(np.concatenate(self.parts), return_counts=True)
        self.parts, self.held = [], 0
        block = (cells >> BLOCK_BITS).astype(np.int32)
        low = (cells & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
        bounds = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
        # gaps between cells and counts, low bytes apart from high ones, so that they compress
        gaps = np.diff(low, prepend=np.uint16(0))
        gaps[bounds[:-1]] = low[bounds[:-1]]
        counts = np.minimum(counts, 0xFFFF).astype(np.uint16)
        planes = [x.astype(np.uint8).tobytes() for x in (gaps, gaps >> 8, counts, counts >> 8)]
        rows = [b"".join(p[a:b] for p in planes) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(block[bounds[i : min(len(rows), i + 1024)]]), pa.array(rows[i : i + 1024], pa.binary())], names=["block", "cells"])


def _unpacked(cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(cells, dtype=np.uint8).reshape(4, -1).astype(np.int64)
    return np.cumsum(planes[0] | planes[1] << 8), planes[2] | planes[3] << 8


def merged(cells: DataFrame, summary, *names: str) -> DataFrame:
    """One row per touched block: its number and what ``summary(counts)`` gives, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << BLOCK_BITS, dtype=np.int64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([x], pa.binary()) for x in summary(total))], names=["block", *names])

        for batch in batches:
            for block, cells_ in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if block != now:
                    if now is not None:
                        yield row()
                    now, total = block, np.zeros(1 << BLOCK_BITS, dtype=np.int64)
                at, times = _unpacked(cells_)
                total[at] += times
        if now is not None:
            yield row()

    return cells.repartition("block").sortWithinPartitions("block").mapInArrow(run, ", ".join(["block int", *(f"{n} binary" for n in names)]))


class Flags:
    """A bit for each cell, in blocks; blocks that are not there have none set."""

    def __init__(self, bits: int, blocks: dict[int, bytes]) -> None:
        self.bits, self.blocks = bits, blocks
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return self.bits, self.blocks

    def __setstate__(self, state) -> None:
        self.bits, self.blocks = state
        self._table = None

    def test(self, hashes: np.ndarray) -> np.ndarray:
        if not self.blocks:
            return np.zeros(len(hashes), dtype=bool)
        if self._table is None:
            place = np.full(1 << max(0, self.bits - BLOCK_BITS), -1, dtype=np.int64)
            place[list(self.blocks)] = np.arange(len(self.blocks))
            self._table = place, np.frombuffer(b"".join(self.blocks.values()), dtype=np.uint8)
            self.blocks = {0: b""}
        place, data = self._table
        cell = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        block, low = place[cell >> BLOCK_BITS], cell & ((1 << BLOCK_BITS) - 1)
        return (block >= 0) & ((data[np.maximum(block, 0) * (1 << (BLOCK_BITS - 3)) + (low >> 3)] >> (low & 7).astype(np.uint8)) & 1).astype(bool)


def packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()
