"""Best-fit packing of tokenised documents into sequences of fixed length.

Bounded-space online best-fit.  A fixed number of bins is open at a time; a
bitset keyed by free space says which free spaces have an open bin, so the
best bin for a piece is the lowest set bit at or above its length.  When a new
bin is needed and all are taken, the fullest open bin is closed.  Pieces come
in bounded batches, the longest of a batch first; a piece of full length is a
sequence by itself.

Each input partition is packed by itself, so there is no shuffle, memory does
not grow with the data, and a lost task gives the same sequences again.  A
partition leaves at most its open bins part-filled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import worker_encoder
from .textblocks import blocks

#: Tokens of a sequence.
CAPACITY = 2048
#: Bins open at a time.
OPEN_BINS = 4096
#: Pieces put in order of length before they are packed.
BATCH_PIECES = 1 << 13


class BestFit:
    """Bounded-space best-fit for one stream of pieces."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, first_id: int = 0) -> None:
        self.capacity, self.most = capacity, open_bins
        self.free_bits = 0  # bit f: some open bin has f tokens free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = 0
        self.next_id = first_id

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset for a piece."""
        if length == self.capacity:
            self.next_id += 1
            return self.next_id - 1, 0
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.opened == self.most:  # close the fullest
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, sequence = self.capacity, self.next_id
            self.next_id += 1
        left = free - length
        if left:
            self.by_free[left].append(sequence)
            self.free_bits |= 1 << left
            self.opened += 1
        return sequence, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        sequence = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        self.opened -= 1
        return sequence


def cut(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents: owner, number, start and length; the first one is the short one."""
    count = -(-lengths // capacity)
    owner = np.repeat(np.arange(len(lengths)), count)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    short = (lengths - (count - 1) * capacity)[owner]
    start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
    return owner, piece, start, np.where(piece == 0, short, capacity)


_SCHEMA = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_FIELDS = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def pack_documents(df: DataFrame, ranks: dict[bytes, int], end_id: int = 0, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: its document's key, where it starts there, and its place in a sequence.

    Every document is its ids and then ``end_id``; a null or empty text is the
    end id alone.  Rows with the same key, or a null one, are packed each for
    itself.  Other columns are not read.  Sequence numbers are unique over
    partitions.  ``end_id`` and ranks must fit 32 bits.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary
    rows = df.select(key, text)
    key_type = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, False)
        packer = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 36)
        waiting: list[tuple[pa.Array, np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            keys = pa.concat_arrays([k for k, _ in waiting])
            table = np.concatenate([v for _, v in waiting])
            waiting.clear()
            count = 0
            places = np.empty((len(table), 2), dtype=np.int64)
            place = packer.place
            lengths = table[:, 2].tolist()
            for i in np.argsort(-table[:, 2], kind="stable").tolist():
                places[i] = place(lengths[i])
            columns = [*table.T, *places.T]
            arrays = [pa.array(c.astype(np.int32 if n == "piece" else np.int64)) for c, n in zip(columns, _FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([keys, *arrays], names=[key, *_FIELDS])

        for batch in batches:
            for block in blocks(batch.column(1)):
                flat, bounds = encoder.encode(block)
                # the end id goes behind each document
                n = block.rows
                ids = np.full(len(flat) + n, end_id, dtype="<u4")
                ids[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(bounds))] = flat
                first = bounds[:-1] + np.arange(n)
                owner, piece, start, length = cut(np.diff(bounds) + 1, capacity)
                raw, at = memoryview(ids.view(np.uint8)), first[owner] + start
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((at * 4).tolist(), ((at + length) * 4).tolist(), strict=True)]
                waiting.append((batch.column(0).slice(block.first, n).take(pa.array(owner)), np.stack([piece, start, length, np.array(crc, dtype=np.int64)], axis=1)))
                count += len(owner)
                if count >= BATCH_PIECES:
                    yield from flush()
        if waiting:
            yield from flush()

    return rows.mapInArrow(run, f"`{key}` {key_type}, {_SCHEMA}")
