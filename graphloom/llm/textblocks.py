"""Vectorised word and n-gram hashing over Arrow string columns.

All functions work on the UTF-8 bytes of a column.  Words are maximal runs of
bytes outside the ASCII white space set, i.e. ``[^\\x20\\x09-\\x0D]+``; those
bytes never occur inside a multi-byte UTF-8 sequence, so byte runs and
code-point runs are the same words.

Hashes are 64-bit and seeded.  A word's is a sum of avalanche steps over its
8-byte pieces, each with a key of its place; a run of words is hashed by a tree
of avalanche steps.  Neither is a polynomial, whose values collide for texts of
two alternating letters whatever the seed.  Hashes are deterministic over
processes and machines; equal hashes are not proof of equal texts, so users
that need certainty compare a second hash of another seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; larger single rows are still handled whole.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_GRAM = _U(0xD6E8FEB86659FD93)
_PIECE = _U(0x2545F4914F6CDD1D)
#: What remains of an 8-byte piece with so many bytes.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=_U)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(h: np.ndarray) -> np.ndarray:
    """Avalanche step: every input bit changes about half the output bits."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each byte range."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    piece = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the 8 bytes from each place on
    pieces = max(1, -(-int(size.max(initial=1)) // 8))
    keys = mix64(np.arange(1, pieces + 1, dtype=_U) * _PIECE + _U(seed))
    total = mix64((piece[starts] & _MASK[np.minimum(size, 8)]) ^ keys[0])
    long = np.flatnonzero(size > 8)
    if len(long):
        count = (size[long] - 1) >> 3
        owner, place = run_lengths(count)
        place += 1
        rest = np.minimum(size[long][owner] - 8 * place, 8)
        more = np.append(_U(0), np.cumsum(mix64((piece[starts[long][owner] + 8 * place] & _MASK[rest]) ^ keys[place]), dtype=_U))
        end = np.cumsum(count)
        total[long] += more[end] - more[end - count]
    return mix64(total + size.astype(_U) * _U(0xA0761D6478BD642F))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring word hashes, over document bounds too."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=_U)
    if n == 1:
        return mix64(words)
    out: np.ndarray | None = None
    done, level, width = 0, words, 1
    while True:
        if n & width:
            part = level[done : done + m]
            out = part if out is None else mix64(out * _GRAM + part)
            done += width
        if width * 2 > n:
            return out
        level = mix64(level[: len(level) - width] * _GRAM + level[width:])
        width *= 2


@dataclass
class Block:
    """Some rows of a batch: their bytes, row bounds and the index of the first row."""

    first: int
    data: np.ndarray
    bounds: np.ndarray  # row i is data[bounds[i]:bounds[i + 1]]

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and the word bounds of each row."""
        n = len(self.data)
        inside = np.zeros(n + 2, dtype=bool)
        np.logical_not(_SPACE[self.data], out=inside[1:-1])
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.bounds] = True
        here, before = inside[1:], inside[:-1]
        starts = np.flatnonzero(here[:n] & (~before[:n] | cut[:n]))
        ends = np.flatnonzero(before[1:] & (~here[1:] | cut[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint8)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return bounds, np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)


def blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's rows in blocks of about ``limit`` bytes; a row is never cut."""
    bounds, data = column_bytes(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1)
        j = min(j, n, i + 65536)
        part = data[bounds[i] : bounds[j]]
        yield Block(i, _LOWER[part] if lower else part, bounds[i : j + 1] - bounds[i])
        i = j


def run_lengths(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner of each of sum(counts) items and its place within the owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, place
