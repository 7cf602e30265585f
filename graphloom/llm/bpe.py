"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is cut into pre-tokens, distinct pre-tokens are laid out as rows of
matrices bucketed by length, and each round merges in every row the leftmost
pair of lowest rank.  Pair ranks come from an open-addressing hash table; rows
that have no mergeable pair left are moved out, so matrices shrink as they go.
A pre-token over MATRIX_BYTES is a matrix of one row, in which a round merges
the lowest pair wherever it stands, from the left; that is the same as one
place a round unless a merge makes a lower pair, and then only the leftmost
place is merged.  So very long pre-tokens take a round for each distinct merge.

Encoded pre-tokens are remembered by two hashes of different seeds; one whose
second hash differs from the remembered one is encoded by itself.

The result equals tiktoken's ``encode_ordinary`` with the same ranks and the
usual pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

No shuffle and no state between partitions: a lost task is simply run again.
Null and empty texts give no ids.  Memory is bounded by one block of text plus
a bounded cache of encoded pre-tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textblocks import Block, blocks, hash_ranges, run_lengths

#: Longer rows get a matrix of their own.
MATRIX_BYTES = 256
#: Cells of one matrix.
MATRIX_CELLS = 1 << 20
#: Encoded pre-tokens kept by each worker.
CACHE_PIECES = 1 << 19
#: Of the two hashes of a pre-token.
SEEDS = (1, 0x5851F42D)

_NONE = np.int32(2**31 - 1)
_LETTER, _NUMBER, _WHITE, _OTHER = range(4)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 of the token, a space, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    import regex

    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            table[a : b + 1] = kind
    return table


def _code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)


def pretokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each pre-token and the pre-token bounds of each row."""
    data = block.data
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = _code_points(data)
    n = len(points)
    rows = np.searchsorted(at, block.bounds)
    if not n:
        return at, at, np.zeros(len(rows), dtype=np.int64)
    kind = character_classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[rows] = True
    head = first[:n].copy()
    head[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], n)
    cut = head  # becomes the starts of pre-tokens
    inner = ~first[ends]  # something of the same row follows
    white = (kind[starts] == _WHITE) & inner
    last = ends[white] - 1
    cut[last] = True
    glued = last[points[last] == 0x20] + 1
    cut[glued] = False
    # an apostrophe that starts a pre-token, with letters after it
    quote = inner & (ends - starts == 1) & (points[starts] == 0x27) & cut[starts]
    z = ends[quote]
    run_end = np.append(ends, n)[np.flatnonzero(quote) + 1]
    c = points[z]
    d = points[np.minimum(z + 1, n - 1)]
    letters = kind[z] == _LETTER
    one = letters & np.isin(c, [ord(x) for x in "stmd"])
    two = letters & (run_end - z > 1) & (((c == ord("r")) | (c == ord("v"))) & (d == ord("e")) | (c == ord("l")) & (d == ord("l")))
    for which, size in ((one, 1), (two, 2)):
        cut[z[which]] = False
        more = which & (run_end - z > size)
        cut[z[more] + size] = True
    begin = np.flatnonzero(cut[:n])
    byte = np.append(at, len(data))
    return byte[begin], byte[np.append(begin[1:], n)], np.searchsorted(begin, rows)


class _Table:
    """Open addressing from int64 keys to int32 values, looked up by vectors."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, _NONE, dtype=np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        self.steps = 0
        while len(left):
            self.steps += 1
            free = self.keys[slot[left]] == -1
            winners = left[free]
            _, once = np.unique(slot[winners], return_index=True)
            winners = winners[once]
            self.keys[slot[winners]] = keys[winners]
            self.values[slot[winners]] = values[winners]
            done = np.zeros(len(keys), dtype=bool)
            done[winners] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], _NONE)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


class Encoder:
    """Encodes blocks of text by one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], whole_first: bool = True) -> None:
        self.ranks = ranks
        self.whole_first = whole_first
        size = max(ranks.values(), default=0) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        pairs = [(ranks[t[:i]] << 24 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        flat = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        self.pairs = _Table(flat[:, 0].copy(), flat[:, 1].astype(np.int32))
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        order = [t for t in tokens if t]
        data = np.frombuffer(b"".join(order), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in order])
        begins = ends - [len(t) for t in order]
        self.whole = (*(hash_ranges(data, begins, ends, seed) for seed in SEEDS), np.array([ranks[t] for t in order], dtype=np.int32))
        self._reset()

    def _reset(self) -> None:
        """An empty cache, or one that holds the tokens themselves."""
        hashes, second, ids = self.whole if self.whole_first else (*[np.empty(0, np.uint64)] * 2, np.empty(0, np.int32))
        by = np.argsort(hashes)
        self.known, self.second, self.place, self.count = hashes[by], second[by], by.astype(np.int64), np.ones(len(by), dtype=np.int64)
        self.flat = ids

    # -- merging ---------------------------------------------------------

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs.get(a.astype(np.int64) << 24 | b.astype(np.int64))

    def _merge_matrix(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids left of each row, in a padded matrix, and how many."""
        out, left = np.full_like(ids, -1), sizes.copy()
        row = np.arange(len(ids))
        width = ids.shape[1]
        rank = np.full((len(ids), max(0, width - 1)), _NONE, dtype=np.int32)
        pair = np.arange(width - 1)[None, :] < (sizes - 1)[:, None]
        rank[pair] = self._rank(ids[:, :-1][pair], ids[:, 1:][pair])
        while len(row):
            if rank.shape[1]:
                best = rank.argmin(axis=1)
                low = rank[np.arange(len(row)), best]
            else:
                best, low = np.zeros(len(row), dtype=np.int64), np.full(len(row), _NONE)
            done = low == _NONE
            if done.any():
                out[row[done], : ids.shape[1]] = ids[done]
                keep = ~done
                row, ids, rank, best, low = row[keep], ids[keep], rank[keep], best[keep], low[keep]
                if not len(row):
                    break
            left[row] -= 1
            width = int(left[row].max())
            r = np.arange(len(row))
            ids[r, best] = low
            cols = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, cols + (cols > best[:, None]), axis=1)[:, : max(1, width)]
            cols = np.arange(rank.shape[1] - 1)[None, :]
            rank = np.take_along_axis(rank, cols + (cols > best[:, None]), axis=1)[:, : max(0, width - 1)]
            inside = best < rank.shape[1]
            rank[r[inside], best[inside]] = _NONE
            for near in (best - 1, best):
                ok = np.flatnonzero((near >= 0) & (near + 1 < left[row]))
                rank[ok, near[ok]] = self._rank(ids[ok, near[ok]], ids[ok, near[ok] + 1])
        return out, left

    def merge_long(self, piece: np.ndarray) -> np.ndarray:
        """Ids of one long piece; a round merges the lowest pair at all its places."""
        ids = self.byte_ids[piece]
        rank = self._rank(ids[:-1], ids[1:])
        while len(rank) and (low := rank.min()) != _NONE:
            at = np.flatnonzero(rank == low)
            if len(at) > 1:
                near = np.diff(at)
                if (near == 1).any():  # of overlapping places every second, from the left
                    k = np.arange(len(at))
                    at = at[(k - np.maximum.accumulate(np.where(np.append(True, near != 1), k, 0))) % 2 == 0]
                between = (np.diff(at) == 2).any() and self._rank(np.array([low]), ids[at[:1]])[0] < low
                done = None if between else self._merged(ids, rank, at, low)
                if done is None:
                    at = at[:1]
                else:
                    ids, rank = done
                    continue
            ids, rank = self._merged(ids, rank, at, low, always=True)
        return ids

    def _merged(self, ids: np.ndarray, rank: np.ndarray, at: np.ndarray, low: np.int32, always: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and ranks after merges at some places; none if they make a lower pair."""
        keep = np.ones(len(ids), dtype=bool)
        keep[at + 1] = False
        new = ids[keep]
        place = at - np.arange(len(at))
        new[place] = low
        near = np.concatenate([place - 1, place])
        near = near[(near >= 0) & (near < len(new) - 1)]
        fresh = self._rank(new[near], new[near + 1])
        if not always and (fresh < low).any():
            return None
        stay = np.ones(len(rank), dtype=bool)
        stay[at] = False
        rank = rank[stay]
        rank[near] = fresh
        return new, rank

    def _token(self, i: int) -> bytes:
        a = self.offsets[i]
        return self.bytes[a : a + self.lengths[i]].tobytes()

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and how many each has."""
        size = ends - starts
        counts = np.zeros(len(size), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(size, kind="stable")
        a, stop = 0, int(np.searchsorted(size[order], MATRIX_BYTES, side="right"))
        while a < stop:
            small = int(size[order[a]])
            width = min(MATRIX_BYTES, small + max(1, small // 4) - 1)
            b = min(int(np.searchsorted(size[order], width, side="right")), a + max(1, MATRIX_CELLS // max(1, width)), stop)
            which = order[a:b]
            width = int(size[which].max())
            cell = np.arange(width)[None, :] < size[which][:, None]
            matrix = np.full((len(which), width), -1, dtype=np.int32)
            owner, place = run_lengths(size[which])
            matrix[cell] = self.byte_ids[data[starts[which][owner] + place]]
            ids, left = self._merge_matrix(matrix, size[which])
            counts[which] = left
            parts.append((which, ids[np.arange(ids.shape[1])[None, :] < left[:, None]], left))
            a = b
        for i in order[stop:]:
            ids = self.merge_long(data[starts[i] : ends[i]])
            counts[i] = len(ids)
            parts.append((np.array([i]), ids, np.array([len(ids)])))
        flat = np.empty(int(counts.sum()), dtype=np.int32)
        at = np.cumsum(counts) - counts
        for which, ids, left in parts:
            owner, place = run_lengths(left)
            flat[at[which][owner] + place] = ids
        return flat, counts

    # -- whole texts -----------------------------------------------------

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and the id bounds of each row."""
        starts, ends, rows = pretokens(block)
        if not len(starts):
            return np.empty(0, dtype=np.int32), np.zeros(len(rows), dtype=np.int64)
        flat, counts = self.encode_pieces(block.data, starts, ends)
        return flat, np.append(0, np.cumsum(counts))[rows]

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = (hash_ranges(data, starts, ends, seed) for seed in SEEDS)
        hashes, one, inverse = np.unique(first, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_PIECES:
            self._reset()
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        new = self.known[at] != hashes if len(self.known) else np.ones(len(hashes), dtype=bool)
        if new.any():
            which = one[new]
            which = which[np.argsort(which)]
            flat, counts = self.merge(data, starts[which], ends[which])
            place = len(self.flat) + np.cumsum(counts) - counts
            known = np.concatenate([self.known, first[which]])
            by = np.argsort(known, kind="stable")
            self.known = known[by]
            self.second = np.concatenate([self.second, second[which]])[by]
            self.place = np.concatenate([self.place, place])[by]
            self.count = np.concatenate([self.count, counts])[by]
            self.flat = np.concatenate([self.flat, flat])
            at = np.searchsorted(self.known, hashes)
        place, count, flat = self.place[at][inverse], self.count[at][inverse], self.flat
        other = np.flatnonzero(self.second[at][inverse] != second)
        for i in other.tolist():  # another text of the same first hash
            piece = data[starts[i] : ends[i]]
            one_ = self.ranks.get(piece.tobytes()) if self.whole_first else None
            ids = np.array([one_], dtype=np.int32) if one_ is not None else self.merge(piece, np.zeros(1, np.int64), np.array([len(piece)]))[0]
            place[i], count[i] = len(flat), len(ids)
            flat = np.concatenate([flat, ids])
        owner, k = run_lengths(count)
        return flat[place[owner] + k], count

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows one after the other, and the byte bounds of each row."""
        size = self.lengths[ids]
        owner, place = run_lengths(size)
        return self.bytes[self.offsets[ids][owner] + place], np.append(0, np.cumsum(size))[bounds]


def worker_encoder(shared, whole_first: bool = True) -> Encoder:
    """The encoder of this worker process, made once from broadcast ranks."""
    key = (shared.value, whole_first)
    if _latest.get("key") is None or _latest["key"][0] is not key[0] or _latest["key"][1] != whole_first:
        _latest.update(key=key, encoder=Encoder(key[0], whole_first))
    return _latest["encoder"]


_latest: dict = {"key": None}


def binary_rows(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of the given bytes, cut at the bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _append(df: DataFrame, *names: str) -> T.StructType:
    if taken := set(df.columns) & set(names):
        raise ValueError(f"columns {sorted(taken)} exist already; name others")
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.BinaryType(), False) for n in names)])


def bpe_encode(df: DataFrame, ranks: dict[bytes, int], text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the ids of each text as little-endian unsigned 32-bit integers.

    ``decoded``: name of a further column with the bytes that the ids decode to.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            for block in blocks(batch.column(batch.schema.get_field_index(text))):
                flat, bounds = encoder.encode(block)
                extra = [binary_rows(flat.astype("<u4").view(np.uint8), bounds * 4)]
                if decoded:
                    extra.append(binary_rows(*encoder.decode(flat, bounds)))
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, ids, *([decoded] if decoded else [])])

    return df.mapInArrow(run, _append(df, ids, *([decoded] if decoded else [])))


def bpe_decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that each row of little-endian 32-bit ids stands for; null ids give none."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [np.frombuffer(x or b"", dtype="<u4") for x in part.column(part.schema.get_field_index(ids)).to_pylist()]
                bounds = np.append(0, np.cumsum([len(x) for x in rows]))
                data, cuts = encoder.decode(np.concatenate(rows).astype(np.int64), bounds)
                yield pa.RecordBatch.from_arrays([*part.columns, binary_rows(data, cuts)], names=[*part.schema.names, decoded])

    return df.mapInArrow(run, _append(df, decoded))
