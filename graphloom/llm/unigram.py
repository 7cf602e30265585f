"""Token counts under a unigram model, by dynamic programming over a trie.

A pre-token's best segmentation is that of the greatest sum of token scores; a
token's score is the logarithm of its chance.  Distinct pre-tokens of a block
are put into a trie of bytes, level by level; the best score and the number of
tokens up to a node depend only on its path, so each is computed once for all
pre-tokens that begin alike.  Nodes where a pre-token ends keep its count, from
which the texts' counts are summed.  The trie has DEEPEST levels; the few
pre-tokens that are longer are scored one by one, with the same recurrence, in
time that grows with their length.  Distinct pre-tokens are told apart by two
hashes of different seeds.

Chances follow a rule, not training: a token's is in proportion to
1 / (rank + 1).  Of equal scores the segmentation with fewer tokens counts.

Blocks are independent: no shuffle, memory bounded by a block.  Null and empty
texts have no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import SEEDS, _Table, pretokens
from .textblocks import Block, blocks, hash_ranges

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.uint64(0x2545F4914F6CDD1D)
#: Levels of the trie.
DEEPEST = 256
#: Bytes of a longer pre-token whose tokens are looked up at once.
_STRETCH = 1 << 14


class UnigramCounter:
    """Counts tokens of pre-tokens by a vocabulary of ranks with all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        tokens = list(ranks)
        self.longest = max(map(len, tokens))
        self.score = np.array([-np.log(ranks[t] + 1.0) for t in tokens])
        self.powers = np.array([pow(int(_BASE), i, 1 << 64) for i in range(self.longest + 1)], dtype=np.uint64)
        self.offsets = np.array([i * int(_SEED) * pow(int(_BASE), i, 1 << 64) % (1 << 64) for i in range(self.longest + 1)], dtype=np.uint64)
        hashes = np.array([self._hash(t) for t in tokens], dtype=np.uint64)
        # two tokens of one hash would be taken for each other
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two tokens have one hash")
        self.table = _Table(hashes.view(np.int64), np.arange(len(tokens), dtype=np.int32))
        self.by_length = np.bincount([len(t) for t in tokens], minlength=self.longest + 1) > 0

    @staticmethod
    def _hash(token: bytes) -> int:
        h = len(token) * int(_SEED)
        for b in token:
            h = (h * int(_BASE) + b + 1) % (1 << 64)
        return h

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each distinct pre-token given, over one trie of them all."""
        n = len(starts)
        out = np.zeros(n, dtype=np.int64)
        left = np.arange(n)  # pre-tokens that reach the level
        node = np.zeros(n, dtype=np.int64)
        # per level: parent of each node, hash of its path, best score, tokens
        parents: list[np.ndarray] = [np.zeros(1, np.int64)]
        hashes = [np.zeros(1, np.uint64)]
        scores, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
        depth = 0
        while True:
            done = starts[left] + depth == ends[left]
            out[left[done]] = tokens[-1][node[done]]
            left, node = left[~done], node[~done]
            if depth == DEEPEST:
                for i in left.tolist():
                    out[i] = self.long_count(data[starts[i] : ends[i]])
                return out
            if not len(left):
                return out
            byte = data[starts[left] + depth].astype(np.int64)
            child, node = np.unique(node << 8 | byte, return_inverse=True)
            parent, last = child >> 8, (child & 255).astype(np.uint64)
            path = hashes[-1][parent] * _BASE + last + np.uint64(1)
            best, fewest = np.full(len(child), -np.inf), np.zeros(len(child), dtype=np.int64)
            up = parent
            for length in range(1, min(depth + 1, self.longest) + 1):
                if self.by_length[length]:
                    suffix = path - hashes[-length][up] * self.powers[length] + self.offsets[length]
                    found = self.table.get(suffix.view(np.int64))
                    hit = np.flatnonzero(found != 2**31 - 1)
                    total = scores[-length][up[hit]] + self.score[found[hit]]
                    many = tokens[-length][up[hit]] + 1
                    better = (total > best[hit]) | (total == best[hit]) & (many < fewest[hit])
                    best[hit[better]], fewest[hit[better]] = total[better], many[better]
                if length <= depth:
                    up = parents[-length][up]
            parents.append(parent)
            hashes.append(path)
            scores.append(best)
            tokens.append(fewest)
            depth += 1
            if len(parents) > self.longest + 1:  # levels out of any token's reach
                parents[-self.longest - 2] = hashes[-self.longest - 2] = scores[-self.longest - 2] = tokens[-self.longest - 2] = None

    def long_count(self, word: np.ndarray) -> int:
        """Tokens of one pre-token, byte by byte; only the reach of a token is held."""
        reach = self.longest
        score, count = {0: 0.0}, {0: 0}
        path = np.zeros(1, np.uint64)  # hashes of the prefixes that end within reach
        for a in range(0, len(word), _STRETCH):
            part = word[a : a + _STRETCH].astype(np.uint64) + np.uint64(1)
            up = np.full(len(part) + 1, _BASE, dtype=np.uint64)
            up[0] = 1
            up = np.cumprod(up, dtype=np.uint64)
            down = np.full(len(part) + 1, pow(int(_BASE), -1, 1 << 64), dtype=np.uint64)
            down[0] = 1
            down = np.cumprod(down, dtype=np.uint64)
            new = up[1:] * (path[-1] + np.cumsum(part * down[1:], dtype=np.uint64))
            path = np.concatenate([path, new])
            first = a + len(part) + 1 - len(path)  # place of path[0]
            ends_, tokens, sizes = [], [], []
            for length in np.flatnonzero(self.by_length[: reach + 1]).tolist():
                end = np.arange(max(a + 1, first + length), a + len(part) + 1)
                if length and len(end):
                    found = self.table.get((path[end - first] - path[end - length - first] * self.powers[length] + self.offsets[length]).view(np.int64))
                    hit = np.flatnonzero(found != 2**31 - 1)
                    ends_.append(end[hit])
                    tokens.append(found[hit])
                    sizes.append(np.full(len(hit), length))
            end, token, size = (np.concatenate(x) for x in (ends_, tokens, sizes))
            by = np.lexsort((size, end))
            for e, s, x in zip(end[by].tolist(), size[by].tolist(), self.score[token[by]].tolist(), strict=True):
                total, many = score[e - s] + x, count[e - s] + 1
                best = score.get(e)
                if best is None or total > best or total == best and many < count[e]:
                    score[e], count[e] = total, many
            last = a + len(part)
            score, count = ({k: x[k] for k in range(max(0, last - reach), last + 1)} for x in (score, count))
            path = path[-reach - 1 :]
        return count[len(word)]

    def rows(self, block: Block) -> np.ndarray:
        """Tokens of each row of a block."""
        starts, ends, bounds = pretokens(block)
        if not len(starts):
            return np.zeros(block.rows, dtype=np.int64)
        first, second = (hash_ranges(block.data, starts, ends, seed) for seed in SEEDS)
        _, one, inverse = np.unique(first, return_index=True, return_inverse=True)
        each = self.counts(block.data, starts[one], ends[one])[inverse]
        other = np.flatnonzero(second[one][inverse] != second)
        if len(other):  # other texts of the same first hash
            each[other] = self.counts(block.data, starts[other], ends[other])
        return np.diff(np.append(0, np.cumsum(each))[bounds])


_latest: dict = {"ranks": None}


def _counter(shared) -> UnigramCounter:
    if _latest["ranks"] is not shared.value:
        _latest.update(ranks=shared.value, counter=UnigramCounter(shared.value))
    return _latest["counter"]


def count_tokens(df: DataFrame, ranks: dict[bytes, int], text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each text's best segmentation; other columns stay."""
    if out in df.columns:
        raise ValueError(f"column {out} exists already; name another")
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared)
        for batch in batches:
            for block in blocks(batch.column(batch.schema.get_field_index(text))):
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counter.rows(block))], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType(), False)]))
