"""Removal of word sequences that occur earlier in the corpus.

A window is ``size`` consecutive words of a document.  A word goes if a window
over it starts earlier with the same words: in a smaller document, or earlier
in the same one.

1. The minimiser of a window is its word 8-gram of least hash, the leftmost of
   equal ones.  Equal windows have equal minimisers at the same place, so a
   window can only repeat if its minimiser does.  Every partition makes a
   count-min sketch of its minimisers; the merged sketch never underestimates,
   so no repeated window is lost.
2. Windows whose minimiser is estimated to repeat are sent out, those that
   share a minimiser as one row, and grouped exactly by minimiser and window
   hash, 64 bits each.  Within a task, all but the first of equal windows are
   settled by the same two before anything is sent.  A minimiser that is
   estimated frequent sends its windows one by one, spread by their own hash and
   with the minimiser's as the second, so no task gathers more rows of a
   frequent passage than there are tasks.
3. Runs of windows that start later than an equal one go back to their text.

Two rows with the same key and text are one document: neither is earlier.  A
null key comes before all others.  Null and empty texts have no words.  Other
columns stay as they are.  A saturated sketch would only send more windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch
from .bpe import binary_rows
from .textblocks import Block, blocks, grams, hash_ranges, run_lengths

SIZE, GRAM = 20, 8
#: Estimated repeats from which a minimiser's windows are spread one by one.
FREQUENT = 1024
#: Windows a task holds to settle equal ones among them.
HELD = 1 << 20
CELLS_PER_BYTE = 1.0


def windows(block: Block, size: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """Row, start, hash, minimiser and its place of every window of a block."""
    starts, ends, rows = block.words()
    words = hash_ranges(block.data, starts, ends)
    counts = np.maximum(np.diff(rows) - size + 1, 0)
    if not counts.sum():
        return None
    owner, start = run_lengths(counts)
    at = rows[owner] + start
    small = grams(words, gram)
    span = size - gram + 1
    value, place, width = small, np.arange(len(small)), 1
    while width * 2 <= span:
        value, place = _least(value, place, width)
        width *= 2
    if width < span:
        value, place = _least(value, place, span - width)
    return owner, start, grams(words, size)[at], value[at], place[at]


def _least(value: np.ndarray, place: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    left = value[:-step] <= value[step:]
    return np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Whether each item differs from the one before in any column."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _lost(key: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows start later than one of equal key; columns of ``key`` are lexsorted."""
    by = np.lexsort((start, order, *key))
    head = _heads(*(k[by] for k in key))
    first = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
    out = np.empty(len(by), dtype=bool)
    out[by] = (order[by] != order[first]) | (start[by] != start[first])
    return out


_SENT = "key long, ord long, row long, start int, count int, hashes binary"
_RUNS = "ord long, row long, start int, count int"


def _runs(order: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First item and length of each run of neighbouring starts of one row."""
    head = _heads(order, row)
    head[1:] |= start[1:] != start[:-1] + 1
    first = np.flatnonzero(head)
    return first, np.diff(np.append(first, len(start)))


def repeated_runs(df: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Runs of windows with an equal earlier one: ord, row, start and count.

    ``df`` has the columns ord (long, never null), row (a hash of the row) and text.
    """
    gram = min(gram, size)
    bits = sketch.cell_bits(df, CELLS_PER_BYTE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sketch.Cells(bits)
        for batch in batches:
            for block in blocks(batch.column(0)):
                if (found := windows(block, size, gram)) is not None:
                    owner, _, _, value, place = found
                    yield from cells.add(value[_heads(owner, place)])
        yield from cells.flush()

    counted = sketch.merged(df.select("text").mapInArrow(count, sketch.SCHEMA), lambda n: (sketch.packed(n >= 2), sketch.packed(n >= FREQUENT)), "repeated", "frequent")
    rows = counted.collect()  # two bits a cell, of which there are at most 2 ** MOST_BITS
    none = bytes(1 << (sketch.BLOCK_BITS - 3))
    shared = df.sparkSession.sparkContext.broadcast(
        (sketch.Flags(bits, {r.block: bytes(r.repeated) for r in rows if r.repeated != none}), sketch.Flags(bits, {r.block: bytes(r.frequent) for r in rows if r.frequent != none}))
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, frequent = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def settle() -> Iterator[pa.RecordBatch]:
            order, row, start, window, value, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            lost = _lost((window, value), order, start)
            # settled runs travel on as rows without hashes, spread by their row
            if lost.any():
                o, r, s = order[lost], row[lost], start[lost]
                first, length = _runs(o, r, s)
                yield from rows_out(r[first], o[first], r[first], s[first], length, None)
            keep = ~lost
            order, row, start, window, value, place = (x[keep] for x in (order, row, start, window, value, place))
            if not len(order):
                return
            alone = frequent.test(value)
            head = _heads(order, row, place) | alone
            head[1:] |= (start[1:] != start[:-1] + 1) | alone[:-1]
            first = np.flatnonzero(head)
            length = np.diff(np.append(first, len(order)))
            key = np.where(alone, window, value)[first].view(np.int64)
            yield from rows_out(key, order[first], row[first], start[first], length, (np.where(alone, value, window), first))

        def rows_out(key, order, row, start, length, hashes) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(key), 1 << 14):
                part = slice(i, i + (1 << 14))
                m = len(key[part])
                if hashes is None:
                    binary = binary_rows(np.empty(0, np.uint8), np.zeros(m + 1, dtype=np.int64))
                else:
                    bounds = np.append(0, np.cumsum(length[part])) * 8
                    a = int(hashes[1][i])
                    binary = binary_rows(np.ascontiguousarray(hashes[0][a : a + bounds[-1] // 8]).view(np.uint8), bounds)
                arrays = [pa.array(x[part].astype(t)) for x, t in ((key, np.int64), (order, np.int64), (row, np.int64), (start, np.int32), (length, np.int32))]
                yield pa.RecordBatch.from_arrays([*arrays, binary], names=["key", "ord", "row", "start", "count", "hashes"])

        for batch in batches:
            orders, names = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in blocks(batch.column(2)):
                if (found := windows(block, size, gram)) is None:
                    continue
                owner, start, window, value, place = found
                use = repeated.test(value)
                if use.any():
                    owner = owner[use] + block.first
                    held.append((orders[owner], names[owner], start[use], window[use], value[use], place[use]))
                    n += len(owner)
                    if n >= HELD:
                        yield from settle()
                        n = 0
        if held:
            yield from settle()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # rows come sorted by key
            rest = table.slice(cut)
            if cut:
                yield from later(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from later(rest)

    def later(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        key, order, row, start, length = (table.column(i).to_numpy() for i in range(5))
        column = table.column(5)
        packed = column.chunk(0) if column.num_chunks else pa.array([], pa.binary())
        offsets = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1] if len(packed) else np.zeros(1, np.int32)
        hashes = np.frombuffer(packed.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
        settled = np.diff(offsets) == 0
        owner, place = run_lengths(np.diff(offsets) // 8)
        begin = start[owner] + place
        lost = _lost((hashes, key[owner]), order[owner], begin)
        o, r, s = order[owner][lost], row[owner][lost], begin[lost]
        first, count = _runs(o, r, s) if len(o) else (np.empty(0, np.int64), np.empty(0, np.int64))
        out = [(order[settled], o[first]), (row[settled], r[first]), (start[settled], s[first]), (length[settled], count)]
        arrays = [pa.array(np.concatenate(x).astype(t)) for x, t in zip(out, (np.int64, np.int64, np.int32, np.int32), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["ord", "row", "start", "count"])

    sent = df.select("ord", "row", "text").mapInArrow(send, _SENT)
    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(group, _RUNS)


def _cut(block: Block, runs: list[np.ndarray], size: int, joined: bool) -> tuple[np.ndarray, ...]:
    """Words, removed words, and what is left of each row of a block with its bounds."""
    starts, ends, rows = block.words()
    change = np.zeros(len(starts) + 1, dtype=np.int64)
    for i, run in enumerate(runs):
        if len(run):
            np.add.at(change, rows[i] + run[:, 0], 1)
            np.add.at(change, rows[i] + run[:, 0] + run[:, 1] + size - 1, -1)
    gone = np.cumsum(change)[:-1] > 0
    removed = np.diff(np.append(0, np.cumsum(gone))[rows])
    if joined:
        keep = np.flatnonzero(~gone)
        kept = np.searchsorted(keep, rows)
        length = ends[keep] - starts[keep]
        last = np.zeros(len(keep) + 1, dtype=bool)
        last[kept[1:][np.diff(kept) > 0]] = True
        length = length + ~last[1:]  # the byte behind a word becomes a space
        owner, place = run_lengths(length)
        data = np.append(block.data, np.uint8(32))[starts[keep][owner] + place]
        data[place == (ends - starts)[keep][owner]] = 32
        return np.diff(rows), removed, data, np.append(0, np.cumsum(length))[kept]
    stop = np.append(starts[1:], len(block.data))
    stop[rows[1:][np.diff(rows) > 0] - 1] = block.bounds[1:][np.diff(rows) > 0]
    change = np.zeros(len(block.data) + 1, dtype=np.int64)
    change[starts[gone]] += 1
    np.add.at(change, stop[gone], -1)
    stay = np.cumsum(change)[:-1] == 0
    return np.diff(rows), removed, block.data[stay], np.append(0, np.cumsum(stay))[block.bounds]


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, joined: bool = False) -> DataFrame:
    """The rows with repeated words cut out of their text, and n_words and n_removed (long).

    joined: the words left are joined by single spaces; else white space stays
    as it was, and a text that loses nothing stays the same.  A null text is
    null (with joined: empty).
    """
    if taken := {"n_words", "n_removed", "_ord", "_row", "_runs"} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} exist already")
    rows = df.withColumns({"_ord": F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), "_row": F.xxhash64(F.coalesce(text, F.lit("")))})
    runs = repeated_runs(rows.select(F.col("_ord").alias("ord"), F.col("_row").alias("row"), F.col(text).alias("text")), size)
    runs = runs.groupBy(F.col("ord").alias("_ord"), F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "count")).alias("_runs"))
    both = rows.join(runs, ["_ord", "_row"], "left").select(*df.columns, "_runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = batch.column(batch.num_columns - 1)
            for block in blocks(batch.column(at)):
                part = batch.slice(block.first, block.rows)
                mine = found.slice(block.first, block.rows).to_pylist()
                listed = [np.array([(x["start"], x["count"]) for x in r], dtype=np.int64) if r else np.empty((0, 2), np.int64) for r in mine]
                words, removed, data, bounds = _cut(block, listed, size, joined)
                new = binary_rows(data, bounds).cast(pa.string())
                if not joined and part.column(at).null_count:
                    new = pa.array([None if v is None else x for x, v in zip(new.to_pylist(), part.column(at).to_pylist(), strict=True)], pa.string())
                columns = [*part.columns[:-1], pa.array(words.astype(np.int64)), pa.array(removed.astype(np.int64))]
                columns[at] = new
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "n_words", "n_removed"])

    fields = [*df.schema.fields, T.StructField("n_words", T.LongType(), False), T.StructField("n_removed", T.LongType(), False)]
    return both.mapInArrow(run, T.StructType(fields))
