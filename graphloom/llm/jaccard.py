"""Near duplicates: the grouped prefix join of word n-gram sets, and its components.

A document's set is its distinct word shingles; two documents link when 100
times the common shingles are at least ``percent`` times those of either.

1. Shingles are put in one order for all documents: by how frequent a merged
   count-min sketch estimates them to be, then by hash.  Linked sets share a
   shingle within their first n - ceil(percent * n / 100) + 1, their prefix.
   Any order is right; this one puts shingles of one document first, which need
   not be sent, and keeps boilerplate out of prefixes.
2. Documents with identical prefixes and set size are one group, which is posted
   once, under each shingle of its prefix.  Groups that share a shingle meet
   under the least of them; of those, only runs of sizes that can link go on.
3. Pairs of groups are filtered: by size, and by the prefixes.  Of two prefixes,
   the one that ends first in the order has all its common shingles within the
   other, so their number and what lies behind that prefix bound the common
   shingles of the sets.  A large meeting is filtered in tiles spread over tasks.
4. Groups connected by pairs that pass, with their members, are a cluster.  The
   classes of equal sets in it, one text of each, are verified on the whole sets.
   A cluster over a tile is first held against one class, of which it has most
   copies; what links to that is connected and needs no pairs of its own, and
   only the rest is verified against all, in tiles spread over tasks.

Sets are compared by 64-bit shingle hashes, classes by 128 bits.  Nothing is
capped or sampled, and no pairs of a group are sent, only links that span it.
An empty or null text has no set, and links to nothing; a text with fewer words
than a shingle has its whole word sequence as the only one.  Null keys (and
-2 ** 63, their stand-in) take no part in the smallest key of a component.
Repeated rows are one class.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from .components import components
from .shared import Scratch
from .textblocks import Block, blocks, grams, hash_ranges, mix64, run_lengths

#: Cells of the sketch that orders shingles, for each byte of input, and most of them, as a power of two.
CELLS_PER_BYTE, MOST_BITS = 2.0, 28
#: Groups or classes, and shingles of them, that one tile holds.
TILE_CLASSES, TILE_SHINGLES = 512, 1 << 20
#: Texts that a task remembers to have sent.
SEEN = 1 << 20
#: Columns of one dense product, and pairs counted at once.
_WIDTH, _PAIRS = 4096, 1 << 21

_U = np.uint64
_NO_KEY = -(2**63)


class ShingleSets:
    """Distinct shingle hashes of the rows of a block: ``values[bounds[i]:bounds[i + 1]]``, ascending."""

    def __init__(self, block: Block, size: int) -> None:
        starts, ends, rows = block.words()
        words = hash_ranges(block.data, starts, ends)
        counts = np.diff(rows)
        full = np.maximum(counts - size + 1, 0)
        owner, place = run_lengths(full)
        all_grams = grams(words, size)
        owners, values = [owner], [all_grams[rows[owner] + place] if len(owner) else np.empty(0, _U)]
        for k in range(1, size):  # texts shorter than a shingle
            short = np.flatnonzero(counts == k)
            if len(short):
                owners.append(short)
                values.append(mix64(grams(words, k)[rows[short]] + _U(k)))
        owner, value = np.concatenate(owners), np.concatenate(values)
        by = np.lexsort((value, owner))
        owner, value = owner[by], value[by]
        head = np.ones(len(owner), dtype=bool)
        head[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        self.owner, self.values = owner[head], value[head]
        self.bounds = np.searchsorted(self.owner, np.arange(block.rows + 1))
        self.counts = np.diff(self.bounds)
        total = [np.append(_U(0), np.cumsum(mix64(self.values ^ _U(s)), dtype=_U)) for s in (0x51ED2701, 0xC2B2AE3D27D4EB4F)]
        self.first, self.second = (mix64(t[self.bounds[1:]] - t[self.bounds[:-1]] + self.counts.astype(_U)) for t in total)


class _Order:
    """How frequent shingles are estimated to be: 0 in one document at most, 1 in more, then in powers of two."""

    def __init__(self, bits: int, flags: sketch.Flags, cells: np.ndarray, levels: np.ndarray) -> None:
        self.bits, self.flags, self.cells, self.levels = bits, flags, cells, levels

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        rank = self.flags.test(hashes).astype(np.uint8)
        if len(self.cells):
            cell = (hashes >> _U(64 - self.bits)).astype(np.int64)
            at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
            rank += np.where(self.cells[at] == cell, self.levels[at], 0).astype(np.uint8)
        return rank


def _summary(counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Cells counted twice, and the few that stand out from what is usual in their block, with levels."""
    usual = float(np.median(counts))
    over = (counts - usual - 4 * usual**0.5) / 8
    high = np.flatnonzero(over >= 1)
    return sketch.packed(counts >= 2), high.astype(np.uint16).tobytes(), (1 + np.log2(over[high])).astype(np.uint8).tobytes()


def _order(docs: DataFrame, size: int):
    """The broadcast order of shingles: two bits or so for each cell, at most 2 ** MOST_BITS of them."""
    bits = sketch.cell_bits(docs, CELLS_PER_BYTE, MOST_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sketch.Cells(bits)
        for batch in batches:
            for block in blocks(batch.column(0), lower=True):
                yield from cells.add(ShingleSets(block, size).values)
        yield from cells.flush()

    found = sketch.merged(docs.select("text").mapInArrow(count, sketch.SCHEMA), _summary, "twice", "high", "levels").collect()
    found.sort(key=lambda r: r.block)
    none = bytes(1 << (sketch.BLOCK_BITS - 3))
    flags = sketch.Flags(bits, {r.block: bytes(r.twice) for r in found if r.twice != none})
    high = [np.frombuffer(bytes(r.high), np.uint16).astype(np.int64) | r.block << sketch.BLOCK_BITS for r in found]
    levels = [np.frombuffer(bytes(r.levels), np.uint8) for r in found]
    order = _Order(bits, flags, np.concatenate([*high, np.empty(0, np.int64)]), np.concatenate([*levels, np.empty(0, np.uint8)]))
    return docs.sparkSession.sparkContext.broadcast(order)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _common(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many values each two of some sets have in common, as a matrix."""
    n = len(bounds) - 1
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    new = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))[shared]
    column = new[column][shared]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    width = int(column[-1]) + 1 if len(column) else 0
    size = np.bincount(column, minlength=width)
    if (size.astype(np.int64) ** 2).sum() <= _PAIRS:  # few enough to count pairs
        first = np.cumsum(size) - size
        i, place = run_lengths(size[column])
        return np.bincount(owner[i] * n + owner[first[column[i]] + place], minlength=n * n).reshape(n, n)
    common = np.zeros((n, n), dtype=np.float32)
    for a in range(0, width, _WIDTH):
        i, j = np.searchsorted(column, (a, a + _WIDTH))
        dense = np.zeros((n, min(_WIDTH, width - a)), dtype=np.float32)
        dense[owner[i:j], column[i:j] - a] = 1
        common += dense @ dense.T
    return common.astype(np.int64)


def _spanning(link: np.ndarray) -> np.ndarray:
    """Least member of each one's component."""
    label = np.arange(len(link))
    link = link | np.eye(len(link), dtype=bool)
    while True:
        new = np.where(link, label[None, :], len(link)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _by_job(handle: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """Hands on the rows of one job after the other; rows come sorted by their first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                yield from handle(held[0] if len(held) == 1 else pa.concat_batches(held))
                held.clear()

        for batch in batches:
            job = batch.column(0).to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, job[1:] != job[:-1])), len(job)) if len(job) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if held and held[-1].column(0)[0].as_py() != job[a]:
                    yield from done()
                held.append(batch.slice(a, b - a))
        yield from done()

    return run


def _once(batch: pa.RecordBatch, *names: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the first of equal ones, and which of those each row equals."""
    _, once, same = np.unique(np.stack([batch.column(i).to_numpy() for i in names], axis=1), axis=0, return_index=True, return_inverse=True)
    return once, same.ravel()


def _tiles(m: Column, s: Column) -> Column:
    return F.greatest(F.ceil(m / TILE_CLASSES), F.ceil(s / TILE_SHINGLES)).cast("int")


def _crossed(df: DataFrame, job: str, left: Column, strips: str, tiles: str, columns: list[str]) -> DataFrame:
    """Rows marked left against all rows, in jobs of a strip of the first and a tile of the second."""
    spread = df.withColumn("spread", F.xxhash64(job, *(c for c in columns if c in ("g", "h", "c1", "c2"))))

    def side(rows: DataFrame, own: str, other: str, is_left: bool) -> DataFrame:
        mine, every = F.pmod("spread", F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        rows = rows.withColumn("mine", mine).withColumn("every", every)
        strip, tile = ("mine", "every") if is_left else ("every", "mine")
        return rows.select(F.xxhash64(job, strip, tile).alias("job"), *columns, F.lit(is_left).alias("left"), F.lit(not is_left).alias("right"))

    return side(spread.where(left), strips, tiles, True).unionByName(side(spread, tiles, strips, False))


# -- groups ----------------------------------------------------------------------

_GROUP = ["g", "h", "n", "rank", "last", "prefix"]


def _filter(percent: int):
    """From rows of job, g, h, n, rank, last, prefix, left, right to links that span what passes in each job."""

    def handle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        once, same = _once(batch, 1, 2)
        if len(once) < 2:
            return
        sides = [np.bincount(same, batch.column(i).to_numpy(zero_copy_only=False)) > 0 for i in (7, 8)]
        part = batch.take(pa.array(once))
        g, n, rank = (part.column(i).to_numpy() for i in (1, 3, 4))
        n, last = n.astype(np.int64), part.column(5).to_numpy().view(_U)
        lists = part.column(6)
        common = _common(lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy())))
        ends_first = (rank[:, None] < rank[None, :]) | (rank[:, None] == rank[None, :]) & (last[:, None] <= last[None, :])
        behind = -(-percent * n // 100) - 1  # shingles after the prefix
        most = common + np.where(ends_first, behind[:, None], behind[None, :])
        passes = (common > 0) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
        passes &= (100 + percent) * most >= percent * (n[:, None] + n[None, :])
        pair = sides[0][:, None] & sides[1][None, :]
        label = _spanning(passes & (pair | pair.T))
        moved = np.flatnonzero(label != np.arange(len(label)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(g[moved]), pa.array(g[label[moved]])], names=["u", "v"])

    return _by_job(handle)


def _candidate_links(groups: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between groups that span all pairs which pass the filters."""
    posts = groups.select(F.explode("prefix").alias("shingle"), "g", "n")
    heads = posts.groupBy("shingle").agg(F.min("g").alias("head"), F.max("g").alias("other")).where("head <> other").select("shingle", "head")
    # sizes that differ by two buckets or more cannot link
    bucket = F.floor(F.log("n") / (math.log(100 / percent) * 1.0001)).cast("int")
    members = scratch.written(posts.join(heads, "shingle").select("head", "g", "n", bucket.alias("bucket")).distinct(), "members")
    sizes = members.groupBy("head", "bucket").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    # a head has as many buckets as there are powers of 100 / percent among sizes
    steps = sizes.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("bucket", "m", "s"))).alias("all"))
    begin = F.expr("CAST(array() AS array<struct<low:int,high:int,m:bigint,s:bigint>>)")

    def grow(runs: Column, x: Column) -> Column:
        last = F.element_at(runs, -1)
        joined = F.struct(last.low.alias("low"), x.bucket.alias("high"), (last.m + x.m).alias("m"), (last.s + x.s).alias("s"))
        alone = F.struct(x.bucket.alias("low"), x.bucket.alias("high"), x.m.alias("m"), x.s.alias("s"))
        near = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1)).high + 1 >= x.bucket)
        return F.when(near, F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(runs, F.array(alone)))

    runs = steps.select("head", F.explode(F.aggregate("all", begin, grow)).alias("run")).where("run.m > 1")
    tiles = _tiles(F.col("run.m"), F.col("run.s") * (100 - percent) / 100)
    jobs = runs.select("head", F.col("run.low").alias("low"), tiles.alias("tiles"), F.explode(F.sequence("run.low", "run.high")).alias("bucket"))
    meets = scratch.written(members.join(jobs, ["head", "bucket"]).select(F.xxhash64("head", "low").alias("meeting"), "tiles", "g"), "meets")
    met = meets.join(groups.select(*_GROUP), "g")
    both = (F.lit(True).alias("left"), F.lit(True).alias("right"))
    todo = met.where("tiles = 1").select(F.col("meeting").alias("job"), *_GROUP, *both)
    if not meets.where("tiles > 1").isEmpty():
        todo = todo.unionByName(_crossed(met.where("tiles > 1"), "meeting", F.lit(True), "tiles", "tiles", _GROUP))
    return todo.repartition("job").sortWithinPartitions("job").mapInArrow(_filter(percent), "u long, v long")


# -- members ---------------------------------------------------------------------

_MEMBER = ["c1", "c2", "text"]
_LABEL = "c1 long, c2 long, root string, component_id long"


def _names(first: np.ndarray, second: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in zip(first.view(_U).tolist(), second.view(_U).tolist(), strict=True)]


def _name(a: str, b: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _sets_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of some texts one after the other, and their bounds."""
    sets = [ShingleSets(block, size) for block in blocks(texts, lower=True)]
    return np.concatenate([s.values for s in sets]), np.append(0, np.cumsum(np.concatenate([s.counts for s in sets])))


def _links(texts: pa.Array, size: int, percent: int) -> np.ndarray:
    values, bounds = _sets_of(texts, size)
    common, n = _common(values, bounds), np.diff(bounds)
    return 100 * common >= percent * (n[:, None] + n[None, :] - common)


def _label(size: int, percent: int):
    """From rows of cluster, c1, c2, text, key to each class's component, which lies within its cluster."""

    def handle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        once, _ = _once(batch, 1, 2)
        if len(once) < 2:
            return
        part = batch.take(pa.array(once))
        label = _spanning(_links(part.column(3), size, percent))
        keys = part.column(4)
        known = keys.is_valid().to_numpy(zero_copy_only=False)
        least = np.full(len(once), np.iinfo(np.int64).max)
        np.minimum.at(least, label[known], keys.drop_null().to_numpy())
        some = np.bincount(label[known], minlength=len(once)) > 0
        names = np.array(_names(part.column(1).to_numpy(), part.column(2).to_numpy()))
        lowest = pa.array(least[label], mask=~some[label])
        yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(names[label].tolist(), pa.string()), lowest], names=["c1", "c2", "root", "component_id"])

    return _by_job(handle)


def _tile_links(size: int, percent: int):
    """From rows of job, c1, c2, text, left, right to links that span each job."""

    def handle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        once, same = _once(batch, 1, 2)
        if len(once) < 2:
            return
        sides = [np.bincount(same, batch.column(i).to_numpy(zero_copy_only=False)) > 0 for i in (4, 5)]
        part = batch.take(pa.array(once))
        pair = sides[0][:, None] & sides[1][None, :]
        label = _spanning(_links(part.column(3), size, percent) & (pair | pair.T))
        moved = np.flatnonzero(label != np.arange(len(label)))
        if len(moved):
            names = _names(part.column(1).to_numpy(), part.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in x], pa.string()) for x in (moved, label[moved])], names=["u", "v"])

    return _by_job(handle)


def _large_clusters(members: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Components of clusters over a tile: by one class of each first, then the rest against all, by tiles."""
    pivot = members.groupBy("cluster").agg(F.max(F.struct("copies", "c1", "c2")).alias("p")).select("cluster", F.col("p.c1").alias("c1"), F.col("p.c2").alias("c2"))
    pivots = members.join(pivot, ["cluster", "c1", "c2"]).select("cluster", F.col("c1").alias("p1"), F.col("c2").alias("p2"), F.col("text").alias("ptext")).dropDuplicates(["cluster", "p1", "p2"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = []
                for j, cluster in enumerate(part.column(0).to_pylist()):
                    if cluster != of:
                        of, (at, _) = cluster, _sets_of(part.column(6).slice(j, 1), size)
                    mine, _ = _sets_of(part.column(3).slice(j, 1), size)
                    common = len(np.intersect1d(mine, at, assume_unique=True))
                    found.append(100 * common >= percent * (len(mine) + len(at) - common))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (0, 1, 2, 4, 5)), pa.array(found, pa.bool_())], names=["cluster", "c1", "c2", "p1", "p2", "near"])

    held = members.select("cluster", "c1", "c2", "text").join(pivots, "cluster").select("cluster", "c1", "c2", "text", "p1", "p2", "ptext")
    star = scratch.written(held.mapInArrow(near, "cluster long, c1 long, c2 long, p1 long, p2 long, near boolean"), "stars")
    links = star.where("near").select(_name("c1", "c2").alias("u"), _name("p1", "p2").alias("v"))
    rest = star.where("NOT near").select("cluster", "c1", "c2").distinct()
    strips = rest.join(members.select("c1", "c2", "n").distinct(), ["c1", "c2"]).groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    strips = strips.select("cluster", _tiles(F.col("m"), F.col("s")).alias("strips"))
    if not strips.isEmpty():
        marked = members.join(strips, "cluster").join(rest.withColumn("rest", F.lit(True)), ["cluster", "c1", "c2"], "left")
        jobs = _crossed(marked, "cluster", F.col("rest").isNotNull(), "strips", "tiles", _MEMBER)
        links = links.unionByName(jobs.repartition("job").sortWithinPartitions("job").mapInArrow(_tile_links(size, percent), "u string, v string"))
    nodes = components(links)
    found = members.select("c1", "c2", "key").distinct().withColumn("node", _name("c1", "c2")).join(nodes, "node")
    lowest = found.groupBy("root").agg(F.min("key").alias("component_id"))
    return found.select("c1", "c2", "root").distinct().join(lowest, "root").select("c1", "c2", "root", "component_id")


def _row_flags(rows: DataFrame):
    """Broadcast bits for rows of key and row; a bit too many only sends a text too many."""
    bits = sketch.cell_bits(rows, CELLS_PER_BYTE, MOST_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sketch.Cells(bits)
        for batch in batches:
            yield from cells.add(_row_hashes(batch))
        yield from cells.flush()

    found = sketch.merged(rows.mapInArrow(count, sketch.SCHEMA), lambda n: (sketch.packed(n > 0),), "there").collect()  # a bit a cell
    return rows.sparkSession.sparkContext.broadcast(sketch.Flags(bits, {r.block: bytes(r.there) for r in found}))


def _row_hashes(batch: pa.RecordBatch) -> np.ndarray:
    key, row = (batch.column(i).to_numpy().view(_U) for i in range(2))
    return mix64(row ^ mix64(key))


def _flagged(df: DataFrame, flags, there: bool, once: bool = False) -> DataFrame:
    """Rows whose first two columns, long and never null, are flagged, or those that are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = flags.value.test
        seen: set[int] = set()
        for batch in batches:
            hashes = _row_hashes(batch)
            use = np.flatnonzero(test(hashes) == there)
            if once:  # a repeated row is sent once
                use = np.array([i for i, h in zip(use.tolist(), hashes[use].tolist(), strict=True) if h not in seen and not seen.add(h)], dtype=np.int64)
                if len(seen) > SEEN:
                    seen.clear()
            if len(use):
                yield batch.take(pa.array(use))

    return df.mapInArrow(run, df.schema)


def _identified(df: DataFrame, key: str, text: str) -> list[Column]:
    """What tells rows apart: the key, with a stand-in for null, and a hash of the text."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("_k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_row")]


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """key, row (hash of the text), n_shingles, component_id and root of every row.

    root names the component; it is null for a document that shares no shingle
    of its prefix with any other, which is alone.
    """
    scratch = Scratch(df.sparkSession)
    docs = df.select(*_identified(df, key, text), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = _order(docs, size)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = order.value
        for batch in batches:
            for block in blocks(batch.column(2), lower=True):
                sets = ShingleSets(block, size)
                n = sets.counts
                most = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                rank = rank_of(sets.values)
                by = np.lexsort((sets.values, rank, sets.owner))
                owner, place = run_lengths(most)
                at = by[sets.bounds[:-1][owner] + place]
                ends = np.append(0, np.cumsum(most))
                total = [np.append(_U(0), np.cumsum(mix64(sets.values[at] ^ _U(s)), dtype=_U))[ends] for s in (0x3C6EF372, 0x78DDE6E4)]
                group = [mix64(np.diff(t) + n.astype(_U) * _U(0x9E3779B97F4A7C15)) for t in total]
                final = at[np.maximum(ends[1:] - 1, 0)] if len(at) else np.zeros(block.rows, dtype=np.int64)
                last, level = (np.where(n > 0, x[final], 0) if len(at) else np.zeros(block.rows, x.dtype) for x in (sets.values, rank))
                twice = rank[at] > 0  # the others are in no other document
                prefix, most = sets.values[at[twice]], np.bincount(owner[twice], minlength=block.rows)
                part = batch.slice(block.first, block.rows)
                longs = [pa.array(x.view(np.int64)) for x in (sets.first, sets.second, *group)]
                arrays = [part.column(0), part.column(1), pa.array(n.astype(np.int32)), *longs, pa.array(level.astype(np.int32)), pa.array(last.view(np.int64)), _lists(prefix, np.append(0, np.cumsum(most)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["k", "row", "n", "c1", "c2", "g", "h", "rank", "last", "prefix"])

    # a null key is told from its stand-in at the end
    found = docs.select(F.col("_k").alias("k"), F.col("_row").alias("row"), "text").mapInArrow(prefixes, "k long, row long, n int, c1 long, c2 long, g long, h long, rank int, last long, prefix array<long>")
    rows = scratch.written(found, "prefixes")
    order.unpersist()
    linked = rows.where(F.size("prefix") > 0)
    per_group = linked.groupBy("g", "h").agg(*(F.first(c).alias(c) for c in ("n", "rank", "last", "prefix")), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("c1", "c2")))
    groups = scratch.written(per_group.select(*_GROUP, F.expr("min_c1 <> max_c1 OR min_c2 <> max_c2").alias("several")), "groups")
    clusters = components(_candidate_links(groups, percent, scratch)).select(F.col("node").alias("g"), F.col("root").alias("cluster"))
    # a group of several sets is a cluster even if no other passes with it
    own = groups.where("several").select("g").distinct().join(clusters.select("g"), "g", "left_anti").select("g", F.col("g").alias("cluster"))
    clusters = scratch.written(clusters.unionByName(own), "clusters")
    known = F.when(F.col("k") != _NO_KEY, F.col("k"))
    classes = scratch.written(linked.groupBy("c1", "c2").agg(F.min("g").alias("g"), F.min("n").alias("n"), F.count("*").alias("copies"), F.min(F.struct("k", "row")).alias("one"), F.min(known).alias("key")), "classes")
    scratch.drop("groups", "members", "meets")
    sized = classes.join(clusters, "g").select("cluster", "c1", "c2", "n", "copies", F.col("one.k").alias("_k"), F.col("one.row").alias("_row"), "key")
    totals = sized.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1").select("cluster", _tiles(F.col("m"), F.col("s")).alias("tiles"))
    wanted = scratch.written(sized.join(totals, "cluster"), "wanted")
    flags = _row_flags(wanted.select("_k", "_row"))
    texts = _flagged(docs.select("_k", "_row", "text"), flags, True, once=True)
    members = texts.join(wanted, ["_k", "_row"])
    labels = members.where("tiles = 1").select("cluster", *_MEMBER, "key").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_label(size, percent), _LABEL)
    labels = scratch.written(labels, "labels")
    if not wanted.where("tiles > 1").isEmpty():
        large = scratch.written(members.where("tiles > 1").drop("_k", "_row"), "large")
        labels = labels.unionByName(scratch.written(_large_clusters(large, size, percent, scratch), "large-labels"))
        scratch.drop("large", "stars")
    # a table of its own, so that a class of very many rows can be split in the join
    alone = classes.select("c1", "c2", "key").join(labels, ["c1", "c2"], "left")
    root, lowest = F.coalesce("root", _name("c1", "c2")), F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("component_id"))
    named = scratch.written(alone.select("c1", "c2", root.alias("root"), lowest.alias("component_id")), "named")
    scratch.drop("classes", "clusters", "wanted", "labels", "large-labels")
    out = [F.when(F.col("k") != _NO_KEY, F.col("k")).alias("key"), "row", F.col("n").cast("long").alias("n_shingles")]
    joined = linked.join(named, ["c1", "c2"]).select(*out, "component_id", "root")
    single = rows.where(F.size("prefix") == 0).select(*out, known.alias("component_id"), F.lit(None).cast("string").alias("root"))
    return joined.unionByName(single)


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows with one document of each component: that of the smallest key, or the smallest text hash if no key is known.

    Rows without words all stay.  Only texts of components with several rows are sent.
    """
    if taken := {"_k", "_row"} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} exist already")
    scratch = Scratch(df.sparkSession)
    found = near_duplicates(df, key, text, size, percent).where("root IS NOT NULL").select(F.coalesce("key", F.lit(_NO_KEY)).alias("_k"), "row", "root", F.col("key").isNull().alias("none"))
    found = scratch.written(found.withColumnRenamed("row", "_row"), "found")
    best = found.groupBy("root").agg(F.min(F.struct("none", "_k", "_row")).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    best = scratch.written(best, "best")
    flags = _row_flags(found.join(best.select("root"), "root", "left_semi").select("_k", "_row"))
    rows = df.select(*_identified(df, key, text), *df.columns)
    keep = best.select(F.col("best._k").alias("_k"), F.col("best._row").alias("_row"))
    listed = found.join(best.select("root"), "root", "left_semi").select("_k", "_row").distinct()
    asked = _flagged(rows, flags, True)
    marked = asked.join(listed.join(keep.withColumn("_keep", F.lit(True)), ["_k", "_row"], "left").withColumn("_listed", F.lit(True)), ["_k", "_row"], "left")
    chosen = marked.where("_listed AND _keep").dropDuplicates(["_k", "_row"])
    return _flagged(rows, flags, False).unionByName(marked.where("_listed IS NULL").drop("_keep", "_listed")).unionByName(chosen.drop("_keep", "_listed")).select(*df.columns)
