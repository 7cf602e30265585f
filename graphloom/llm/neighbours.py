"""Approximate nearest neighbours by cross-polytope hashing with multiprobe.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform)
turns a vector, and its bucket in a table is the signed axis nearest to it.
Every table has its own rotation.  A query looks into the buckets of its
nearest axes, a fixed share of them, in every table, and what it finds there is ranked by
the exact inner product of the original vectors, in double precision.

Equal vectors are one class, of which only as many smallest ids travel as a
result can hold.  Where norms differ, vectors fall into bands of norms within
a factor of BAND, and get a coordinate that makes all of a band as long as its
longest, so that the largest inner product is the nearest (it is 0 for queries).
A query looks into every band; one of few vectors is a single bucket that all
queries see.  A query that finds too few is ranked against all vectors.  Buckets are dealt in pieces of bounded size, a large bucket to
several tasks; nothing is left out of any bucket.  Candidates are ranked where
they meet, in blocks; only each query's best of a piece travel on.

Vectors that are null, empty, zero, of another length than most, or hold null,
NaN or infinity take no part, nor do rows without an id.  Repeated rows of one
id and vector count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

TABLES, SEED = 10, 11
#: Share of a table's axes that a query looks at.
PROBED = 1 / 8
#: Classes of one piece of a bucket; a band of no more rows is not hashed.
PIECE = 1024
#: Norms of a band are within this factor.
BAND = 2**0.5


def signs(dim: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Random signs of each table's three rounds."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, 3, dim))


def rotate(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Rows of ``x`` after three rounds of signs and the Walsh-Hadamard transform."""
    for k in range(3):
        x = x * s[k]
        h = 1
        while h < x.shape[1]:
            y = x.reshape(len(x), -1, 2, h)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), -1)
            h *= 2
        x = x / np.sqrt(x.shape[1])
    return x


def nearest_axes(x: np.ndarray, s: np.ndarray, count: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first; axis i negated is i + dim."""
    turned = rotate(x, s)
    both = np.concatenate([turned, -turned], axis=1)
    if count == 1:
        return both.argmax(axis=1)[:, None]
    part = np.argpartition(-both, min(count, both.shape[1]) - 1, axis=1)[:, :count]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(both, part, axis=1), axis=1, kind="stable"), axis=1)


def _prepared(x: np.ndarray, longest: np.ndarray | None, lift: bool, query: bool) -> np.ndarray:
    """Rows of one length, padded to a power of two."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    if query or not lift:
        x = x / norm
        extra = np.zeros((len(x), int(lift)))
    else:
        x = x / longest[:, None]
        extra = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))
    x = np.concatenate([x, extra], axis=1)
    return np.pad(x, ((0, 0), (0, (1 << max(0, x.shape[1] - 1).bit_length()) - x.shape[1])))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of distinct ids, best first, ties to the smaller id."""
    by = np.lexsort((ids, -scores))
    _, first = np.unique(ids[by], return_index=True)
    return by[np.sort(first)][:k]


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, tables: int = TABLES, probed: float = PROBED) -> DataFrame:
    """query_id, rank (from 1), id and score of the k nearest rows found for each query, its own left out."""
    rows = df.where(F.col(key).isNotNull() & _usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = "query_id long, rank int, id long, score double"
    if not sizes:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == sizes[0].d)
    # of a class of equal vectors, the ids that a result of k rows can hold
    first = rows.select("id", "v").withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = first.groupBy("v").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
    asked = rows.where("is_query").select("v").distinct().withColumn("asked", F.lit(True))
    classes = classes.join(asked, "v", "left").select("v", "ids", F.get("ids", F.lit(0)).alias("rep"), F.coalesce("asked", F.lit(False)).alias("asked"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    band = F.greatest(F.least(F.coalesce(F.floor(F.log2(norm) / math.log2(BAND)), F.lit(-5000)), F.lit(5000)), F.lit(-5000)).cast("int")
    spans = rows.groupBy(band.alias("band")).agg(F.max(norm).alias("high"), F.min(norm).alias("low"), F.count("*").alias("n")).orderBy("band").collect()  # one for each band
    high, low = max(r.high for r in spans), min(r.low for r in spans)
    lift = bool(high - low > 1e-3 * high)
    place = {r.band: i if lift else 0 for i, r in enumerate(spans)}
    longest = np.array([r.high for r in spans])
    whole = np.array([r.n for r in spans] if lift else [sum(r.n for r in spans)]) <= PIECE
    classes = classes.withColumn("band", band)
    width = 1 << max(0, sizes[0].d + int(lift) - 1).bit_length()
    turns = signs(width, tables)
    probes = max(1, round(2 * width * probed))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                at = np.array([place[b] for b in part.column(4).to_pylist()], dtype=np.int64)
                x = _prepared(_matrix(part.column(0)), longest[at], lift, False)
                axes = np.stack([nearest_axes(x, s, 1)[:, 0] for s in turns], axis=1)
                slots = (at[:, None] * tables + np.arange(tables)) * 2 * width + axes
                slots[whole[at], 0] = at[whole[at]] * tables * 2 * width
                use = np.ones(slots.shape, dtype=bool)
                use[whole[at], 1:] = False
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(use.sum(axis=1))).astype(np.int32)), pa.array(slots[use]))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], lists], names=[*part.schema.names[:4], "slots"])

    index = written(classes.mapInArrow(hashed, "v array<double>, ids array<long>, rep long, asked boolean, slots array<long>"), "index")
    placed = index.select(F.explode("slots").alias("slot"))
    pieces = {r.slot: -(-r.n // PIECE) for r in placed.groupBy("slot").agg(F.count("*").alias("n")).collect()}  # one for each axis of each table of each band
    many = {b: n for b, n in pieces.items() if n > 1}

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rep = np.asarray(part.column(2))
                x = _matrix(part.column(0))
                ask = np.flatnonzero(np.asarray(part.column(3)))
                out: list[tuple[int, bool, int]] = []
                for row, slots in enumerate(part.column(4).to_pylist()):
                    out += [(slot << 24 | int(rep[row]) % many.get(slot, 1), False, row) for slot in slots]
                seen: list[list[int]] = [[b * tables * 2 * width for b in np.flatnonzero(whole).tolist()] for _ in ask]
                if len(ask) and not whole.all():
                    turned = _prepared(x[ask], None, lift, True)
                    for t in range(tables):
                        base = (np.flatnonzero(~whole) * tables + t) * 2 * width
                        near = nearest_axes(turned, turns[t], probes)
                        for slots, axes in zip(seen, near, strict=True):
                            slots += (base[:, None] + axes).ravel().tolist()
                for row, slots in zip(ask.tolist(), seen, strict=True):
                    out += [(slot << 24 | p, True, row) for slot in slots for p in range(pieces.get(slot, 0))]
                which = pa.array([o[2] for o in out], pa.int64())
                key_, asks = pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.bool_())
                yield pa.RecordBatch.from_arrays([key_, asks, part.column(2).take(which), part.column(1).take(which), part.column(0).take(which)], names=["bucket", "ask", "rep", "ids", "v"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket, what it holds before who asks."""
        now, held, ready = None, [], None

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, asks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edge = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (asks[1:] != asks[:-1])))
            for a, b in zip(edge, np.append(edge[1:], len(bucket)), strict=True):
                part = batch.slice(a, b - a)
                if bucket[a] != now:
                    now, held, ready = bucket[a], [], None
                if not asks[a]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if ready is None:
                    ids = pa.concat_arrays([p.column(3) for p in held])
                    ready = np.concatenate([_matrix(p.column(4)) for p in held]), np.asarray(ids.flatten()), np.asarray(ids.offsets)
                yield answers(part, *ready)

    def answers(part: pa.RecordBatch, matrix: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        asked_ = _matrix(part.column(4))
        low = offsets[:-1]
        margin = 4 * np.finfo(np.float64).eps * matrix.shape[1] * np.sqrt((matrix**2).sum(axis=1).max())
        found_ids, found_scores = [], []
        for i in range(0, len(asked_), 256):
            scores = asked_[i : i + 256] @ matrix.T
            last = max(0, len(matrix) - k - 1)
            # all that rounding may put among the best, so that no tie is cut
            least = np.partition(scores, last, axis=1)[:, last] - margin * np.sqrt((asked_[i : i + 256] ** 2).sum(axis=1))
            for j in range(len(scores)):
                close = np.flatnonzero(scores[j] >= least[j])
                # one fixed order of summing, whatever the block
                exact = np.einsum("ij,ij->i", matrix[close], np.broadcast_to(asked_[i + j], (len(close), matrix.shape[1])))
                best = np.lexsort((ids[low[close]], -exact))[: k + 1]
                wide = [(int(m), s) for c, s in zip(close[best].tolist(), exact[best].tolist(), strict=True) for m in ids[offsets[c] : offsets[c + 1]]]
                own, best = np.array([w[0] for w in wide]), np.array([w[1] for w in wide])
                keep = _best(own, best, k + 1)
                found_ids.append(own[keep])
                found_scores.append(best[keep])
        bounds = pa.array(np.append(0, np.cumsum([len(x) for x in found_ids])).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x))) for x in (found_ids, found_scores)]
        return pa.RecordBatch.from_arrays([part.column(2), *lists], names=["rep", "ids", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by query class; the lists found in all its buckets become one."""
        now, ids, scores = None, [], []

        def out() -> pa.RecordBatch:
            i, s = np.concatenate(ids), np.concatenate(scores)
            keep = _best(i, s, k + 1)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([i[keep].tolist()], pa.list_(pa.int64())), pa.array([s[keep].tolist()], pa.list_(pa.float64()))], names=["rep", "ids", "scores"])

        for batch in batches:
            reps = np.asarray(batch.column(0))
            for row in range(batch.num_rows):
                if reps[row] != now:
                    if now is not None:
                        yield out()
                    now, ids, scores = reps[row], [], []
                ids.append(np.asarray(batch.column(1)[row].values))
                scores.append(np.asarray(batch.column(2)[row].values))
                if len(ids) > 256:
                    i, s = np.concatenate(ids), np.concatenate(scores)
                    keep = _best(i, s, k + 1)
                    ids, scores = [i[keep]], [s[keep]]
        if now is not None:
            yield out()

    def ranked(found: DataFrame) -> DataFrame:
        found = found.repartition("bucket").sortWithinPartitions("bucket", "ask").mapInArrow(rank, "rep long, ids array<long>, scores array<double>")
        return found.repartition("rep").sortWithinPartitions("rep").mapInArrow(merge, "rep long, ids array<long>, scores array<double>")

    lists = written(ranked(index.mapInArrow(buckets, "bucket long, ask boolean, rep long, ids array<long>, v array<double>")), "found")
    enough = lists.where(F.size("ids") > k).select("rep")
    short = index.where("asked").join(enough, "rep", "left_anti")
    if not short.isEmpty():
        parts = -(-index.count() // PIECE)
        held = index.select(F.pmod(F.xxhash64("rep"), F.lit(parts)).alias("bucket"), F.lit(False).alias("ask"), "rep", "ids", "v")
        asking = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("bucket"), F.lit(True).alias("ask"), "rep", "ids", "v")
        lists = lists.join(enough, "rep", "left_semi").unionByName(ranked(held.unionByName(asking)))
    named = index.where("asked").select("rep", "v").join(lists, "rep", "left")
    queries = rows.where("is_query").select(F.col("id").alias("query_id"), "v").distinct().join(named, "v")
    hits = F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda x: x.ids != F.col("query_id")), 1, k)
    out = queries.select("query_id", F.posexplode(hits).alias("p", "hit"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("hit.ids").alias("id"), F.col("hit.scores").alias("score"))
