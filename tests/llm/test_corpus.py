import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import components, jaccard, neighbours, sketch, substrings
from graphloom.llm.textblocks import grams, mix64

WORD = r"[^\x20\x09-\x0D]+"
LOW = {i: i + 32 for i in range(65, 91)}


def words(rng, n, vocabulary=2000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """Documents with exact copies, near copies, a common passage, repeated lines, and odd rows."""
    rng = random.Random(seed)
    passage, base, out = words(rng, 60), words(rng, 200), []
    for _ in range(40):
        w = words(rng, rng.randint(1, 150))
        out.append(" ".join(w[:20] + passage + w[20:]) if rng.random() < 0.4 else " ".join(w))
    for _ in range(30):
        near = list(base)
        for _ in range(rng.randint(0, 12)):
            near[rng.randrange(len(near))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(near))
    out += [out[3], out[3].upper(), out[3].replace(" ", "\n"), "a b c", "A b  c", "a", "", None, " \t", " ".join(["same line of words here now"] * 12)]
    rows = [(i * 3 % 101, x, "s") for i, x in enumerate(out)]
    return [*rows, rows[5], (None, out[4], None), (None, "lonely words stand here without a key", None)]


def shingles(text, size):
    w = re.findall(WORD, (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size, percent):
    sets = [shingles(t, size) for _, t, _ in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[find(i)] = find(j)
    least = defaultdict(list)
    for i, (key, _, _) in enumerate(rows):
        least[find(i)].append(key)
    return [(key, len(s), min((k for k in least[find(i)] if k is not None), default=None) if s else key) for i, ((key, _, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("tile", "size", "percent"), [(512, 4, 85), (3, 4, 85), (2, 5, 80)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, tile, size, percent):
    monkeypatch.setattr(jaccard, "TILE_CLASSES", tile)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    got = [(r.key, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df.repartition(3), size=size, percent=percent).collect()]
    assert sorted(got, key=repr) == sorted(brute_components(rows, size, percent), key=repr)


@pytest.mark.parametrize("tile", [4, 6])
def test_large_group_links_classes_that_are_not_near_its_head(spark, monkeypatch, tile):
    """Pairs that meet only in the group of the word all have, as their other common words are frequent and in no prefix."""
    monkeypatch.setattr(jaccard, "TILE_CLASSES", tile)
    common = [[f"f{i}x{j}" for j in range(7)] for i in range(6)]
    texts = [" ".join([f"u{i}x{side}", "shared", *common[i]]) for i in range(6) for side in range(2)]
    texts += [" ".join([w for c in common for w in c] + [f"v{i}x{j}" for j in range(200)]) for i in range(60)]
    rows = [(i, x, None) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [(r.key, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, size=1, percent=80).collect()]
    assert sorted(got) == sorted(brute_components(rows, 1, 80))


@pytest.mark.parametrize("flip", [False, True])
def test_tiles_take_both_sides_of_a_class(flip):
    """A class that comes once for each side is compared as both, in whichever order its rows come."""
    sides = [(True, False), (False, True)]
    rows = [(c, s) for s in (sides[::-1] if flip else sides) for c in (1, 2)]
    ids, flags = [pa.array([c for c, _ in rows], pa.int64())] * 2, [pa.array([s[i] for _, s in rows]) for i in range(2)]
    job = pa.array([7] * 4, pa.int64())
    texts = pa.RecordBatch.from_arrays([job, *ids, pa.array(["a b c d e"] * 4), *flags], names=["job", "c1", "c2", "text", "left", "right"])
    assert sum(b.num_rows for b in jaccard._tile_links(1, 80)(iter([texts]))) == 1
    fixed = [pa.array([x] * 4, t) for x, t in ((5, pa.int32()), (1, pa.int32()), (3, pa.int64()), ([1, 2], pa.list_(pa.int64())))]
    groups = pa.RecordBatch.from_arrays([job, *ids, *fixed, *flags], names=["job", "g", "h", "n", "rank", "last", "prefix", "left", "right"])
    assert sum(b.num_rows for b in jaccard._filter(80)(iter([groups]))) == 1


def test_keep_one(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    df = df.withColumnRenamed("_row", "source")
    kept = jaccard.keep_one(df).collect()
    want = defaultdict(int)
    for key, n, component in brute_components(rows, 5, 80):
        if n and key is not None and key == component:
            want[key] = 1
    assert sorted(r.doc_id for r in kept if r.doc_id is not None and shingles(r.text, 5)) == sorted(want)
    assert sum(not shingles(r.text, 5) for r in kept) == sum(not shingles(t, 5) for _, t, _ in rows)
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    links = [(str(a), str(b)) for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(110)) if a != b] + [(f"c{i}", f"c{i + 1}") for i in range(40)]
    label = {}
    for x in {y for link in links for y in link}:
        label[x] = {x}
    for a, b in links:
        if label[a] is not label[b]:
            label[a] |= label[b]
            for x in label[b]:
                label[x] = label[a]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u string, v string")).collect()}
    assert got == {x: min(group) for x, group in label.items()}
    assert components.components(spark.createDataFrame([], "u string, v string")).count() == 0


def brute_repeats(rows, size=20):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    first = {}
    split = [re.findall(WORD, t or "") for _, t, _ in rows]
    for i in order:
        for s in range(len(split[i]) - size + 1):
            at = (rows[i][0] is not None, rows[i][0] or 0, s)
            k = tuple(split[i][s : s + size])
            first[k] = min(first.get(k, at), at)
    out = []
    for i, w in enumerate(split):
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (rows[i][0] is not None, rows[i][0] or 0, s):
                gone.update(range(s, s + size))
        out.append((rows[i][0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize(("frequent", "held"), [(1024, 1 << 20), (2, 1 << 20), (3, 5)])
def test_repeats_equal_brute_force(spark, monkeypatch, frequent, held):
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    monkeypatch.setattr(substrings, "HELD", held)
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string, ord string").repartition(3)
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(df, joined=True).collect()]
    assert sorted(got, key=repr) == sorted(brute_repeats(rows), key=repr)


def test_cut_texts_keep_their_white_space(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in substrings.remove_repeats(df).collect():
        original = [t for k, t, _ in rows if k == r.doc_id]
        assert r.text in original if not r.n_removed else len(re.findall(WORD, r.text)) == r.n_words - r.n_removed
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(5)
    hashes = mix64(rng.integers(0, 5000, 20000).astype(np.uint64))
    df = spark.createDataFrame([(h,) for h in hashes.view(np.int64).tolist()], "h long").repartition(5)
    bits = 17

    def count(batches):
        cells = sketch.Cells(bits)
        for b in batches:
            yield from cells.add(b.column(0).to_numpy().view(np.uint64))
        yield from cells.flush()

    rows = sketch.merged(df.mapInArrow(count, sketch.SCHEMA), lambda n: (sketch.packed(n >= 2),), "twice").collect()
    flags = sketch.Flags(bits, {r.block: bytes(r.twice) for r in rows})
    values, times = np.unique(hashes, return_counts=True)
    assert flags.test(values[times >= 2]).all() and flags.test(values[times == 1]).mean() < 0.2


def test_grams_tell_runs_apart():
    w = mix64(np.arange(60, dtype=np.uint64) % np.uint64(7))
    for n in (1, 2, 4, 7, 8, 20):
        got, seen = grams(w, n), {}
        for i in range(len(got)):
            assert seen.setdefault(tuple(w[i : i + n].tolist()), got[i]) == got[i]
        assert len(set(got.tolist())) == len(seen)


def vectors(spark, matrix, ids=None):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(matrix)), matrix, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute_nearest(matrix, ids, q, k):
    s = matrix @ matrix[q]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]]
    return [ids[i] for i in order[:k]]


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(1500, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    if scale:
        m *= rng.uniform(0.5, 2.0, (1500, 1))
    m = m.astype(np.float32).astype(np.float64)
    rows = neighbours.nearest(vectors(spark, m), F.col("vec_id") % 50 == 0).collect()
    got = defaultdict(dict)
    for r in rows:
        got[r.query_id][r.rank] = r
    share = []
    for q in range(0, 1500, 50):
        mine = [got[q][i + 1] for i in range(20)]
        share.append(len({r.id for r in mine} & set(brute_nearest(m, np.arange(1500), q, 20))) / 20)
        assert all(abs(r.score - m[q] @ m[r.id]) < 1e-9 for r in mine)
    assert np.mean(share) >= 0.9


@pytest.mark.parametrize("skew", ["one", "lognormal"])
def test_recall_with_skewed_norms(spark, skew):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(5000, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    if skew == "one":
        m[7] *= 20
    else:
        m *= rng.lognormal(0, 1, (5000, 1))
    m = m.astype(np.float32).astype(np.float64)
    got = defaultdict(set)
    for r in neighbours.nearest(vectors(spark, m), F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].add(r.id)
    assert all(len(got[q]) == 20 for q in range(0, 5000, 50))
    assert np.mean([len(got[q] & set(brute_nearest(m, np.arange(5000), q, 20))) / 20 for q in range(0, 5000, 50)]) >= 0.95


def test_a_query_that_finds_too_few_is_ranked_against_all(spark):
    m = np.random.default_rng(3).normal(size=(1500, 64))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    rows = neighbours.nearest(vectors(spark, m), F.col("vec_id") < 3, tables=1, probed=0.001).collect()
    for q in range(3):
        assert [r.id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] == brute_nearest(m, np.arange(1500), q, 20)


def test_repeated_rows_leave_room_for_equal_vectors(spark):
    m = np.eye(8)[[0] * 100 + [0, 0, 1]]
    rows = neighbours.nearest(vectors(spark, m, [0] * 100 + [1, 2, 3]), F.col("vec_id") == 3).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.rank)] == [0, 1, 2]


def test_copies_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PIECE", 8)
    base = np.eye(8)[np.zeros(60, dtype=int)]
    other = np.eye(8)[1:5]
    df = vectors(spark, np.concatenate([base, other, other[:1] * 0.5]))
    bad = spark.createDataFrame([(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [1.0]), (904, [None] * 8), (None, [1.0] * 8), (0, [1.0] + [0.0] * 7)], "vec_id long, embedding array<float>")
    rows = neighbours.nearest(df.unionByName(bad), F.col("vec_id").isin(0, 40, 60, 900), k=20).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.id)
    assert got[0] == list(range(1, 21)) and got[40] == list(range(20)) and 900 not in got
    assert got[60][0] == 64
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    letters = str.maketrans("0123456789", "abcdefghij")  # words of digits are no prose
    prose = [" ".join(words(random.Random(i), 120)).translate(letters) for i in range(6)]
    passage = " ".join(words(random.Random(50), 60)).translate(letters)
    texts = [prose[0], prose[0], prose[1] + "\n" + passage, prose[2] + "\n" + passage, prose[3] + ' token = "abcdef0123456789abcdef01"', "short", "x*** " * 40, None, prose[4]]
    rows = [(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, schema).write.parquet(folder)
    docs, kept = spark.read.parquet(folder), []
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert set(kept[0]) == {0, 1, 2, 3, 4, 8} and set(kept[1]) == {0, 2, 3, 4, 8}
    assert passage in kept[2][2] and passage not in kept[2][3] and kept[2][8] == prose[4]
    assert "abcdef0123456789" not in kept[3][4] and kept[3][0] == prose[0]
    pieces = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {0, 2, 3, 4, 8}
    assert len(pipeline.STAGES) == 5 and math.isfinite(sum(r.length for r in pieces))


def test_queries_have_names_of_their_operators():
    from graphloom.llm import queries

    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11)) and set(queries.SQL) <= set(queries.QUERIES)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_ties_of_very_many_vectors_go_to_the_smaller_id(spark):
    """600 vectors that tie under the query, in a bucket that all see."""
    rng = np.random.default_rng(5)
    rows = [(0, [1.0] + [0.0] * 7)] + [(i, [0.5, *rng.standard_normal(7).round(3).tolist()]) for i in range(1, 601)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = neighbours.nearest(df, F.col("vec_id") == 0, probed=1.0).orderBy("rank").collect()
    assert [(r["rank"], r.id, r.score) for r in got] == [(i, i, 0.5) for i in range(1, 21)]


def test_words_of_two_letters_are_not_copies(spark):
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - x for x in bits]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rest = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest[:2]])), (3, a), (4, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.component_id == r.key for r in jaccard.near_duplicates(df, size=4, percent=85).collect())
    only = spark.createDataFrame([(1, " ".join([a, *rest[:19]])), (2, " ".join([b, *rest[:19]]))], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_repeats(only).collect()] == [0, 0]


def test_groups_with_several_sets_and_null_keys_alone(spark):
    """Copies under null keys only: one row stays; equal prefixes with unlike sets are one group."""
    base = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(base)), (None, " ".join(base)), (None, " ".join([*base, "end"])), (7, "one of its own kind here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    kept = jaccard.keep_one(df, size=4, percent=85).collect()
    assert sorted(r.doc_id is None for r in kept) == [False, True]
