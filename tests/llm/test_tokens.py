import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from graphloom.llm import packing, unigram
from graphloom.llm.bpe import Encoder, bpe_decode, bpe_encode, read_ranks
from graphloom.llm.textblocks import blocks, hash_ranges

RANKS = read_ranks(P.path("byte_bpe_50k.tiktoken"))
ODD = ["'s", "'re", " ", "  ", "\n", "\t", "'ll", "'", "a", "B", "é", "漢", "1", "٣", "!", "?", "'VE", "'ve", " 's", "😀", "　", "\x85", "\x1c", "<|endoftext|>", "l"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 15))) for _ in range(n)]


def encoded(encoder, texts):
    out = []
    for block in blocks(pa.array(texts, pa.string()), limit=300):
        flat, bounds = encoder.encode(block)
        out += [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def test_ids_equal_the_library(reference):
    texts = [*odd_texts(3000), "", None, "x" * 5000, "ab" * 3000]
    assert encoded(Encoder(RANKS), texts) == [reference.encode_ordinary(x or "") for x in texts]


def test_ids_equal_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = odd_texts(2000, 5)
    assert encoded(Encoder(RANKS, False), texts) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_long_pretokens_and_a_full_cache(reference, monkeypatch):
    from graphloom.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdef") for _ in range(n)) for n in (255, 256, 257, 2000)] + odd_texts(200)
    assert encoded(Encoder(RANKS), texts) == [reference.encode_ordinary(x) for x in texts]


def two_letter_pair(n):
    """Two words whose polynomial hashes modulo 2 ** 64 are equal, whatever the base and the letters' values."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [256, 1024, 4096])
def test_words_of_two_letters_are_told_apart(reference, n):
    texts = [*two_letter_pair(n), " ".join(two_letter_pair(n))]
    assert encoded(Encoder(RANKS), texts) == [reference.encode_ordinary(x) for x in texts]
    both = np.frombuffer("".join(two_letter_pair(n)).encode(), dtype=np.uint8)
    hashes = hash_ranges(both, np.array([0, n]), np.array([n, 2 * n]))
    assert hashes[0] != hashes[1]


def test_equal_first_hashes_are_told_apart(reference, monkeypatch):
    """With a first hash that knows only lengths, the second one decides."""
    from graphloom.llm import bpe

    real = bpe.hash_ranges
    monkeypatch.setattr(bpe, "hash_ranges", lambda data, a, b, seed=1: (b - a).astype(np.uint64) if seed == 1 else real(data, a, b, seed))
    monkeypatch.setattr(unigram, "hash_ranges", bpe.hash_ranges)
    texts = odd_texts(100)
    assert encoded(Encoder(RANKS), texts) == [reference.encode_ordinary(x) for x in texts]
    counter = unigram.UnigramCounter(RANKS)
    together = next(blocks(pa.array(texts)))
    assert counter.rows(together).tolist() == [counter.rows(next(blocks(pa.array([x])))).item() if x else 0 for x in texts]


def test_long_pretokens_are_scored_as_in_the_trie(monkeypatch):
    counter = unigram.UnigramCounter(RANKS)
    rng = random.Random(3)
    for word in (two_letter_pair(1024)[0], "".join(rng.choice("etaoinshr") for _ in range(900)), "x" * 700):
        data = np.frombuffer(word.encode(), dtype=np.uint8)
        monkeypatch.setattr(unigram, "DEEPEST", 10**9)
        whole = counter.counts(data, np.array([0]), np.array([len(data)]))[0]
        monkeypatch.setattr(unigram, "_STRETCH", 300)
        assert counter.long_count(data) == whole
    monkeypatch.setattr(unigram, "DEEPEST", 256)
    data = np.frombuffer(("q" * 100_000).encode(), dtype=np.uint8)
    assert counter.counts(data, np.array([0]), np.array([len(data)]))[0] > 0


def test_round_trip_in_spark(spark, reference):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "", "y"), (4, "é漢 " * 2000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    done = bpe_encode(df, RANKS, decoded="decoded")
    got = done.collect()
    assert len(got) == 5 and done.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")
    again = bpe_decode(done.drop("decoded"), RANKS).collect()
    assert [bytes(r.decoded) for r in again] == [bytes(r.decoded) for r in got]
    assert bpe_encode(df.limit(0), RANKS).count() == 0
    with pytest.raises(ValueError):
        bpe_encode(df.withColumnRenamed("n_tokens", "ids"), RANKS)


def test_best_fit_places_pieces_without_gaps():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(5.5, 1.2, 5000).astype(int) + 1, 9000)
    owner, piece, start, length = packing.cut(lengths)
    assert (np.bincount(owner, length) == lengths).all() and length.max() <= packing.CAPACITY
    assert all((length[(owner == o) & (piece > 0)] == packing.CAPACITY).all() for o in np.flatnonzero(lengths > packing.CAPACITY)[:50])
    for most in (1, 4, 4096):
        bins, filled = packing.BestFit(open_bins=most), {}
        for n in length.tolist():
            sequence, offset = bins.place(n)
            assert filled.get(sequence, 0) == offset
            filled[sequence] = offset + n
            assert filled[sequence] <= packing.CAPACITY and bins.opened <= most
    assert len(filled) <= 1.01 * length.sum() / packing.CAPACITY + 1


def test_the_fullest_bin_closes_first():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # the one with 7 was closed
    assert bins.place(4) == (0, 6) and bins.place(3)[0] == 3


def test_pack_documents(spark, reference):
    texts = [(1, "word " * 5000), (2, None), (3, ""), (4, "a b c"), (4, "a b c"), (None, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = packing.pack_documents(df, RANKS).collect()
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.sequence_id, r.offset), r)
    ids = [*reference.encode_ordinary("word " * 5000), 0]
    mine = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.piece)
    assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
    for r in mine:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    assert [(r.length, r.ids_crc32) for r in got if r.doc_id == 2] == [(1, zlib.crc32(b"\0\0\0\0"))]
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert len(got) == len(mine) + 5 and packing.pack_documents(df.limit(0), RANKS).count() == 0


def brute_unigram(text, longest):
    import regex

    n = 0
    for piece in regex.findall(P.PATTERN, text):
        b = piece.encode()
        best = [(0.0, 0)]
        for i in range(1, len(b) + 1):
            found = [(best[i - k][0] - np.log(RANKS[b[i - k : i]] + 1.0), best[i - k][1] + 1) for k in range(1, min(i, longest) + 1) if b[i - k : i] in RANKS]
            best.append(max(found, key=lambda x: (x[0], -x[1])))
        n += best[-1][1]
    return n


def test_unigram_counts(spark):
    counter = unigram.UnigramCounter(RANKS)
    texts = [*odd_texts(300, 9), "internationalisation of the words", "", "y" * 700]
    got = np.concatenate([counter.rows(b) for b in blocks(pa.array(texts), limit=500)])
    assert got.tolist() == [brute_unigram(x, counter.longest) for x in texts]
    df = spark.createDataFrame([(1, "the words"), (None, None), (1, "the words"), (2, "")], "doc_id long, text string")
    assert sorted((r.n_tokens for r in unigram.count_tokens(df, RANKS).collect())) == [0, 0, 2, 2]
    assert unigram.count_tokens(df.limit(0), RANKS).count() == 0
