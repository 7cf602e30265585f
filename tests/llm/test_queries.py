"""Every query of the subpackage over the small tables, against SQL or another way to the same rows."""

import hashlib
import re
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.llm import queries

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def texts(duck):
    return {k: t or "" for k, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, small, duck, name):
    found = entry.queries()[name](spark, small)
    cur = duck.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(found.columns) == sorted(names)
    assert sorted(tuple(r) for r in found.select(*names).collect()) == sorted(cur.fetchall())


def test_op1_equals_the_library(spark, small, duck):
    tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    from graphloom.llm.bpe import read_ranks

    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=read_ranks(tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for k, t in texts(duck).items():
        ids = library.encode_ordinary(t)
        want.append((k, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(tuple(r) for r in queries.op1_byte_bpe(spark, small).collect()) == sorted(want)


def test_op2_changes_only_values_of_its_layouts(spark, small, duck):
    from graphloom.llm.pii import PATTERNS

    before, after = texts(duck), {r.doc_id: r for r in queries.op2_pseudonyms(spark, small).collect()}
    assert after.keys() == before.keys() and any(r.changed for r in after.values())
    layout = re.compile("|".join(f"(?:{PATTERNS[k]})" for k in ("ip", "ssn")))
    for k, t in before.items():
        r = after[k]
        assert bool(r.changed) == (r.text is not None and r.text != t)
        if not re.search("[0-9@]", t):
            assert (r.text or "") == t
        assert len(layout.findall(r.text or "")) == len(layout.findall(t))


def test_op4_base_spans_equal_the_patterns(spark, small, duck):
    kinds = [
        ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 20),
        ("hex", re.compile(r"[0-9a-f]+"), 24),
    ]
    got = {r.doc_id: r for r in queries.op4_secrets(spark, small).collect()}
    for k, t in texts(duck).items():
        spans, n = [], []
        for i, (kind, pattern, least) in enumerate(kinds):
            mine = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(t) if len(m[m.lastindex or 0]) >= least]
            n.append(len(mine))
            spans += mine
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == n
        joined = ",".join(s for _, _, s in sorted(spans))
        assert got[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert {s for _, _, s in spans} <= set(got[k].spans.split(","))


def test_op6_against_all_vectors(spark, small, duck):
    import numpy as np

    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    hits = total = 0
    got = {}
    for r in queries.op6_neighbours(spark, small).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        scores = (x * x[np.flatnonzero(ids == q)[0]]).sum(axis=1)
        others = sorted((-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True) if i != q)[:20]
        assert [p for p, _, _ in sorted(found)] == list(range(1, len(others) + 1))
        hits += len({i for _, i in others} & {i for _, i, _ in found})
        total += len(others)
    assert hits >= 0.9 * total


def test_op7_keeps_counts_between_bounds(spark, small, duck):
    got = {r.doc_id: r.n_tokens for r in queries.op7_token_counts(spark, small).collect()}
    for k, t in texts(duck).items():
        assert (0 < got[k] <= len(t.encode())) if t else got[k] == 0


def test_op8_pieces_hold_every_token(spark, small, duck):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = queries.op8_best_fit(spark, small).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for k, text in texts(duck).items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        mine = sorted(pieces[k], key=lambda r: r.piece)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:i]) for i in range(len(mine))] and sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length]))
        assert all(r.length == 2048 for r in mine[1:]) if len(ids) > 2048 else len(mine) == 1
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 2048


def test_op10_returns_every_page(spark, small, duck):
    got = {r.page_id: r for r in queries.op10_main_text(spark, small).collect()}
    rows = duck.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert set(got) == {r[0] for r in rows}
    for page, url, _ in rows:
        r = got[page]
        assert r.url == url and r.n_chars == len(r.text) and r.text == r.text.strip() and "<script" not in r.text
