"""op11 to op13 on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import os
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from coaffil.llm import byte_bpe, fim, whitening

DATA = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, row long, pos int, piece string, n long, form string, k int, ids string, decoded string, x int"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def texts():
    r = random.Random(6)
    pool = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\u0085", " ", " ", "　", "'s", "'re", "'", "ab", "é", "Ω", "中", "٣", "½", "🎉", "̀", "_", "0", "<P>"[:2], "\U0001e900", "\x00", "﻿"]
    odd = ["".join(r.choices(pool, k=r.randint(0, 900))) for _ in range(40)]
    return [(i, t) for i, t in enumerate(odd)] + [
        (100, None), (None, "x y"), (None, ""), (None, "x y"), (101, "same words here"), (101, "same words here"), (102, "a" * 5000 + " b"), (103, " " * 4000 + "b"),
        (104, "it's " * 3000), (105, "has a <M> mark in it"), (106, " \n "), (107, "word " * 100_000), (108, "\n" * 3001),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 7, 1, "p", 2, "f", 3, "i", "d", 4) for i, t in texts], SCHEMA)


def test_bytes_of_chunks_are_the_librarys(spark, docs, texts, library):
    want = sorted(((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in texts), key=str)
    for chunk, overlap in ((64, 16), (257, 3), (1 << 16, 1 << 10)):
        ids = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk_chars=chunk, overlap=overlap)
        got = sorted(((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in byte_bpe.decode(ids, RANKS).collect()), key=str)
        assert got == want
    none = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.decode(byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk_chars=8, overlap=9)


def test_bytes_decode_odd_ids(spark):
    rows = spark.createDataFrame([(1, [0, 50255], "a"), (2, [], "b"), (3, None, "c")], "k int, ids array<int>, decoded string")
    by = {v: k for k, v in byte_bpe.ranks(RANKS).items()}
    assert [bytes(r.decoded) for r in byte_bpe.decode(rows, RANKS).orderBy("k").collect()] == [by[0] + by[50255], b"", b""]
    for wrong in (50256, -1):
        with pytest.raises(Exception, match="outside the vocabulary"):
            byte_bpe.decode(spark.createDataFrame([([wrong],)], "ids array<int>"), RANKS).collect()


def test_pattern_splits_as_the_librarys_engine(library):
    r = random.Random(9)
    for _ in range(3000):
        text = "".join(chr(r.choice([r.randrange(0x250), r.randrange(0xD800), r.randrange(0xE000, 0x110000), 32, 39, 115])) for _ in range(12))
        joined = [i for w in byte_bpe.split(text, public_tokenizers.PATTERN) for i in library._encode_single_piece(w)]
        assert joined == library.encode_ordinary(text)


def fim_brute(i, text, fim_rate=50, spm_rate=80, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_rate:
        form, out, chars = "plain", text, (None, None)
    elif h4 % 100 < spm_rate:
        form, out, chars = "spm", f"<S>{s}<P>{p}<M>{m}", (len(p), len(m))
    else:
        form, out, chars = "psm", f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return i, len(units), form, *chars, sha(out), out, sha(text)


@pytest.mark.parametrize("options", [{}, {"chunk_units": 3, "fim_rate": 100}, {"chunk_units": 1, "fim_rate": 100, "spm_rate": 0}])
def test_fim_equals_brute_force(spark, docs, texts, options):
    rates = {k: v for k, v in options.items() if k != "chunk_units"}
    want = sorted((fim_brute(i, t, **rates) for i, t in texts), key=str)
    found = fim.transform(docs, texts=True, **options)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "output", "restored_sha256"]
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=str) == want
    whole = fim.restore(found)
    assert whole.where(F.sha2(F.col("restored").cast("binary"), 256) != F.col("restored_sha256")).count() == 0 and whole.where("restored is null").count() == 0
    assert fim.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fim_marks_lie_across_pieces():
    for form, order in (("psm", (0, 2, 1)), ("spm", (2, 0, 1))):
        marks = [b"<P>", b"<S>", b"<M>"]
        body = {0: b"a<P", 1: b"<", 2: b"xx<M"}
        out = b"".join(marks[(0, 2, 1)[k]] + body[k] for k in order)
        for size in (1, 2, 5, 100):
            parts = fim._parts(form, marks)
            next(parts)
            found = {0: b"", 1: b"", 2: b""}
            for at in [*range(0, len(out), size), None]:
                for k, data in parts.send(None if at is None else out[at : at + size]):
                    found[k] += data
            assert found == body
    for marks in (("", "b", "c"), ("a", "a", "b"), ("xax", "b", "c"), ("ab", "bc", "d"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            fim.transform(None, marks=marks)


def test_fim_restore_refuses_what_does_not_fit(spark):
    rows = spark.createDataFrame([("<P>a<S>b<M>c", "psm"), ("<S>b<P>a<M>c", "psm"), ("abc", "spm"), (None, "plain")], "output string, form string")
    assert [r.restored for r in fim.restore(rows).collect()] == ["acb", None, None, None]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_fim_equals_its_sql(spark):
    found = fim.op13_fim(spark, DATA)
    rows = duckdb.sql(fim.SQL.replace("FROM documents", f"FROM '{DATA}/documents.parquet'"))
    assert sorted(rows.columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*rows.columns).collect())) == sorted(rows.fetchall())


def charpoly_by_minors(a):
    """Faddeev and LeVerrier's recurrence in integers."""
    d = len(a)
    m, c = [[0] * d for _ in range(d)], [0] * d + [1]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        c[d - k] = -sum(a[i][t] * m[t][i] for i in range(d) for t in range(d)) // k
    return c


def test_characteristic_polynomial_is_exact(spark):
    r = random.Random(2)
    for d, rank in ((1, 1), (2, 1), (4, 4), (7, 5), (9, 9)):
        x = np.array([[r.randint(-10**6, 10**6) for _ in range(d)] for _ in range(rank)], object)
        a = (x.T @ x).tolist()
        c = whitening.charpoly(spark, a)
        assert c == charpoly_by_minors(a)
        assert next(k for k, v in enumerate(c) if v) == d - rank
    blocks = [[4, 0, 0], [0, 0, 0], [0, 0, 9]]  # columns without a pivot
    assert whitening.charpoly(spark, blocks) == [0, 36, -13, 1]


def test_roots_are_isolated_with_their_multiplicity():
    poly = [1]
    for root in (0, 3, 3, 5, 5 + 10**9):  # multiply by (x - root)
        poly = [(poly[k - 1] if k else 0) - root * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    found = [m / 2**s for m, s in whitening.largest_roots(poly, 9)]
    assert np.allclose(found, [5 + 10**9, 5, 3, 3], rtol=1e-15)
    assert [whitening.roots_beyond(poly, 3, 0), whitening.roots_beyond(poly, 5, 1)] == [2, 4]
    close = [(10**30) ** 2 + 10**30, -(2 * 10**30 + 1), 1]  # 10^30 and its successor
    (a, s), (b, t) = whitening.largest_roots(close, 2)
    assert round(a / 2**s) == 10**30 or a >> s in (10**30, 10**30 + 1)
    assert (a << t) - (b << s) > (1 << s + t) // 2


def whiten_brute(rows, count):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    return n, [(i, int(((n * x - s) ** 2).sum()), (x - s / n) @ u / np.sqrt(e)) for i, x in kept], e / np.trace(c.T @ c / n)


def as_vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "w", 2, 3) for i, v in rows], "vec_id long, embedding array<double>, n long, whitened string, x int, component int")


def test_whitening_equals_dense_eigenvectors(spark):
    r = np.random.default_rng(5)
    mixed = r.normal(size=(300, 6)) @ np.diag([3, 2, 1.5, 1, 0.5, 0.2]) @ r.normal(size=(6, 6))
    rows = [(i, v) for i, v in enumerate(mixed.tolist())] + [(500 + i, mixed[0].tolist()) for i in range(150)] + [(None, mixed[1].tolist()), (7, None), (8, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (9, [math.nan] * 6), (10, [math.inf] * 6), (11, [-math.inf] + [0.0] * 5)]
    n, want, shares = whiten_brute(rows, 4)
    got = whitening.whiten(as_vectors(spark, rows)).collect()
    assert len(got) == 4 * len(want)
    by = {}
    for g in got:
        by.setdefault((g.vec_id, g.component), []).append(g)
    signs = {}
    for i, deviation, white in want:
        for k in range(4):
            for g in by[i, k + 1]:
                sign = signs.setdefault(k, 1 if g.whitened * white[k] > 0 else -1)
                assert (g.n, g.deviation) == (n, deviation) and abs(sign * g.whitened - white[k]) < 1e-8
                assert abs(g.explained / shares[k] - 1) < 1e-9 and g.identity_error < 1e-9
    assert len({g.identity_error for g in got}) == 1


def test_whitening_of_ties_lengths_and_degenerate_tables(spark):
    axes = [(i, [float(a), float(b), float(c)]) for i, (a, b, c) in enumerate([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])]
    got = whitening.whiten(as_vectors(spark, axes + [(20, []), (21, [1.0]), (22, [2.0]), (23, [2.5, 2.5]), (24, [2.5, 2.5])])).collect()
    assert sorted({g.vec_id for g in got}) == [*range(6), 21, 22]  # equal vectors have no component
    tied = [g for g in got if g.vec_id < 20]
    assert len(tied) == 18 and all(abs(g.explained - 1 / 3) < 1e-12 and g.identity_error < 1e-9 for g in tied)
    w = np.zeros((6, 3))
    for g in tied:
        w[g.vec_id, g.component - 1] = g.whitened
    assert np.allclose(w.T @ w / 6, np.eye(3))
    assert sorted(g.whitened for g in got if g.vec_id > 20) in ([-1.0, 1.0],)
    assert whitening.whiten(as_vectors(spark, [])).count() == 0
    assert whitening.whiten(as_vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    huge = whitening.whiten(as_vectors(spark, [(1, [1e15, 1.0]), (2, [0.0, 1e300]), (3, [-1e12, 0.0])])).collect()
    assert len(huge) == 6 and all(g.deviation is None and g.identity_error < 1e-6 for g in huge)


def test_scatter_is_exact_for_large_entries(spark):
    r = random.Random(4)
    rows = [[r.randrange(-(1 << 62), 1 << 62), r.randrange(-9, 9), r.randrange(-(1 << 25), 1 << 25)] for _ in range(60)]
    fit = spark.createDataFrame([(x,) for x in rows], "x array<long>").repartition(3)
    n, s, a = whitening.scatters(fit)[3]
    x = np.array(rows, object)
    assert n == 60 and s == x.sum(0).tolist() and a == (60 * (x.T @ x) - np.outer(x.sum(0), x.sum(0))).tolist()
