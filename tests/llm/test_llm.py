"""op1 to op10 on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coaffil.llm import bpe, embedding, exact_dedup, packing, pii, sharding, simhash, suffix_dedup, toxicity, url_filter

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, name string, n long, h long, sha string, id long, fp string, component string, votes int, ids string, g int, bucket int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    a, b = words(120, 1), words(400, 2)
    texts = [(1, a), (2, a), (2, a), (3, a + "\n"), (4, None), (5, ""), (6, "   "), (7, b), (8, b.replace("a", "b", 1)), (9, words(20000, 3)), (None, a), (None, "x"),
             (10, "shared " + b[:300] + " tail"), (11, "é🎉 " + a[:80]), (12, "<|endoftext|> it's  l'été\t 10 ²"), (13, "short")]
    return spark.createDataFrame([(i, t, "c", 1, 2, "s", 9, "f", "k", 0, "i", 3, 4) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_exact_dedup_with_and_without_hash_collisions(docs, empty):
    import re

    want = {}
    for i, t in rows_of(docs):
        want.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for options in ({}, {"block_bytes": 16, "hash_bits": 3}):
        got = exact_dedup.exact_dedup(docs, **options).collect()
        assert len(got) == docs.count()
        by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
        for r in got:
            group = by[r.text_sha256]
            assert r.group_size == len(group) and r.keep_id == min((x for x in group if x is not None), default=None)
        assert sum(r.kept for r in got) == len(by)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_sharding_is_minimax_and_gapless(docs, empty, spark):
    got = sharding.shard(docs, shards=3).collect()
    assert len(got) == docs.count()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.doc_id in (1, 2)}) == 1
    want = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows_of(docs)]
    assert sorted(map(repr, ((r.doc_id, r["size"], r.text_crc32) for r in got))) == sorted(map(repr, want))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert sharding.shard(empty).count() == 0
    r = random.Random(5)
    sizes = [r.randint(0, 30) for _ in range(90)]

    def need(c):
        n, has = 1, 0
        for x in sizes:
            n, has = (n, has + x) if has + x <= c else (n + 1, x)
        return n

    cut = sharding.minimax_units(spark.createDataFrame(list(enumerate(sizes)), "unit long, bytes long"), 7).collect()
    load = {}
    for x in cut:
        load[x.shard] = load.get(x.shard, 0) + x.bytes
    assert max(load.values()) == min(c for c in range(max(sizes), sum(sizes) + 1) if need(c) <= 7) and len(load) <= 7


def test_nearest_smaller_values():
    r = random.Random(6)
    for case in ([], [3], [5, 4, 3, 2, 1], [1, 1, 1], [r.randint(0, 9) for _ in range(300)], list(range(50))):
        want = [max((j for j in range(i) if case[j] < case[i]), default=-1) for i in range(len(case))]
        assert suffix_dedup.nearest_smaller(np.array(case, np.int64)).tolist() == want


def test_suffix_dedup_equals_brute_force(docs, empty):
    rows = [((2**63 - 1) if i is None else i, (t or "").encode()) for i, t in rows_of(docs)]
    first = {}
    for i, b in rows:
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            first[w] = min(first.get(w, i), i)
    want = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((len(b), int(gone.sum()), int(np.diff(gone.astype(int), prepend=0).clip(0).sum()), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.without_repeats(docs).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_simhash_components_equal_brute_force(docs, empty):
    got = simhash.near_dedup(docs).collect()
    assert len(got) == docs.count()
    fps = [int.from_bytes(bytes(r.fp), "big") for r in got]
    label = list(range(len(got)))
    for i in range(len(got)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    for i, r in enumerate(got):
        ids = [g.doc_id for g, x in zip(got, label) if x == label[i] and g.doc_id is not None]
        assert r.component_id == min(ids, default=None)
    assert all(f == 0 for f, r in zip(fps, got) if r.doc_id in (4, 5, 6))
    assert simhash.near_dedup(empty).count() == 0


def test_trie_join_equals_brute_force_on_dense_groups():
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 6))) & (2**64 - 1) for b in base for _ in range(400)})
    x = np.array(fps, np.uint64)[:, None]
    labels = simhash.Trie(np.zeros(len(fps), int), x).join(4)
    d = np.bitwise_count(x ^ x.T) <= 4
    want = np.arange(len(fps))
    while True:
        new = np.array([want[d[i]].min() for i in range(len(fps))])
        if (new == want).all():
            break
        want = new
    assert (labels == want).all()


def test_near_copies_at_similarity_08_are_found(spark):
    r = random.Random(11)
    rows, pairs = [], []
    for k in range(60):
        w = words(300, 100 + k).split()
        rows.append((2 * k, " ".join(w)))
        for at in r.sample(range(300), 6):
            w[at] = "changed"
        rows.append((2 * k + 1, " ".join(w)))
        pairs.append(2 * k)
    got = {x.doc_id: x.component_id for x in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.NEAR_COPIES).collect()}
    assert sum(got[p + 1] == p for p in pairs) >= 57 and all(got[p] == p for p in pairs)


def test_near_copies_equal_brute_force_below_08_and_on_short_texts(spark):
    r = random.Random(12)
    rows = [(900, ""), (901, None), (902, "  "), (903, "two words"), (904, "Two  words"), (905, "two other")]
    for k in range(150):
        w = words(r.randint(5, 20), 500 + k).split()
        rows += [(4 * k, " ".join(w)), (4 * k + 1, " ".join([*w, "more"])), (4 * k + 2, " ".join(["changed", *w[1:]]))]
    rows = [(i + 1000, t) for i, t in rows]
    for k in range(20):  # similarity 0.75 to 0.78: not copies
        w = words(100, 700 + k).split()
        rows.append((5000 + 2 * k, " ".join(w)))
        for at in r.sample(range(5, 95), 3):
            w[at] = "changed"
        rows.append((5001 + 2 * k, " ".join(w)))
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {x: min(i for (i, _), y in zip(rows, label) if y == x) for x in set(label)}
    got = {x.doc_id: x.component_id for x in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.NEAR_COPIES).collect()}
    assert got == {i: least[x] for (i, _), x in zip(rows, label)}


def test_near_copies_among_look_alikes_equal_brute_force(spark, monkeypatch):
    """Groups whose members are mostly below 0.8 to one another: no link is lost, whole groups or in blocks."""
    r = random.Random(13)
    rows = []
    for g in range(8):
        base = words(130, 900 + g).split()
        for _ in range(40):
            w = list(base)
            for at in r.sample(range(130), r.choice([1, 2, 3, 4, 5])):
                w[at] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), rows[5][1].upper()), (len(rows) + 1, rows[5][1])]
    sets = [{tuple(w[a : a + 5]) for a in range(len(w) - 4)} for w in (t.lower().split() for _, t in rows)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert len(set(label)) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (simhash.BLOCK, 2000):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {x.doc_id: x.component_id for x in simhash.near_dedup(df, **simhash.NEAR_COPIES).collect()}
        assert got == {i: label[i] for i in range(len(rows))}


def test_trie_join_where_with_many_equal_fingerprints(monkeypatch):
    """Rows of one fingerprint are compared a bounded number of pairs at once; only pairs that hold are linked."""
    monkeypatch.setattr(simhash, "CHUNK", 1000)
    kind = np.arange(300) % 7
    labels = simhash.Trie(np.zeros(300, int), np.full((300, 1), 5, np.uint64)).join_where(4, lambda i, j: kind[i] == kind[j])
    assert (labels == kind).all()


def test_embedding_vectors_link_among_their_own_length(spark):
    r = np.random.default_rng(2)
    a, b = r.standard_normal(16), r.standard_normal(5)
    rows = [(1, a), (2, a + 0.01), (3, r.standard_normal(17)), (4, b), (5, b * 2 + 0.01), (6, np.append(a, 0.0)), (7, a * 3)]
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {g.vec_id: (g.n_links, g.component_id) for g in embedding.embedding_near_dedup(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 7: (2, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def brute_links(rows):
    """(links, smallest id reachable) of rows (id, vector, label), whatever the label's type."""
    unit = [v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for _, v, _ in rows]
    link = np.array([[i != j and a[2] == b[2] and len(a[1]) == len(b[1]) and float(unit[i] @ unit[j]) >= 0.93 for j, b in enumerate(rows)] for i, a in enumerate(rows)])
    group = np.arange(len(rows))
    while True:
        new = np.array([min(group[i], group[link[i]].min(initial=len(rows))) for i in range(len(rows))])
        if (new == group).all():
            return [(int(n), min(rows[j][0] for j in np.flatnonzero(group == g))) for n, g in zip(link.sum(1), group)]
        group = new


def as_vectors(spark, rows, kind):
    return spark.createDataFrame([(i, [float(c) for c in v], y, "e") for i, v, y in rows], f"vec_id long, embedding array<double>, label {kind}, id string")


def by_id(df):
    return sorted((r.vec_id, r.n_links, r.component_id) for r in df.collect())


def test_embedding_links_equal_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 16))
    x = np.vstack([base, base[:10] + 0.05 * r.standard_normal((10, 16)), base[:5], base[5:8] * 1e200, base[8:10] * 1e-200])
    # Repeated ids hold different vectors; labels are fractions, then strings.
    for kind, name in (("double", lambda k: 1.2 + k / 2), ("string", lambda k: f"topic {k}")):
        rows = [(i // 2 if i < 20 else i, v, name(i % 2 if i < 40 else (i - 40) % 10 % 2)) for i, v in enumerate(x)]
        want = sorted((i, n, c) for (i, _, _), (n, c) in zip(rows, brute_links(rows)))
        assert by_id(embedding.embedding_near_dedup(as_vectors(spark, rows, kind))) == want
    odd = [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] + [1.0] * 15, 0), (103, [1.0] * 16, None), (104, [1.0, None] * 8, 1), (105, [], 1), (None, [1.0] * 16, 0), (106, [1.0] * 16, 0)]
    df = spark.createDataFrame([(*t, 5, 6, 7) for t in odd], "vec_id long, embedding array<float>, label int, g int, n int, cell int")
    got = embedding.embedding_near_dedup(df)
    assert all(g.n_links == 0 and g.kept and g.component_id == g.vec_id for g in got.collect()) and got.count() == 8
    assert embedding.embedding_near_dedup(df.limit(0)).count() == 0


def test_embedding_ties_at_the_threshold(spark):
    rows = [(1, np.array([1.0, 0.0]), 0), (2, np.array([93.0, math.sqrt(100**2 - 93**2)]), 0), (3, np.array([0.0, 1.0]), 0), (4, np.array([92.9, math.sqrt(100**2 - 92.9**2)]), 1), (5, np.array([1.0, 0.0]), 1)]
    assert by_id(embedding.embedding_near_dedup(as_vectors(spark, rows, "int"))) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5)]


def test_embedding_dense_topic_in_blocks_and_passes(spark):
    """One label of a crowded cone, with planted pairs and a group larger than a block."""
    r = np.random.default_rng(3)
    centre = r.standard_normal(32)
    centre /= np.linalg.norm(centre)

    def off(v, c):
        w = r.standard_normal(32)
        w -= v * (w @ v)
        return c * v + math.sqrt(1 - c * c) * w / np.linalg.norm(w)

    x = [off(centre, 0.85) for _ in range(1200)]
    x += [off(v, 0.96) for v in x[:150]] + [off(x[1199], 0.999) for _ in range(300)]
    rows = [(i, v, "t") for i, v in enumerate(x)]
    want = [(i, n, c) for (i, _, _), (n, c) in zip(rows, brute_links(rows))]
    df = as_vectors(spark, rows, "string")
    assert by_id(embedding.embedding_near_dedup(df)) == want
    assert by_id(embedding.embedding_near_dedup(df, block=200)) == want
    old, embedding.MOVE = embedding.MOVE, 20  # moving is cheap: many passes of short windows
    try:
        got = by_id(embedding.embedding_near_dedup(df, block=200))
    finally:
        embedding.MOVE = old
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)


def test_bpe_round_trip_is_the_librarys(docs, empty):
    t = Tokenizer.from_file(BYTE)
    for size in (1 << 18, 4):
        got = bpe.encode(docs, BYTE, table_rows=size, decoded=True)
        want = sorted((t.encode(x or "", add_special_tokens=False).ids, x or "") for _, x in rows_of(docs))
        assert sorted((list(r.ids), r.decoded) for r in got.collect()) == want
    assert {r.decoded for r in bpe.decode(got.select("doc_id", "ids"), BYTE).collect()} == {x or "" for _, x in rows_of(docs)}
    assert bpe.encode(empty, BYTE).count() == 0


def test_packing_places_every_id_once(docs, empty):
    t = Tokenizer.from_file(WORD)
    got = packing.pack(docs, WORD, window_tokens=3000, capacity=512).collect()
    seq, crc = {}, {}
    for r in got:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        crc.setdefault(r.doc_id, []).append(r)
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 512 and (at == 512 or at & (at - 1) == 0)
    ids = t.encode(rows_of(docs)[9][1], add_special_tokens=False).ids + [2]
    for r in crc[9]:
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in got) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows_of(docs))
    assert packing.pack(empty, WORD).count() == 0


def test_packing_cuts_every_document_gaplessly(docs):
    t = Tokenizer.from_file(WORD)
    rows = [(k, x) for k, (_, x) in enumerate(rows_of(docs))]
    got = packing.pack(docs.sparkSession.createDataFrame(rows, "doc_id long, text string"), WORD, window_tokens=3000, capacity=512).collect()
    for k, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted((p for p in got if p.doc_id == k), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_packing_puts_whole_documents_where_the_cost_is_least():
    r = random.Random(13)
    lengths = np.array([r.randint(1, 90) for _ in range(200)], np.int64)
    cap, quadratic = 64, 1 / 64
    pieces = packing.pack_lengths(lengths, cap, 1.0, quadratic)
    total = int(lengths.sum())
    room = [cap] * (total // cap) + sorted((1 << b for b in range(6) if total % cap >> b & 1), reverse=True)
    cost, left, order = [0.0] * len(room), lengths.tolist(), []
    whole = 0
    for doc, start, n, seq, _ in pieces:
        if doc not in order:
            order.append(doc)
        want = min(left[doc], cap)
        fits = [s for s in range(len(room)) if room[s] >= want]
        if fits:  # never cut while a sequence can take the rest whole
            whole += 1
            assert n == want and cost[seq] == min(cost[s] for s in fits)
        assert start == lengths[doc] - left[doc] and n <= room[seq]
        room[seq] -= n
        left[doc] -= n
        cost[seq] += n + quadratic * n * n
    assert not any(room) and not any(left) and whole > 100
    assert [int(lengths[d]) for d in order] == sorted(lengths.tolist(), reverse=True)


def test_pii_base_spans_and_redaction(spark, docs, empty):
    text = "mail a.b@c-d.org, ip 10.0.0.255 or 10.0.0.256, card 4111 1111 1111 1111, call +1 (555) 123-4567 é " + "9 " * 3000
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "1" * 20000)], "doc_id long, text string")
    got = {r.doc_id: [(pii.KINDS[s.kind], s.s, s.e) for s in r.pii_base] for r in pii.pii_spans(df).collect()}
    assert [(k, text[a:b]) for k, a, b in got[1]] == [("email", "a.b@c-d.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    assert got[2] == got[3] == got[4] == []
    clean = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert clean[1].startswith("mail [EMAIL], ip [IP] or 10.0.0.256, card [CARD], call [PHONE] é") and clean[2] is None
    assert pii.redacted(docs).columns == docs.columns and pii.redacted(empty).count() == 0


def base_spans(text):
    """The contract's base spans by Python's re: (kind, start, end), by kind."""
    import re

    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 16 <= len(d) <= 19 and luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 8 <= len(d) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0], re.sub("[^0-9]", "", m[0]))]


def test_pii_base_spans_equal_brute_force(spark):
    r = random.Random(8)
    bits = ["a@b.c", "x.y+z@h-h.org.", "@", ".", "10.0.0.1", "300.1.2.3", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 555 123 4567", "+12", "é", "🎉", " ", "  ", "-", "(", "9", "word ", "call "]
    texts = ["".join(r.choices(bits, k=r.randint(0, 30))) for _ in range(400)] + ["9." * 30000, "a@" * 3000, "+1 " * 4000, None, ""]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], "doc_id int, text string, pii_scan int, _raw int, PII_SCAN_ string")
    got = pii.pii_spans(df)
    assert got.columns == [*df.columns, "pii_base", "pii_spans"]
    for x in got.collect():
        base = [(s.kind, s.s, s.e) for s in x.pii_base]
        assert base == base_spans(texts[x.doc_id] or "")
        more = {(s.kind, s.s, s.e) for s in x.pii_spans} - set(base)
        assert set(base) <= {(s.kind, s.s, s.e) for s in x.pii_spans}
        apart = [(s, e) for _, s, e in [*more, *base]]
        assert all(e <= s2 or e2 <= s for _, s, e in more for s2, e2 in apart if (s, e) != (s2, e2))


def test_pii_learns_forms_that_the_base_patterns_miss(spark):
    r = random.Random(9)
    n = lambda k: "".join(r.choices("0123456789", k=k))
    rows = []
    for i in range(600):
        rows.append((i, f"call +1 555 {n(3)} {n(4)} or mail joe{i}@site{i}.org, room {n(3)} {n(3)} 9, on 20{n(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}"))
    rows += [(1000, "call 212 555 0123 now"), (1001, "mail joe77 [at] site [dot] org please"), (1002, "on 2024-01-02 here"), (1003, "host 10[.]0[.]0[.]7 down"), (1004, "joe at home. Then we met at noon")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {x.doc_id: [(pii.KINDS[s.kind], s.s, s.e) for s in x.pii_spans] for x in pii.pii_spans(df).where("doc_id >= 1000").collect()}
    assert got[1000] == [("phone", 5, 17)] and [k for k, _, _ in got[1001]] == ["email"] and got[1002] == [] and got[1004] == []
    limits = pii.fit(pii.Scan(df, "text"))[2]
    assert limits[0] < float("inf") and limits[3] < float("inf")
    names = spark.createDataFrame([("mail a@b.org", "p", "q", "o")], "text string, pii_base string, pii_spans string, _order string")
    assert [tuple(x) for x in pii.redacted(names).collect()] == [("mail [EMAIL]", "p", "q", "o")]


def test_url_rules(spark):
    urls = [(1, "https://A.Example.ORG/en/12"), (2, "http://x.example.org/es/1?q"), (3, "http://example.com/fr/"), (4, "http://a.com/de/1"), (5, "nothing"), (6, None), (7, "http://notorg/en/1"), (8, "http://x.net#f")]
    got = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame([(*u, "h", "t") for u in urls], "page_id long, url string, host string, template string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in (1, 2, 3, 4)] == [
        ("a.example.org", "/en/12", "example.org/en/1"), ("x.example.org", "/es/1", "example.org/es/"), ("example.com", "/fr/", "com/fr/"), ("a.com", "/de/1", "com/de/")]
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["block", "block", "allow", "block"]
    assert (got[5].host, got[5].path, got[6].host, got[7].rule, got[8].host) == ("", "", "", None, "x.net")
    assert len(got) == 8


def test_url_tree_equals_its_sql(spark, tmp_path):
    import duckdb

    r = random.Random(4)
    hosts = ["a.example.org", "b.example.org", "c.com", "d.com", "e.net", "f.net", "g.io"]
    urls = ["http://%s/%s" % (r.choice(hosts), "/".join([r.choice(["en", "es", "de", "fr"]), *r.choices(["x", "y", "1", "22", "long-slug", "*"], k=r.randint(0, 9))])) for _ in range(600)]
    urls += [None, "", "no scheme", "http://", "http://e.net", "http://e.net/", "http://e.net/" + "deep/" * 400, "http://e.net/" + "deep/" * 399 + "x", *urls[:50]]
    df = spark.createDataFrame([(i // 2, u, "h", "n", "c", 3) for i, u in enumerate(urls)], "page_id long, url string, host string, node string, child string, n int")
    got = url_filter.url_filter(df).collect()
    df.select("page_id", "url").coalesce(1).write.parquet(str(tmp_path / "p"))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/p/*.parquet'")
    key = lambda t: tuple(map(str, t))
    want = c.execute(f"select page_id, host, path, rule, verdict from ({url_filter.SQL})").fetchall()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and len(got) == len(urls)
    assert {x.verdict for x in got if x.rule is None} == {"allow", "block"}
    assert url_filter.url_filter(df.limit(0)).count() == 0


def test_label_model_estimates_accuracies_without_labels():
    r = np.random.default_rng(14)
    hit, false = r.uniform(0.4, 0.9, toxicity.VOTERS), r.uniform(0.01, 0.08, toxicity.VOTERS)
    y = r.random(40000) < 0.2
    x = r.random((len(y), toxicity.VOTERS)) < np.where(y[:, None], hit, false)
    votes, counts = np.unique(x @ (1 << np.arange(toxicity.VOTERS)), return_counts=True)
    model = toxicity.LabelModel(dict(zip(votes.tolist(), counts.astype(float).tolist())), {})
    assert abs(model.prior - y.mean()) < 0.02
    assert np.abs(model.rate[1] - hit).max() < 0.05 and np.abs(model.rate[0] - false).max() < 0.03
    said = model.of(x @ (1 << np.arange(toxicity.VOTERS))) > 0.5
    assert (said == y).mean() > 0.98
    # A voter that repeats another's votes shares its evidence with it; the others keep nearly all of theirs.
    x[:, 1] = x[:, 0]
    votes, counts = np.unique(x @ (1 << np.arange(toxicity.VOTERS)), return_counts=True)
    weight = toxicity.LabelModel(dict(zip(votes.tolist(), counts.astype(float).tolist())), {}).weight
    assert weight[:2].max() < 0.6 and weight[2:].min() > 0.75


def test_toxicity_learns_rare_terms_from_all_labels(spark):
    rows = [(i, words(20, i) + (" zorgle plimf" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(2000)]
    train = [i for i in range(2001, 2100) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows += [(i, words(20, i) + " quaxorb", 1) for i in train[:4]]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    new = spark.createDataFrame([(9000, words(20, 9000) + " quaxorb"), (9001, words(20, 9001))], "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.toxicity(df.select("doc_id", "text").unionByName(new), df.select("doc_id", "toxic"), most_sample=200).collect()}
    assert got[9000].predicted == 1 and got[9001].predicted == 0 and len(got) == len(rows) + 2
    terms = spark.createDataFrame([(f"t{i}", 5, 0) for i in range(5000)], "term string, toxic long, clean long")
    assert len(toxicity.mine(terms, 5000, 5000)) == 5000


def test_toxicity_learns_and_survives_odd_rows(spark, docs, empty):
    r = random.Random(3)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, words(40, i) + (" zorgle" + r.choice("abcdef") + " zorgle" + r.choice("ghij") if toxic else ""), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    held = [(i, t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held) and sum(got[i].predicted == t for i, t in held) >= 0.95 * len(held)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == docs.count()
    assert toxicity.toxicity(empty, labels).count() == 0


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    a = words(200, 1)
    rows = [(1, a, "en", "s", 9), (2, a + " ", "en", "s", 9), (2, a, "en", "s", 9), (3, a.replace("a", "b", 1), "en", "s", 9), (4, "write to me@x.org", "en", "s", 1), (5, None, None, None, None), (6, words(90, 2), "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns
    left = {r.doc_id: r.text for r in seen.collect()}
    assert sorted(left) == [1, 4, 5, 6] and left[4] == "write to [EMAIL]"
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 4, 5, 6}


def test_url_trees_are_each_hosts_own(spark):
    """A host without labels isn't judged by another's; siblings are told apart; digits differ from the merged branch."""
    rules = [("block", "bad.com", "/de/"), ("block", "mix.com", "/1"), ("allow", "mix.com", "/shop/"), ("block", "mix.com", "/cards/"), ("allow", "mix.com", "/a")]
    urls = [f"http://bad.com/de/{k}" for k in range(30)] + ["http://bad.com/other/page"]
    urls += [f"http://good.net/x{k}/y" for k in range(20)] + [f"http://other.io/{k}" for k in range(4)]
    urls += [f"http://mix.com/shop/{w}" for w in ("a", "b", "c", "d", "e")] * 8 + [f"http://mix.com/cards/{k}" for k in range(40)] + ["http://mix.com/new/page"]
    urls += [f"http://mix.com/{100 + k}" for k in range(40)] + ["http://mix.com/777", "http://mix.com/2", "http://mix.com/about", "http://mix.com/zoo"]
    pages = spark.createDataFrame(list(enumerate([*urls, None, "no scheme", "http://x.y/" + "d/" * 300])), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.url_filter(pages, rules).collect()}
    assert len(got) == len(urls) + 3
    said = {u: got[i].verdict for i, u in enumerate(urls)}
    assert all(v == "allow" for u, v in said.items() if "good.net" in u or "other.io" in u)
    assert said["http://bad.com/other/page"] == "block"  # its own host's purity
    assert said["http://mix.com/777"] == said["http://mix.com/2"] == "block" and got[urls.index("http://mix.com/2")].rule is None  # the digits' branch
    assert said["http://mix.com/zoo"] == "allow" or got[urls.index("http://mix.com/zoo")].rule is None
    assert {got[len(urls) + k].verdict for k in range(3)} == {"allow"}
    # Whatever else is in the table, a host's verdicts are the same.
    alone = {r.url: r for r in url_filter.url_filter(pages.where("url like 'http://mix.com/%'"), rules).join(pages, "page_id").collect()}
    assert all(said[u] == r.verdict for u, r in alone.items())
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0


def test_urls_that_end_at_a_node_are_one_of_its_branches(spark, tmp_path):
    import duckdb

    # Host 1/5 = .2, first branch (1 + 4 x .2) / 5 = .36, second .488; /en/1/ goes on from there, merged with the
    # urls that end: (1 + 4 x .488) / 5 = .5904.
    urls = [f"http://a.com/{x}" for x in ("de/1", "en/2", "en/3.html", "es/4", "en/5/")]
    r = random.Random(14)
    urls += [f"http://h{h}.com/" + "/".join(r.choices(["de", "en", "fr", "1", ""], k=r.randint(1, 4))) for h in range(80) for _ in range(r.randint(2, 30))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: tuple(x) for x in url_filter.url_filter(pages).collect()}
    assert [got[i][4] for i in range(5)] == ["block", "allow", "allow", "allow", "block"]
    pages.write.parquet(str(tmp_path / "p"))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/p/*.parquet'")
    assert {x[0]: x for x in c.execute(f"select page_id, host, path, rule, verdict from ({url_filter.SQL})").fetchall()} == got
    assert len(got) == len(urls)
