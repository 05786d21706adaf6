"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller
id.  Every such string has a minimizer: the least hash among its substrings of ``GRAM`` bytes.  Equal
strings have equal minimizers, so the corpus splits by minimizer into small texts whose suffixes can
be sorted on their own:

1. Tasks send the distinct minimizers of their documents, packed, to buckets; the buckets answer
   which of them occur in more than one document.
2. Documents meet the answers, and strings with such a minimizer are sent, as segments of text, to
   the minimizer's bucket.
3. There the suffixes are sorted by prefix doubling to depth ``length``.  The previous and the next
   position of a smaller document in suffix order give a suffix's longest previous factor; its
   string goes if that factor reaches ``length``.
4. The found places go back to the documents and are cut out.

Equal texts are one document for all this; only copies with a larger id are removed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import land

GRAM = 16
_LAST = 2**63 - 1


def _pack(values: np.ndarray) -> bytes:
    """An integer array, byte planes apart, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as one number each; places beyond the end read zeros."""
    n = len(data)
    padded = data + b"\0" * 16
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        k = (n - o + 7) // 8
        out[o::8] = np.frombuffer(padded, ">u8", k, o)
    return out


def minimizers(data: bytes, length: int) -> np.ndarray:
    """For each string of ``length`` bytes its minimizer (48 bits)."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    e = _eights(data)
    n = len(data) - GRAM + 1
    h = e[:n] * np.uint64(0x9E3779B97F4A7C15) ^ e[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    wide, have = length - GRAM + 1, 1
    while have < wide:
        step = min(have, wide - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h & np.uint64(2**48 - 1)


def _changes(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def nearest_smaller(order: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it whose value is smaller, or -1.

    Candidates jump to their own candidates: what lies between is not smaller, so nothing is passed over.
    """
    low = np.append(np.iinfo(np.int64).min, order)  # a sentinel in front
    near = np.arange(-1, len(order))
    near[0] = 0
    todo = np.arange(1, len(low))
    while len(todo):
        todo = todo[low[near[todo]] >= low[todo]]
        near[todo] = near[near[todo]]
    return near[1:] - 1


def repeated(data: bytes, begins: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each window start in ``begins`` whether its longest previous factor in a window of smaller ``order`` reaches ``length``."""
    ranks = np.unique(_eights(data), return_inverse=True)[1].ravel().astype(np.uint64)
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        if depth + step == length:  # the last round needs the window starts alone
            pairs = ranks[begins] << np.uint64(32) | ranks[begins + step]
        else:
            pairs = ranks << np.uint64(32) | np.append(ranks[step:], np.zeros(step, np.uint64))
        ranks = np.unique(pairs, return_inverse=True)[1].ravel().astype(np.uint64)
        depth += step
    suffixes = np.argsort(ranks, kind="stable")
    rank, at = ranks[suffixes], order[suffixes]
    # Of all earlier windows the previous and the next in suffix order share the longest prefix with a
    # window; prefixes within a run of equal ranks reach ``length``, others don't.
    before = nearest_smaller(at)
    after = len(at) - 1 - nearest_smaller(at[::-1])[::-1]
    found = (before >= 0) & (rank[before] == rank)
    found |= (after < len(at)) & (rank[np.minimum(after, len(at) - 1)] == rank)
    out = np.empty(len(begins), bool)
    out[suffixes] = found
    return out


def _chunks(batches: Iterator[pa.RecordBatch], most: int = 24 << 20) -> Iterator[dict[bytes, tuple[int, bytes]]]:
    """Documents by digest: (smallest id, text), a bounded number of bytes at a time."""
    docs: dict[bytes, tuple[int, bytes]] = {}
    held = 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_py()
            sha = hashlib.sha256(data).digest()
            if sha not in docs:
                held += len(data)
                docs[sha] = (i, data)
            elif i < docs[sha][0]:
                docs[sha] = (i, data)
            if held >= most:
                yield docs
                docs, held = {}, 0
    if docs:
        yield docs


def _ref(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "big", signed=True)


def _rows(names: list[str], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(len(names))], schema=schema)


_REQUEST = pa.schema([("bucket", pa.int64()), ("answer", pa.bool_()), ("keys", pa.binary()), ("groups", pa.binary())])
_ANSWER = pa.schema([("g", pa.int64()), ("keys", pa.binary())])
_PACK = pa.schema([("g", pa.int64()), ("sha", pa.binary()), ("first", pa.int64()), ("z", pa.binary())])
_SEGMENT = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("lengths", pa.binary()), ("refs", pa.binary()), ("firsts", pa.binary()), ("text", pa.binary())])
_PLACE = pa.schema([("g", pa.int64()), ("refs", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
_RESULT = pa.schema([("sha", pa.binary()), ("first", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("digest", pa.binary()), ("kept", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def removals(texts: DataFrame, length: int = 50, with_text: bool = True, bytes_total: int | None = None) -> DataFrame:
    """(sha, first, n_removed, n_spans, SHA-256 digest of what remains, kept: what remains or null) for each distinct text of (id long, text binary)."""
    if bytes_total is None:
        bytes_total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = max(8, bytes_total >> 24), max(8, bytes_total // 10_000_000)

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, docs in enumerate(_chunks(batches)):
            keys, where = [], []
            for sha, (_, data) in docs.items():
                k = minimizers(data, length)
                if len(k):
                    k = np.unique(k[_changes(k)])
                    keys.append(k)
                    where.append(np.full(len(k), _ref(sha) % groups, np.uint32))
            if not keys:
                continue
            keys, where = np.concatenate(keys), np.concatenate(where)
            order = np.argsort(keys, kind="stable")
            keys, where = keys[order], where[order]
            heads = _changes(keys)
            several = np.diff(np.append(heads, len(keys))) > 1
            # Minimizers of several documents here are answered at once; the buckets just learn of them.
            known = np.repeat(several, np.diff(np.append(heads, len(keys))))
            rows = []
            for g in np.unique(where[known]).tolist():
                rows.append((buckets + (g * 31 + n) % buckets, True, _pack(np.unique(keys[known & (where == g)])), _pack(np.array([g], np.uint32))))
            one, at = keys[heads], np.where(several, np.uint32(2**32 - 1), where[heads])
            cut = np.searchsorted(_bucket(one, buckets), np.arange(buckets + 1))
            for b in range(buckets):
                if cut[b] < cut[b + 1]:
                    part = one[cut[b] : cut[b + 1]]
                    rows.append((b, False, _pack(np.diff(part, prepend=np.uint64(0))), _pack(at[cut[b] : cut[b + 1]])))
            yield _rows(_REQUEST.names, rows, _REQUEST)

    def answers(table: pa.Table) -> pa.Table:
        rows, keys, where = [], [], []
        for r in table.to_pylist():
            if r["answer"]:
                rows.append((int(_unpack(r["groups"], np.uint32)[0]), r["keys"]))
            else:
                keys.append(np.cumsum(_unpack(r["keys"], np.uint64), dtype=np.uint64))
                where.append(_unpack(r["groups"], np.uint32))
        if keys:
            keys, where = np.concatenate(keys), np.concatenate(where)
            order = np.argsort(keys, kind="stable")
            keys, where = keys[order], where[order]
            heads = _changes(keys)
            sizes = np.diff(np.append(heads, len(keys)))
            several = (sizes > 1) | (where[heads] == 2**32 - 1)
            keep = np.repeat(several, sizes) & (where != 2**32 - 1)
            keys, where = keys[keep], where[keep]
            order = np.lexsort((keys, where))
            keys, where = keys[order], where[order]
            heads = _changes(where)
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(where)]):
                rows.append((int(where[a]), _pack(np.unique(keys[a:b]))))
        return pa.Table.from_batches([_rows(_ANSWER.names, rows, _ANSWER)])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for docs in _chunks(batches):
            rows = [(_ref(sha) % groups, sha, i, squeeze.compress(data)) for sha, (i, data) in docs.items()]
            for at in range(0, len(rows), 2000):
                yield _rows(_PACK.names, rows[at : at + 2000], _PACK)

    def merged(table: pa.Table) -> dict[bytes, tuple[int, bytes]]:
        docs: dict[bytes, tuple[int, bytes]] = {}
        for sha, first, z in zip(*(table.column(c).to_pylist() for c in ("sha", "first", "z"))):
            docs[sha] = (min(first, docs[sha][0]) if sha in docs else first, z)
        return docs

    def segments(left: pa.Table, right: pa.Table) -> pa.Table:
        answered = [_unpack(k, np.uint64) for k in right.column("keys").to_pylist()]
        shared = np.unique(np.concatenate(answered)) if answered else np.empty(0, np.uint64)
        expand = zstandard.ZstdDecompressor()
        found: list[tuple] = []  # keys, starts, lengths, document number
        refs, firsts, texts_ = [], [], []
        for sha, (first, z) in merged(left).items() if len(shared) else ():
            data = expand.decompress(z)
            k = minimizers(data, length)
            if not len(k):
                continue
            heads = _changes(k)
            ends = np.append(heads[1:], len(k))
            key = k[heads]
            at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
            hit = shared[at] == key
            if hit.any():
                found.append((key[hit], heads[hit], ends[hit] - heads[hit] + length - 1, np.full(int(hit.sum()), len(refs))))
                refs.append(_ref(sha))
                firsts.append(first)
                texts_.append(data)
        rows = []
        if found:
            key, start, size, doc = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(_bucket(key, buckets), kind="stable")
            key, start, size, doc = key[order], start[order], size[order], doc[order]
            cut = np.searchsorted(_bucket(key, buckets), np.arange(buckets + 1))
            squeeze = zstandard.ZstdCompressor(level=3)
            refs, firsts = np.array(refs, np.int64), np.array(firsts, np.int64)
            for b in range(buckets):
                part = slice(cut[b], cut[b + 1])
                if cut[b] < cut[b + 1]:
                    used, number = np.unique(doc[part], return_inverse=True)
                    text = b"".join([texts_[d][s : s + n] for d, s, n in zip(doc[part].tolist(), start[part].tolist(), size[part].tolist())])
                    rows.append((b, _pack(key[part]), _pack(number.astype(np.uint32)), _pack(start[part]), _pack(size[part].astype(np.uint32)), _pack(refs[used]), _pack(firsts[used]), squeeze.compress(text)))
        return pa.Table.from_batches([_rows(_SEGMENT.names, rows, _SEGMENT)])

    def places(table: pa.Table) -> pa.Table:
        parts, texts_ = [], []
        expand = zstandard.ZstdDecompressor()
        for r in table.to_pylist():
            number = _unpack(r["docs"], np.uint32)
            parts.append((_unpack(r["keys"], np.uint64), _unpack(r["starts"], np.int64), _unpack(r["lengths"], np.uint32).astype(np.int64), _unpack(r["refs"], np.int64)[number], _unpack(r["firsts"], np.int64)[number]))
            texts_.append(expand.decompress(r["text"]))
        key, start, size, ref, first = (np.concatenate(c) for c in zip(*parts))
        text = np.frombuffer(b"".join(texts_), np.uint8)
        offset = np.cumsum(size) - size
        order = np.lexsort((first, key))
        # Minimizers met in one document only can't match; the rest is sorted a bounded part at a time.
        heads = _changes(key[order])
        counts = np.diff(np.append(heads, len(order)))
        mixed = np.minimum.reduceat(first[order], heads) < np.maximum.reduceat(first[order], heads)
        order = order[np.repeat(mixed, counts)]
        out: list[tuple] = []
        if len(order):
            heads = _changes(key[order])
            load_ = np.cumsum(size[order])
            # A part ends with a minimizer's last segment after about two million bytes.
            block = load_[np.append(heads[1:], len(order)) - 1] // 2_000_000
            ends = np.append(heads[1:], len(order))[np.append(np.flatnonzero(np.diff(block)), len(block) - 1)]
            a = 0
            for b in ends.tolist():
                seg = order[a:b]
                a = b
                n = size[seg]
                base = np.cumsum(n) - n
                idx = np.repeat(offset[seg] - base, n) + np.arange(int(n.sum()))
                data = text[idx].tobytes()
                windows = n - length + 1
                which = np.repeat(np.arange(len(seg)), windows)
                inside = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
                gone = repeated(data, base[which] + inside, first[seg][which], length)
                if gone.any():
                    w, i = which[gone], inside[gone]
                    new = np.ones(len(w), bool)
                    new[1:] = (w[1:] != w[:-1]) | (i[1:] != i[:-1] + 1)
                    h = np.flatnonzero(new)
                    last = np.append(h[1:], len(w)) - 1
                    out.append((ref[seg][w[h]], start[seg][w[h]] + i[h], start[seg][w[h]] + i[last] + length))
        rows = []
        if out:
            ref, begin, end = (np.concatenate(c) for c in zip(*out))
            g = ref % groups
            order = np.argsort(g, kind="stable")
            ref, begin, end, g = ref[order], begin[order], end[order], g[order]
            heads = _changes(g)
            rows = [(int(g[a]), _pack(ref[a:b]), _pack(begin[a:b]), _pack(end[a:b])) for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(g)])]
        return pa.Table.from_batches([_rows(_PLACE.names, rows, _PLACE)])

    def results(left: pa.Table, right: pa.Table) -> pa.Table:
        spans: dict[int, list] = {}
        for r in right.to_pylist():
            ref, a, b = (_unpack(r[c], np.int64) for c in ("refs", "a", "b"))
            order = np.argsort(ref, kind="stable")
            ref, a, b = ref[order], a[order], b[order]
            heads = _changes(ref)
            for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(ref)]):
                spans.setdefault(int(ref[x]), []).append((a[x:y], b[x:y]))
        expand = zstandard.ZstdDecompressor()
        rows = []
        for sha, (first, z) in merged(left).items():
            kept, removed, runs = expand.decompress(z), 0, 0
            if found := spans.get(_ref(sha)):
                edge = np.zeros(len(kept) + 1, np.int32)
                for a, b in found:
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(kept, np.uint8)[~gone].tobytes()
            rows.append((sha, first, removed, runs, hashlib.sha256(kept).digest(), kept if with_text else None))
        return pa.Table.from_batches([_rows(_RESULT.names, rows, _RESULT)] if rows else [], _RESULT)

    packed = texts.select("id", "text").mapInArrow(packs, _ddl(_PACK))
    asked = texts.select("id", "text").mapInArrow(requests, _ddl(_REQUEST))
    answered = land(asked.groupBy("bucket").applyInArrow(answers, _ddl(_ANSWER)))
    sent = packed.groupBy("g").cogroup(answered.groupBy("g")).applyInArrow(segments, _ddl(_SEGMENT))
    found = land(sent.groupBy("bucket").applyInArrow(places, _ddl(_PLACE)))
    return packed.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(results, _ddl(_RESULT))


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary) if ``with_text``.

    Matches never cross documents.  A null text is empty.  A null id counts as larger than any
    other, as do ids that are no whole numbers; documents of the same id, null included, don't remove each other's strings.  Of equal
    texts the smallest id stays as it is and the others lose everything (if ``length`` bytes or
    more).  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    texts = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), "text")
    slim = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    done = removals(texts, length, with_text)
    both = slim.join(done, "sha")
    copy = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) > F.col("first")) & (F.col("n_bytes") >= length)
    kept = [F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []
    return both.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
        *kept,
    )


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
