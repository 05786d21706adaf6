"""SimHash near-deduplication by a self-join of binary tries.

Fingerprints are dealt out by parts of themselves such that every wanted pair shares a part, so a
task holds tries of fingerprints with a common part.  In each trie, pairs of nodes are traversed
together from the root, four bits a step: the differing bits of their prefixes are accumulated and
a pair is dropped as soon as they exceed the budget, or when all below it is linked already.  Small
nodes are compared leaf by leaf.  A task returns no pairs but, for each linked fingerprint, the
first one of its local component, so dense groups cost rows in proportion to their members.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import components, join_unique, land

NIBBLE = np.array([[(a ^ b).bit_count() for b in range(16)] for a in range(16)], dtype=np.int16)
LEAVES = 4096  # node pairs with at most so many leaf pairs are compared leaf by leaf
CHUNK = 1 << 18  # pairs handled at once
BLOCK = 1 << 21  # shingles of a group that are held as one block


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles of the text, A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - k + 1)].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[min(k, len(words)) - 1 :].tolist())], np.uint64)


_BASE, _RUN = 0x9E3779B97F4A7C15, 1 << 16


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the k-word shingles, words as in ``shingle_hashes``, in order of hash.

    All shingles are hashed at once: a polynomial over the bytes, taken from running sums, then mixed.
    Long texts are handled a run of words at a time.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found = []
    for at in range(0, max(1, len(words) - k + 1), _RUN) if words else ():
        joined = np.frombuffer(b" ".join(words[at : at + _RUN + k - 1]), np.uint8)
        power, inverse = _powers(1 << max(16, len(joined).bit_length()))
        gaps = np.flatnonzero(joined == 32)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(joined))
        total = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[: len(joined)], out=total[1:])
        ends = ends[min(k, len(starts)) - 1 :]
        starts = starts[: len(ends)]
        h = (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        found.append(np.unique(h ^ (h >> np.uint64(33))))
    if not found:
        return np.empty(0, np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """64 * words bits, big-endian: a bit is set if set in over half the hashes; none: zero.

    The first word votes with the hashes themselves, further words with remixed hashes.
    """
    votes = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):
        h = hashes[at : at + 255]
        mixed = np.empty((len(h), words), ">u8")
        mixed[:, 0] = h
        for w in range(1, words):
            x = h * np.uint64((0x9E3779B97F4A7C15 * (2 * w + 1)) & (2**64 - 1))
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            mixed[:, w] = x ^ (x >> np.uint64(32))
        votes += np.add.reduce(np.unpackbits(mixed.view(np.uint8).reshape(len(h), 8 * words), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int, words: int, distinct: bool) -> DataFrame:
    """(doc_id, fp binary) of every row; a null text has no words.  ``distinct``: a shingle votes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), k)
                out.append(fingerprint(np.unique(h) if distinct else h, words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp binary")


class Links:
    """Components of rows; ``labels`` has for each the first row of its component, ``edges`` the links that joined components."""

    def __init__(self, labels: np.ndarray, holds: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        self.labels, self.holds = labels, holds
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the components of linked rows; a label is the smallest row of its component."""
        labels = self.labels
        while True:
            a, b = labels[i], labels[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            top, at = np.unique(np.maximum(a, b), return_index=True)
            labels[top] = np.minimum(a, b)[at]
            self.edges.append((i[at], j[at]))
            while True:
                up = labels[labels]
                if np.array_equal(up, labels):
                    break
                labels[:] = up

    def union_where(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        """Ask about the nearest pairs first, few at once and then more, as each link spares others."""
        order = np.argsort(d, kind="stable")
        i, j, step = i[order], j[order], 64
        while True:
            apart = self.labels[i] != self.labels[j]
            i, j = i[apart], j[apart]
            if not len(i):
                return
            good = self.holds(i[:step], j[:step])
            self.union(i[:step][good], j[:step][good])
            i, j, step = i[step:], j[step:], min(2 * step, 8192)


class Trie(Links):
    """Tries over the rows of ``fps`` (n, words; unsigned, sorted by cell and value), one for each cell."""

    def __init__(self, cells: np.ndarray, fps: np.ndarray):
        self.fps, n = fps, len(fps)
        octets = fps.astype(">u8").view(np.uint8).reshape(n, -1)
        self.nibbles = np.empty((n, 2 * octets.shape[1]), np.uint8)
        self.nibbles[:, 0::2], self.nibbles[:, 1::2] = octets >> 4, octets & 15
        new = np.ones(n, bool)
        new[1:] = cells[1:] != cells[:-1]
        self.new, self.starts = new, [np.flatnonzero(new)]
        super().__init__(np.arange(n))

    def join_where(self, budget: int, holds: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Labels after linking all rows of a cell within ``budget`` bits of which ``holds(i, j)`` is true.

        Pairs that earlier links have put into one component are not asked about.
        """
        self.holds = holds
        return self.join(budget)

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of each node whose prefix has ``depth`` nibbles."""
        while len(self.starts) <= depth:
            nib = self.nibbles[:, len(self.starts) - 1]
            self.new = self.new.copy()
            self.new[1:] |= nib[1:] != nib[:-1]
            self.starts.append(np.flatnonzero(self.new))
        s = self.starts[depth]
        return s, np.append(s[1:], len(self.fps))

    def join(self, budget: int) -> np.ndarray:
        """Labels after linking all rows of a cell within ``budget`` differing bits."""
        roots = np.arange(len(self.starts[0]))
        todo = [(0, roots, roots, np.zeros(len(roots), np.int16))]
        while todo:
            depth, a, b, diff = todo.pop()
            if len(a) > CHUNK:
                half = len(a) // 2
                todo += [(depth, a[half:], b[half:], diff[half:]), (depth, a[:half], b[:half], diff[:half])]
                continue
            s, e = self.level(depth)
            if len(a) * 8 >= len(self.labels):  # worth the look: drop pairs whose rows are one component already
                low, high = np.minimum.reduceat(self.labels, s), np.maximum.reduceat(self.labels, s)
                open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
                a, b, diff = a[open_], b[open_], diff[open_]
            leaves = (e[a] - s[a]) * (e[b] - s[b])
            small = leaves <= LEAVES if depth < self.nibbles.shape[1] else np.ones(len(a), bool)
            self._compare(s, e, a[small], b[small], leaves[small], budget)
            a, b, diff = a[~small], b[~small], diff[~small]
            if len(a):
                todo += self._children(depth, s, e, a, b, diff, budget)
        return self.labels

    def _children(self, depth: int, s: np.ndarray, e: np.ndarray, a: np.ndarray, b: np.ndarray, diff: np.ndarray, budget: int) -> list:
        below, _ = self.level(depth + 1)
        first, end = np.searchsorted(below, s), np.searchsorted(below, e)
        count = (end[a] - first[a]) * (end[b] - first[b])
        found = []
        for part in _parts(count):
            x, y, n = a[part], b[part], count[part]
            pair, off = _expanded(n)
            wide = (end[y] - first[y])[pair]
            ca, cb = first[x][pair] + off // wide, first[y][pair] + off % wide
            nib = self.nibbles[:, depth]
            d = diff[part][pair] + NIBBLE[nib[below[ca]], nib[below[cb]]]
            fits = (d <= budget) & (ca <= cb)
            found.append((depth + 1, ca[fits], cb[fits], d[fits].astype(np.int16)))
        return found

    def _compare(self, s: np.ndarray, e: np.ndarray, a: np.ndarray, b: np.ndarray, leaves: np.ndarray, budget: int) -> None:
        for part in _parts(leaves):
            x, y = a[part], b[part]
            for pair, off in _expanded_in_turn(leaves[part]):
                wide = (e[y] - s[y])[pair]
                i, j = s[x][pair] + off // wide, s[y][pair] + off % wide
                keep = i < j
                i, j = i[keep], j[keep]
                d = np.zeros(len(i), np.int16)
                for w in range(self.fps.shape[1]):
                    d = d + np.bitwise_count(self.fps[i, w] ^ self.fps[j, w])
                    near = d <= budget
                    i, j, d = i[near], j[near], d[near]
                if self.holds is None:
                    self.union(i, j)
                else:
                    self.union_where(i, j, d)


def _parts(count: np.ndarray) -> list[slice]:
    """Slices whose counts sum to about CHUNK."""
    if not len(count):
        return []
    block = np.cumsum(count) // CHUNK
    cut = np.flatnonzero(np.diff(block)) + 1
    return [slice(a, b) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(count)])]


def _expanded(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``count[k]`` items of k: k, and the item's number within k."""
    k = np.repeat(np.arange(len(count)), count)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)


def _expanded_in_turn(count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_expanded``, a bounded number of items at once where a single count is large (rows of equal fingerprint)."""
    if len(count) > 1 or count[0] <= CHUNK:
        yield _expanded(count)
        return
    for at in range(0, int(count[0]), CHUNK):
        off = np.arange(at, min(at + CHUNK, int(count[0])))
        yield np.zeros(len(off), np.int64), off


def parts_of(bits: int, budget: int) -> list[np.ndarray]:
    """Bits of each of budget + 1 parts that cover the fingerprint: two within the budget agree in one."""
    cuts = [bits * p // (budget + 1) for p in range(budget + 2)]
    return [np.arange(a, b) for a, b in zip(cuts, cuts[1:])]


def parts_for(bits: int, n: int, differ: float, missed: float) -> list[np.ndarray]:
    """Parts for ``n`` fingerprints: pairs that differ in a share ``differ`` of the bits agree in none with probability ``missed``.

    A part has so many bits that about 64 of unrelated fingerprints agree in it.
    """
    size = max(8, math.ceil(math.log2(max(2, n) / 64)))
    count = math.ceil(math.log(missed) / math.log(1 - (1 - differ) ** size))
    order = np.concatenate([np.random.default_rng(p).permutation(bits) for p in range(-(-count * size // bits))])
    return [order[p * size : (p + 1) * size] for p in range(count)]


def near_links(distinct: DataFrame, words: int, budget: int, parts: list[np.ndarray]) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of ``fp`` that share a part and differ in at most ``budget`` bits.

    ``distinct`` has one (fp, id) for each fingerprint.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(n, 8 * words)
            bits = np.unpackbits(raw, axis=1)
            for p, at in enumerate(parts):
                value = bits[:, at] @ (np.int64(1) << np.arange(len(at), dtype=np.int64)[::-1])
                yield pa.RecordBatch.from_arrays([pa.array(value + (np.int64(p) << 40)), batch.column(0), batch.column(1)], ["cell", "fp", "id"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(cells: np.ndarray, raw: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            fps = raw.view(">u8").reshape(len(ids), words).astype(np.uint64)
            order = np.lexsort([*fps.T[::-1], cells])
            trie, ids = Trie(cells[order], fps[order]), ids[order]
            labels = trie.join(budget)
            i = np.flatnonzero(labels != np.arange(len(labels)))
            j = labels[i]
            both = np.unique(np.column_stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in both.T], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, 8 * words)
            held.append((batch.column(0).to_numpy(), raw, batch.column(2).to_numpy()))
            if sum(len(h[0]) for h in held) < 40_000:
                continue
            cells, raw, ids = (np.concatenate(x) for x in zip(*held))
            whole = np.searchsorted(cells, cells[-1])  # the last cell may go on in the next batch
            if whole:
                yield links(cells[:whole], raw[:whole], ids[:whole])
            held = [(cells[whole:], raw[whole:], ids[whole:])]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    rows = distinct.select("fp", "id").mapInArrow(dealt, "cell long, fp binary, id long")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(joined, "u long, v long")


def signatures(texts: DataFrame, k: int, words: int, similarity: float, short: int) -> DataFrame:
    """(doc_id, sha, shingles, fp, n, prefix) of rows (doc_id, sha, text): n different shingles and, of up to ``short``, the whole set by hash.

    ``shingles`` is a digest of the whole set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, prefixes, digests = [], [], [], []
            for text in batch.column(2):
                one = shingle_set(text.as_py(), k)
                fps.append(fingerprint(one, words))
                n = len(one)
                sizes.append(n)
                digests.append(hashlib.sha256(one.tobytes()).digest())
                prefixes.append(one[: n if n <= short else 0].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "sha", "shingles", "fp", "n", "prefix"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "sha", "text").mapInArrow(run, f"doc_id {kind}, sha binary, shingles binary, fp binary, n long, prefix array<long>")


def sharing_pairs(cells: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of rows (shingle, id, n, component, members) of equal shingle, other components and the similarity or more.

    ``members`` is the row's whole set, so pairs are verified where they are formed, and only links that join components come back.
    """

    def pairs(cell: np.ndarray, ids: np.ndarray, n: np.ndarray, component: np.ndarray, members: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((n, cell))
        cell, ids, n, component, members = cell[order], ids[order], n[order], component[order], members[order]
        new = np.append(True, cell[1:] != cell[:-1])
        starts, number = np.flatnonzero(new), np.cumsum(new) - 1
        mixed = (np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts))[number]
        ids, n, component, number, members = ids[mixed], n[mixed], component[mixed], number[mixed], members[mixed]
        if not len(ids):
            return
        end = np.cumsum(n)
        _, least, kind = np.unique(component, return_index=True, return_inverse=True)
        found = Links(least[kind], similar(np.concatenate(members), end - n, end, similarity))
        key = (number << 32) + n
        count = np.searchsorted(key, (number << 32) + np.floor(n / similarity + 1e-6).astype(np.int64), "right") - np.arange(len(key)) - 1
        for part in _parts(count):
            i, off = _expanded(count[part])
            i = i + part.start
            j = i + 1 + off
            found.union_where(i, j, np.zeros(len(i), np.int16))
        for i, j in found.edges:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if held[0][0][0] == held[-1][0][-1] or sum(len(h[0]) for h in held) < 40_000:
                continue
            all_ = [np.concatenate(x) for x in zip(*held)]
            whole = np.searchsorted(all_[0], all_[0][-1])  # the last cell may go on in the next batch
            yield from pairs(*(x[:whole] for x in all_))
            held = [[x[whole:] for x in all_]]
        if held:
            yield from pairs(*(np.concatenate(x) for x in zip(*held)))

    rows = cells.select("shingle", "id", "n", "component", "members").repartition("shingle").sortWithinPartitions("shingle")
    return rows.mapInArrow(run, "u long, v long").distinct()


def similar(value: np.ndarray, begin: np.ndarray, end: np.ndarray, similarity: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which pairs of rows (i, j) of sets ``value[begin:end]`` have the Jaccard similarity or more."""
    n = end - begin
    code = np.unique(value, return_inverse=True)[1]
    marked = np.zeros(len(value), bool)

    def holds(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        good = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6
        at = np.flatnonzero(good)
        at = at[np.argsort(i[at], kind="stable")]
        for some in np.split(at, np.flatnonzero(np.diff(i[at])) + 1) if len(at) else ():
            this, others = i[some[0]], j[some]
            own = code[begin[this] : end[this]]
            marked[own] = True
            for part in _parts(n[others]):
                pair, off = _expanded(n[others[part]])
                shared = np.bincount(pair[marked[code[begin[others[part]][pair] + off]]], minlength=len(others[part]))
                either = n[this] + n[others[part]] - shared
                good[some[part]] = shared >= similarity * either - 1e-9
            marked[own] = False
        return good

    return holds


def verified_within(members: DataFrame, texts: DataFrame, k: int, words: int, loose: int, similarity: float) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of one ``group`` within ``loose`` bits and of the Jaccard similarity or more.

    ``members`` (group, id, sha, fp, n) are dealt out by groups; a group of more than ``BLOCK``
    shingles is cut into blocks by a hash of the id, and every two blocks meet in a task.  Pairs are formed and
    verified inside the tasks, which return only the links that joined components, so look-alikes below the
    similarity cost no rows.
    """
    count = members.count()
    size = members.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("size"))
    wanted = land(join_unique(members, size.withColumn("blocks", F.greatest("blocks", F.lit(1))), ["group"], "size", count))
    found = texts.select("sha", "text").join(wanted, "sha").dropDuplicates(["id"]).select("group", "blocks", "id", "fp", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                one = [shingle_set(text.as_py(), k).view(np.int64) for text in some.column(4)]
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(one, pa.list_(pa.int64()))], ["group", "blocks", "id", "fp", "shingle"])

    rows = found.mapInArrow(sets, "group long, blocks int, id long, fp binary, shingle array<long>")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), mine))
    rows = rows.select("group", "id", "fp", "shingle", mine.alias("x"), F.explode(others).alias("y"))
    rows = rows.select(F.xxhash64("group", F.least("x", "y"), F.greatest("x", "y")).alias("cell"), "id", "fp", "shingle")

    def links(dealt: pa.Table) -> pa.RecordBatch:
        cells, ids = dealt.column(0).to_numpy(), dealt.column(1).to_numpy()
        fps = np.frombuffer(b"".join(dealt.column(2).to_pylist()), ">u8").reshape(len(ids), words).astype(np.uint64)
        order = np.lexsort([*fps.T[::-1], cells])
        flat = pa.concat_arrays(dealt.column(3).chunks)
        ends, value = flat.offsets.to_numpy(), flat.values.to_numpy()
        begin, end = ends[:-1][order], ends[1:][order]
        trie = Trie(cells[order], fps[order])
        trie.join_where(loose, similar(value, begin, end, similarity))
        i, j = (np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2, *trie.edges))
        ids = ids[order]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += len(batch.column(3).flatten())
            if size < BLOCK or held[0].column(0)[0] == batch.column(0)[-1]:
                continue
            rows_ = pa.Table.from_batches(held)
            cells = rows_.column(0).to_numpy()
            whole = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on in the next batch
            yield links(rows_.slice(0, whole))
            held = rows_.slice(whole).to_batches()
            size = sum(len(h.column(3).flatten()) for h in held)
        if held:
            yield links(pa.Table.from_batches(held))

    # The work goes with the pairs, not with the bytes, by which small tables are coalesced.
    return rows.repartition(1 + count // 256, "cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long")


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, words: int = 1, budget: int = 4,
    distinct: bool = False, similarity: float | None = None, short: int = 40, missed: float = 0.003,
) -> DataFrame:
    """One row per document: doc_id, fp (binary), component_id (smallest id reachable through links).

    Rows of equal fingerprint are one vertex; a text without words has fingerprint zero and is
    linked like any other.  With ``similarity`` links are the pairs of that Jaccard similarity of
    k-word shingle sets (distinct shingles, by another hash) within ``budget`` bits; all texts without words link.  A component whose ids are all null has a null
    component_id; null ids otherwise take part as members.  Repeated rows stay.  Other columns are
    ignored.
    """
    if similarity is not None:
        return _similar(docs, id_col, text_col, k, words, budget, similarity, short, missed)
    rows = land(fingerprints(docs, id_col, text_col, k, words, distinct))
    one = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"))
    one = one.withColumn("id", F.conv(F.hex("fp"), 16, -10).cast("long")) if words == 1 else land(one.withColumn("id", F.monotonically_increasing_id()))
    named = _named(one, components(near_links(one, words, budget, parts_of(64 * words, budget))))
    return join_unique(rows, named.select("fp", "component_id", "times"), ["fp"], "times", rows.count()).select("doc_id", "fp", "component_id")


def _named(one: DataFrame, parts: DataFrame) -> DataFrame:
    """Vertices ``one`` (id, least, times, ...) with ``component_id``, the smallest ``least`` of their component in ``parts``."""
    one = one.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    one = land(one)
    least = one.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    return land(join_unique(one, least, ["component"], "size", one.count()))


def _grown(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``parts`` (id, component) after linking the pairs ``links`` too, which is a landed table."""
    return parts if links.isEmpty() else components(parts.toDF("u", "v").unionByName(links))


def _similar(docs: DataFrame, id_col: str, text_col: str, k: int, words: int, budget: int, similarity: float, short: int, missed: float) -> DataFrame:
    """``near_dedup`` by verified pairs only; different shingle sets are the vertices, with numbers of their own.

    Fingerprints within ``budget`` bits that share a part put their sets into one group; inside a
    group all pairs within ``budget`` bits are verified in tasks, but for those that other links join already.  Fingerprints of
    few shingles are coarse: texts of up to ``short`` are also joined on shingles, which misses none.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = land(signatures(texts, k, words, similarity, short))
    first = [F.first(c).alias(c) for c in ("fp", "n", "prefix")]
    one = land(rows.groupBy("shingles").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"), F.min("sha").alias("sha"), *first).withColumn("id", F.monotonically_increasing_id()))
    count = one.count()
    root = one.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    same = join_unique(one.select("fp", F.col("id").alias("u")), root.withColumnRenamed("id", "v"), ["fp"], "n", count).where("u != v").select("u", "v")
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    near = near_links(root.select("fp", "id"), words, budget, parts_for(64 * words, count, differ, missed))
    groups = components(land(near.unionByName(same).distinct())).withColumnRenamed("component", "group")
    groups = groups.unionByName(groups.select(F.col("group").alias("id"), "group")).distinct()
    members = land(groups.join(one.select("id", "sha", "fp", "n"), "id"))
    parts = components(land(verified_within(members, texts, k, words, budget, similarity).distinct()))

    cells = one.where("size(prefix) > 0").select("id", "n", "prefix").join(parts, "id", "left")
    # Two sets of the similarity share at least that part of the larger one: the first n - ceil(similarity * n) + 1 have one in common.
    head = F.expr(f"slice(prefix, 1, cast(n - ceil({similarity} * n - 1e-9) + 1 as int))")
    cells = cells.select(F.explode(head).alias("shingle"), "id", "n", F.coalesce("component", "id").alias("component"), F.col("prefix").alias("members"))
    parts = _grown(parts, land(sharing_pairs(cells, similarity)))

    named = _named(one.select("id", "shingles", "least", "times"), parts)
    return join_unique(rows.select("doc_id", "shingles", "fp"), named.select("shingles", "component_id", "times"), ["shingles"], "times", rows.count()).select("doc_id", "fp", "component_id")


#: Near copies: five-word shingles, Jaccard similarity 0.8, verified.  At that similarity 77.5 of 512 bits differ on
#: average (standard deviation 8.1): 125 propose all such pairs, and the parts leave 3 of 1,000 pairs out of a group.
NEAR_COPIES = {"k": 5, "words": 8, "budget": 125, "distinct": True, "similarity": 0.8}


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
