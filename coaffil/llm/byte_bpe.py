"""Byte-level BPE encoding and decoding with rank files, long texts in overlapping chunks.

A text of at most ``chunk_chars`` is encoded where it is read.  A longer one is cut into chunks of
that length that overlap by ``overlap`` characters; chunks are spread over tasks and each is
pre-tokenised by itself.  A match depends only on the text from its start on, so once two sequences
of pre-tokens share a boundary they agree from there: neighbouring chunks are stitched at the first
boundary that both find in their overlap.  Each chunk then encodes the pre-tokens between its two
stitches, and a document's ids are gathered in order.  A document with a pair of chunks that share
no boundary (a run of letters longer than the overlap, say) is pre-tokenised as one piece.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import land

#: Characters at a chunk's end within which a boundary may come out differently when more text follows (contractions and the one character of lookahead need fewer).
MARGIN = 8


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Rank of each byte string of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: Characters of most texts.  Compiled with these members alone, a class is tested several times faster.
_COMMON = [*range(0x250), *range(0x2010, 0x2060), 0x20AC]
_UNCOMMON = re.compile(r"[^\u0000-\u024f\u2010-\u205f\u20ac]")


@lru_cache(maxsize=8)
def _class(kind: str, common: bool) -> str:
    """Members of a character class of the library's own pattern engine, as ranges for a compiled pattern."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, _COMMON if common else [*range(0xD800), *range(0xE000, 0x110000)]))
    # Text that the pattern doesn't match is dropped, so the bytes that come back are the members.
    taken = tiktoken.Encoding(f"class {kind}", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
    members = np.array([ord(c) for c in bytes(taken).decode()])
    first = members[np.flatnonzero(np.diff(members, prepend=-2) != 1)]
    last = members[np.flatnonzero(np.diff(members, append=0x110001) != 1)]
    return "".join(re.escape(chr(a)) + ("" if a == b else "-" + re.escape(chr(b))) for a, b in zip(first.tolist(), last.tolist()))


@lru_cache(maxsize=4)
def compiled(pattern: str, common: bool) -> re.Pattern:
    """The splitting pattern with its classes spelt out as the library's engine knows them, whatever Unicode version Python has.

    ``common``: for texts of common characters alone.
    """
    out, inside, at = [], False, 0
    for m in re.finditer(r"\\p\{(\w+)\}|\\([sS])|\\.|[\[\]]", pattern):
        out.append(pattern[at : m.start()])
        at, found = m.end(), m[0]
        if m[1] or m[2]:
            members = _class(f"[{found.lower() if m[2] else found}]", common)
            if m[2] == "S" and inside:
                raise ValueError("a negated class inside a class isn't supported")
            found = members if inside else f"[{'^' if m[2] == 'S' else ''}{members}]"
        elif found in "[]":
            inside = found == "["
        out.append(found)
    return re.compile("".join([*out, pattern[at:]]))


def split(text: str, pattern: str, start: int = 0) -> list[str]:
    """Pre-tokens of the text from ``start`` on."""
    return compiled(pattern, text.isascii() or not _UNCOMMON.search(text)).findall(text, start)


class Encoder:
    """Ids of pre-tokens; each is merged once while the table of at most ``most`` of them lasts."""

    def __init__(self, path: str, pattern: str, most: int = 1 << 19):
        import tiktoken

        self.one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})._encode_single_piece
        self.most, self.known = most, {}

    def ids(self, words: list[str]) -> np.ndarray:
        """Ids of pre-tokens, one after the other."""
        known = self.known
        try:
            found = b"".join(map(known.__getitem__, words))
        except KeyError:
            new = [w for w in {*words} if w not in known]
            if len(known) + len(new) > self.most:
                known.clear()
                new = list({*words})
            known.update((w, np.array(self.one(w), "<i4").tobytes()) for w in new)
            found = b"".join(map(known.__getitem__, words))
            for w in new:
                if len(w) > 256:
                    del known[w]
        return np.frombuffer(found, "<i4")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The Python worker's own, kept from task to task."""
    return Encoder(path, pattern)


def _ends(words: list[str], start: int = 0) -> np.ndarray:
    return start + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))


def _listed(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)))


def _encoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) to (doc_id, ids), where the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [e.ids(split(text.as_py() or "", pattern)) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), _listed(found)], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _stitched(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, ids) of long texts by way of their chunks; ``long`` has row, doc_id and text."""
    kind = long.schema["doc_id"].dataType.simpleString()
    last = F.ceil(F.length("text") / chunk).cast("int") - 1
    cut = long.select("row", "doc_id", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("k"), "text")
    # Each chunk lies in a file of its own task's making, so later steps read chunks and not documents.
    chunks = land(cut.select("row", "doc_id", "last", "k", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap + MARGIN)).alias("text")).repartition("row", "k"))

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, tail = [], []
            for text, k, n in zip(*(batch.column(c).to_pylist() for c in (3, 1, 2))):
                ends = np.concatenate([np.zeros(1, np.int64), _ends(split(text, pattern))])
                if k < n and len(text) == chunk + overlap + MARGIN:  # else the slice ends where the text does
                    ends = ends[ends <= len(text) - MARGIN]
                head.append(ends[ends < overlap])
                tail.append(ends[(ends >= chunk) & (ends < chunk + overlap)] - chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _listed(head), _listed(tail)], ["row", "k", "last", "head", "tail"])

    found = land(chunks.select("row", "k", "last", "text").mapInArrow(boundaries, "row long, k int, last int, head array<int>, tail array<int>"))
    following = found.where("k > 0").select("row", (F.col("k") - 1).alias("k"), F.col("head").alias("next"))
    stitches = found.where("k < last").select("row", "k", "tail").join(following, ["row", "k"]).select("row", "k", F.array_min(F.array_intersect("tail", "next")).alias("at"))
    stitches = land(stitches)
    apart = stitches.where("at is null").select("row").distinct()
    begins = stitches.select("row", (F.col("k") + 1).alias("k"), F.col("at").alias("begin"))
    pieces = (
        chunks.join(apart, "row", "left_anti").join(stitches, ["row", "k"], "left").join(begins, ["row", "k"], "left")
        .select("row", "k", "doc_id", "text", F.coalesce("begin", F.lit(0)).alias("begin"), (F.col("at") + chunk).alias("end"))
    )

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            ids = []
            for text, begin, end in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5))):
                words = split(text, pattern, begin)
                if end is not None:  # whole pre-tokens up to the stitch, found with the text that follows it in view
                    words = words[: int(np.searchsorted(_ends(words, begin), end, "right"))]
                ids.append(e.ids(words))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _listed(ids)], ["row", "k", "doc_id", "ids"])

    done = pieces.mapInArrow(encode_pieces, f"row long, k int, doc_id {kind}, ids array<int>")
    whole = done.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    stitched = whole.select("doc_id", F.flatten("parts.ids").alias("ids"))
    return stitched.unionByName(_encoded(long.join(apart, "row", "left_semi").select("doc_id", "text"), path, pattern))


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1 << 16, overlap: int = 1 << 10,
) -> DataFrame:
    """(doc_id, ids array<int>) of every row, ids as the tiktoken library gives them without special tokens.

    Null texts count as empty and have no ids.  Ids may be null or repeat; other columns are
    ignored; empty input gives no rows.  Texts may be of any length: a task holds a chunk of
    ``chunk_chars`` and its ``overlap``, except where a document is read or its ids are gathered.
    The long rows must come in the same order when a task is run again, as they do from files.
    """
    if not 0 < overlap <= chunk_chars:
        raise ValueError("the overlap must be positive and no longer than a chunk")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    short = _encoded(rows.where(~long), ranks_path, pattern)
    numbered = rows.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if numbered.isEmpty():
        return short
    return short.unionByName(_stitched(numbered, ranks_path, pattern, chunk_chars, overlap))


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with binary ``decoded``, the ids' bytes one after the other.

    Null or empty ids give no bytes; an id outside the file is an error.  The bytes need not be
    UTF-8 when ids were cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ranks(ranks_path)
        table = np.zeros(1 + max(known.values()), object)
        table[list(known.values())] = list(known)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = []
                for ids in batch.column(batch.schema.get_field_index(ids_col)):
                    at_ids = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else []
                    if len(at_ids) and not 0 <= at_ids.min() <= at_ids.max() < len(table):
                        raise ValueError("an id outside the vocabulary")
                    found.append(b"".join(table[at_ids].tolist()) if len(at_ids) else b"")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "decoded"])

    rows = rows.drop("decoded")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN), path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
