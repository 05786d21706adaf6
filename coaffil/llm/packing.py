"""Cost-balanced packing of documents into training sequences.

A task tokenizes its documents and packs them window by window; a window is closed at a bounded
number of tokens, so memory doesn't depend on the partition, and no row is shuffled.  Within a
window of T tokens exactly ceil(T / 4096) sequences are filled: documents, longest first, go whole
to the sequence of lowest estimated cost (linear plus quadratic attention cost) that has room; a
document that no sequence can take whole is cut over the cheapest ones with room.  What remains
below a full sequence is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import id_lookup

COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_lengths(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one window.

    Every token lies in one piece.  All sequences are full but the last ones, whose lengths are
    powers of two.
    """
    total = int(lengths.sum())
    rest = total % capacity
    room = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length()) if rest >> b & 1][::-1]
    room = np.array(room, np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, length: int, seq: int) -> None:
        pieces.append((doc, start, length, seq, int(used[seq])))
        used[seq] += length
        room[seq] -= length
        cost[seq] += linear * length + quadratic * length * length

    for doc in np.argsort(-lengths, kind="stable").tolist():
        at, left = 0, int(lengths[doc])
        while left:
            step = min(left, capacity)
            fits = np.flatnonzero(room >= step)
            if len(fits):
                seq = int(fits[np.argmin(cost[fits])])
            else:
                open_ = np.flatnonzero(room)
                # The cheapest of those with most room, so that a document is cut seldom.
                most = open_[room[open_] >= max(1, int(room.max()) // 2)]
                seq = int(most[np.argmin(cost[most])])
                step = int(min(step, room[seq]))
            put(doc, at, step, seq)
            at, left = at + step, left - step
    return pieces


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2,
    window_tokens: int = 1 << 21, linear: float = 1.0, quadratic: float = 1.0 / 4096,
) -> DataFrame:
    """One row per piece: doc_id and start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; a null or empty text is the end id alone.  sequence_id is
    unique over all tasks; a retried task gives the same rows again.  Null and repeated ids are
    packed like others.  Further columns are ignored; empty input gives no rows.  ``capacity`` must
    be a power of two; a window holds ``window_tokens`` and at most one document more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = id_lookup(tokenizer_path, False)
        end = np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 32
        ids: list = []
        tokens: list[bytes] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal first, held
            lengths = np.array([len(t) // 4 for t in tokens], np.int64)
            pieces = pack_lengths(lengths, capacity, linear, quadratic)
            cols = [
                pa.array([ids[p[0]] for p in pieces], id_type),
                *(pa.array([p[k] for p in pieces], pa.int64()) for k in (1, 2)),
                pa.array([zlib.crc32(tokens[d][4 * a : 4 * (a + n)]) for d, a, n, _, _ in pieces], pa.int64()),
                pa.array([int(lengths[p[0]]) for p in pieces], pa.int64()),
                pa.array([first + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ]
            first += 1 + max(p[3] for p in pieces)
            held = 0
            ids.clear()
            tokens.clear()
            return pa.RecordBatch.from_arrays(cols, ["doc_id", *COLUMNS])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = lookup.ids(text.as_py() or "") + end
                ids.append(key)
                tokens.append(t)
                held += len(t) // 4
                if held >= window_tokens:
                    yield packed()
        if tokens:
            yield packed()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"`{c}` long" for c in COLUMNS))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
