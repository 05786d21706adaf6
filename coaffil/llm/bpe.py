"""BPE encoding and decoding through a table of distinct words.

Texts are split into words; Spark counts the distinct words of the corpus, and those above a count
threshold form the word table, in which each word is encoded once.  The threshold is the least for
which the table has at most ``table_rows`` words, so it can be sent to the tasks whatever the corpus,
where each word's place takes its ids by lookup, not by a Spark join.  Words below the threshold are
encoded where they are met, once while a worker's own bounded table lasts.  Decoding looks ids up in
the list of pieces, whose size is the vocabulary's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import land
from .words import _ALPHABET, id_lookup, load


def word_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", flush: int = 1 << 18) -> DataFrame:
    """(word, n) over all rows; null and empty texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = id_lookup(tokenizer_path, True).splitter.words
        seen: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(split(text.as_py() or ""))
                if len(seen) >= flush:
                    yield flushed()
        if seen:
            yield flushed()

    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(counts: DataFrame, tokenizer_path: str, table_rows: int = 1 << 18) -> DataFrame:
    """(word, ids binary) of the commonest words: as many as fit ``table_rows``, whole count classes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_lookup(tokenizer_path, True).splitter.encode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode(batch.column(0).to_pylist()), pa.binary())], ["word", "ids"])

    band = F.floor(8 * F.log2("n"))  # at most 512 classes
    sizes = counts.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect()
    least, rows = None, 0
    for r in sizes:
        rows += r["count"]
        if rows > table_rows:
            break
        least = r["band"]
    common = counts.where(band >= least) if least is not None else counts.limit(0)
    return common.where("length(word) <= 256").select("word").mapInArrow(run, "word string, ids binary")


def encode(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", table_rows: int = 1 << 18, decoded: bool = False,
) -> DataFrame:
    """(doc_id, ids array<int>) of every row, and ``decoded`` string if wanted; null texts count as empty.

    The ids are those of the tokenizers library without added special tokens; strings of special
    tokens that stand in a text have their ids.  Ids may be null or repeat; other columns are ignored.
    """
    counts = land(word_counts(docs, tokenizer_path, text_col))
    table = {r.word: bytes(r.ids) for r in word_table(counts, tokenizer_path, table_rows).toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, common = id_lookup(tokenizer_path, True), shared.value
        pieces = pieces_of(tokenizer_path) if decoded else None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = [np.frombuffer(_ids(text.as_py() or "", lookup, common), "<i4") for text in batch.column(1)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
                if decoded:
                    columns.append(pa.array([_decoded(i, pieces) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def _ids(text: str, lookup, common: dict[str, bytes]) -> bytes:
    words = lookup.splitter.words(text)
    try:
        return b"".join(map(common.__getitem__, words))
    except KeyError:
        rare = lookup.known
        new = [w for w in {*words} if w not in common and w not in rare]
        if new:
            if len(rare) + len(new) > lookup.most:
                rare.clear()
                new = [w for w in {*words} if w not in common]
            rare.update(zip(new, lookup.splitter.encode(new)))
        return b"".join([common[w] if w in common else rare[w] for w in words])


def pieces_of(tokenizer_path: str) -> list[bytes]:
    """Bytes of each id, special tokens included."""
    tokenizer = load(tokenizer_path)
    back = {chr(c): b for b, c in _ALPHABET.items()}
    pieces = [b""] * (1 + max(tokenizer.get_vocab(True).values()))
    for token, i in tokenizer.get_vocab(True).items():
        pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return pieces


def _decoded(ids: np.ndarray, pieces: list[bytes]) -> str:
    return b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with string ``decoded``; null or empty ids give the empty text, ids outside the vocabulary an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(tokenizer_path)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            text = pa.array([_decoded(np.array(i.as_py() or [], np.int64), pieces) for i in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "decoded"])

    rows = rows.drop("decoded")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
