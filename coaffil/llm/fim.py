"""Fill-in-the-middle transformation by a secondary sort of pieces.

A document is cut into units (a word with the white space before it; trailing white space is one
too), two hash draws cut the units into prefix, middle and suffix, and each part is emitted in
chunks of units, as pieces keyed by document and output position.  One shuffle by document with a
sort inside the partitions brings a document's pieces together in output order; a task streams them
into an incremental digest and never holds a document.  The same stream is split at the marks again,
and its pieces, sorted once more inside the partition by their place in the original, restore the
text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Order of the parts in the output (0 prefix, 1 middle, 2 suffix); each is led by its mark.
ORDERS = {"plain": (0,), "psm": (0, 2, 1), "spm": (2, 0, 1)}
#: Bytes that a task gathers before it hands a batch to Spark.
BATCH = 1 << 22

_META = [pa.field("n", pa.int64()), pa.field("form", pa.string()), pa.field("prefix_chars", pa.int64()), pa.field("middle_chars", pa.int64())]
_META_SQL = "n long, form string, prefix_chars long, middle_chars long"


def draws(doc_id: object, seed: int) -> list[int]:
    """Four numbers below 2^32 from the id's digest; a null id counts as the empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4]) for k in range(0, 16, 4)]


def plan(text: str, doc_id: object, marks: tuple[str, str, str], seed: int, fim_rate: int, spm_rate: int) -> tuple[list[int], str, int, int]:
    """Ends of the units, form, and the units that end prefix and middle (all of them for a plain text)."""
    ends = [m.end() for m in _UNIT.finditer(text)]
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= fim_rate or any(m in text for m in marks):
        return ends, "plain", len(ends), len(ends)
    a, b = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    return ends, "spm" if h4 % 100 < spm_rate else "psm", a, b


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks must be found again: none may stand in another or overlap with the start of one."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or (i != j and a in b) or any(a[k:] == b[: len(a) - k] for k in range(1, len(a))):
                raise ValueError("marks must not be empty, equal, contain or overlap one another")
    return marks


class _Out:
    """Rows of one schema, handed on in batches of bounded bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple, size: int = 64) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size
        if self.held >= BATCH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.rows, self.held = [], 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_rate: int = 50, spm_rate: int = 80,
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), chunk_units: int = 4096,
) -> DataFrame:
    """(row, pos, doc_id, piece binary and, where pos is 0, n, form, prefix_chars, middle_chars).

    ``row`` numbers the documents, so repeated and null ids stay apart; it is the reading task's
    number and the place in its split, the same when a task is run again.
    """
    marks = _checked(marks)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, row = None, TaskContext.get().partitionId() << 33
        for batch in batches:
            out = out or _Out(pa.schema([("row", pa.int64()), ("pos", pa.int64()), ("doc_id", batch.column(0).type), ("piece", pa.binary()), *_META]))
            for doc_id, text in _rows(iter([batch])):
                text = text or ""
                ends, form, a, b = plan(text, doc_id, marks, seed, fim_rate, spm_rate)
                at = [0, *ends]
                chars = (None, None) if form == "plain" else (at[a], at[b] - at[a])
                spans = [(0, a), (a, b), (b, len(ends))]
                pos = 0
                for part in ORDERS[form]:
                    lead, (first, last) = "" if form == "plain" else marks[(0, 2, 1)[part]], spans[part]
                    for k in range(first, max(last, first + 1), chunk_units):
                        piece = (lead + text[at[min(k, last)] : at[min(k + chunk_units, last)]]).encode()
                        yield from out.add((row, pos, doc_id, piece, *((len(ends), form, *chars) if not pos else (None,) * 4)), len(piece) + 64)
                        pos, lead = pos + 1, ""
                row += 1
        if out:
            yield from out.flush()

    return rows.mapInArrow(run, f"row long, pos long, doc_id {kind}, piece binary, {_META_SQL}")


def _parts(form: str, marks: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """A coroutine: sent the output's pieces in order, it gives back (part, bytes); sent None at the end, the rest."""
    data = yield []
    if form == "plain":
        while data is not None:
            data = yield [(0, data)]
        yield []
        return
    expected = [(part, marks[(0, 2, 1)[part]]) for part in ORDERS[form]]
    longest = max(map(len, marks)) - 1
    held, now = b"", None
    while data is not None:
        held, found = held + data, []
        while expected and (at := held.find(expected[0][1])) >= 0:
            if now is not None:
                found.append((now, held[:at]))
            held, now = held[at + len(expected[0][1]) :], expected.pop(0)[0]
        keep = longest if expected else 0  # a mark may lie across two pieces
        if now is not None and len(held) > keep:
            found.append((now, held[: len(held) - keep]))
            held = held[len(held) - keep :]
        data = yield found
    yield [(now, held)] if held and now is not None else []


def assemble(found: DataFrame, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), texts: bool = False) -> DataFrame:
    """Pieces in any order to one row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    ``texts`` adds ``output``, for which a task holds one document's output at a time.
    """
    kind = found.schema["doc_id"].dataType.simpleString()
    encoded = [m.encode() for m in _checked(marks)]
    digest_sql = "output_sha256 string" + ", output string" * texts
    digest_fields = [pa.field("output_sha256", pa.string()), *([pa.field("output", pa.string())] if texts else [])]

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Output digests, and the output's pieces again by their place in the original; a document's last row has part 9."""
        out, now = None, None

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            yield from placed(None)
            whole = [b"".join(kept).decode()] if texts else []
            yield from out.add((now, 9, 0, doc_id, None, *meta, digest.hexdigest(), *whole), 256 + sum(map(len, whole)))

        def placed(piece: bytes | None) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            for part, data in parts.send(piece):
                yield from out.add((now, part, seq, None, data, *(None,) * (4 + len(digest_fields))), len(data) + 64)
                seq += 1

        for batch in batches:
            out = out or _Out(pa.schema([("row", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("doc_id", batch.column(2).type), ("piece", pa.binary()), *_META, *digest_fields]))
            for row, _, key, piece, *more in _rows(iter([batch])):
                if row != now:
                    if now is not None:
                        yield from closed()
                    now, doc_id, meta, digest, seq, kept = row, key, more, hashlib.sha256(), 0, []
                    parts = _parts(more[1], encoded)
                    next(parts)
                digest.update(piece)
                if texts:
                    kept.append(piece)
                yield from placed(piece)
        if now is not None:
            yield from closed()
            yield from out.flush()

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest = None, hashlib.sha256()
        for batch in batches:
            out = out or _Out(pa.schema([("doc_id", batch.column(3).type), *_META, *digest_fields, ("restored_sha256", pa.string())]))
            for _, part, _, doc_id, piece, *more in _rows(iter([batch])):
                if part < 9:
                    digest.update(piece)
                    continue
                yield from out.add((doc_id, *more, digest.hexdigest()), 256 + (len(more[-1]) if texts else 0))
                digest = hashlib.sha256()
        if out:
            yield from out.flush()

    ordered = found.repartition("row").sortWithinPartitions("row", "pos")
    again = ordered.mapInArrow(written, f"row long, part int, seq long, doc_id {kind}, piece binary, {_META_SQL}, {digest_sql}")
    return again.sortWithinPartitions("row", "part", "seq").mapInArrow(restored, f"doc_id {kind}, {_META_SQL}, {digest_sql}, restored_sha256 string")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), texts: bool = False, **options) -> DataFrame:
    """Fill-in-the-middle form of every document, one row each; see ``assemble`` for the columns, ``pieces`` for the options.

    Null texts count as empty and stay plain, as do texts that contain a mark; null ids draw as the
    empty string; repeated rows give repeated results; other columns are ignored; empty input gives
    no rows.  A text of any length passes through in pieces of ``chunk_units`` units (a unit is
    never cut); the reading task holds the document that it cuts.
    """
    return assemble(pieces(docs, id_col, text_col, marks=marks, **options), marks, texts)


def restore(rows: DataFrame, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``rows`` with string ``restored``: the text that gave the output; null where the form or its marks don't fit."""
    p, s, m = (F.lit(x) for x in _checked(marks))
    out = F.col(output_col)

    def between(a, b):
        return F.substring(out, a, b - a)

    at = {k: F.locate(x, out) for k, x in zip("psm", marks)}
    after = {k: at[k] + F.length(x) for k, x in zip("psm", (p, s, m))}
    end = F.length(out) + 1
    psm = F.concat(between(after["p"], at["s"]), between(after["m"], end), between(after["s"], at["m"]))
    spm = F.concat(between(after["p"], at["m"]), between(after["m"], end), between(after["s"], at["p"]))
    form = F.col(form_col)
    return rows.withColumn(
        "restored",
        F.when(form == "plain", out)
        .when((form == "psm") & (at["p"] == 1) & (at["s"] > 1) & (at["m"] > at["s"]), psm)
        .when((form == "spm") & (at["s"] == 1) & (at["p"] > 1) & (at["m"] > at["p"]), spm),
    )


def op13_fim(spark, sf_dir: str) -> DataFrame:
    return transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UNITS = r"'[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'"
_H = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
#: The same result from lists of units, by slicing and joining them.
SQL = f"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_UNITS}) AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {_H.format(1)} % (len(u) + 1) AS c1, {_H.format(9)} % (len(u) + 1) AS c2, {_H.format(17)} % 100 AS d3, {_H.format(25)} % 100 AS d4 FROM units),
formed AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d3 >= 50 THEN 'plain' WHEN d4 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM formed"""
