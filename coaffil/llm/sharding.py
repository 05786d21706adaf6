"""Sharding: minimax contiguous partition.

Documents of equal text form atomic groups.  The groups are ordered by a hash of their text, and
neighbouring hashes are gathered into at most ``2 ** unit_bits`` ordered units, each whole groups.
The smallest shard capacity for which a greedy left-to-right pass needs no more than the wanted
number of shards is found by binary search over the unit sizes; the shards are cut by that pass.
The unit sizes are one array of at most ``2 ** unit_bits`` longs however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import land


def _shards_needed(capacity: str, close: str) -> str:
    """Shards that a pass over ``sizes`` opens: one ends where the next unit would pass ``capacity``, or at ``close`` bytes."""
    return (
        "aggregate(sizes, named_struct('n', 1, 'has', 0L), (s, x) -> "
        f"if(s.has + x <= {capacity} and s.has < {close}, named_struct('n', s.n, 'has', s.has + x), named_struct('n', s.n + 1, 'has', x)), s -> s.n)"
    )


def _least(low: str, high: str, fits: str) -> str:
    """Binary search for the least value in [low, high] for which ``fits`` (over ``b.mid``) holds; ``high`` is known to fit."""
    return (
        f"aggregate(sequence(1, 62), named_struct('lo', {low}, 'hi', {high}, 'mid', {low} + ({high} - {low}) div 2), (b, i) -> if(b.lo >= b.hi, b, if({fits}, "
        "named_struct('lo', b.lo, 'hi', b.mid, 'mid', b.lo + (b.mid - b.lo) div 2), "
        "named_struct('lo', b.mid + 1, 'hi', b.hi, 'mid', b.mid + 1 + (b.hi - b.mid - 1) div 2))), b -> b.hi)"
    )


def minimax_units(units: DataFrame, shards: int) -> DataFrame:
    """units (unit, bytes): adds ``shard`` by the minimax contiguous partition in order of unit.

    The capacity is the least for which a greedy pass needs at most ``shards`` shards.  Under that
    capacity shards are closed early, at the least of a grid of sizes around the mean for which the
    pass still suffices, so that what the greedy pass would leave for the last shard is spread.  Empty input gives no rows.
    Sizes must not be negative.
    """
    one = units.agg(F.array_sort(F.collect_list(F.struct("unit", "bytes"))).alias("u")).select("u", F.expr("transform(u, x -> x.bytes)").alias("sizes"))
    largest, total = "greatest(array_max(sizes), 0L)", "aggregate(sizes, 0L, (a, x) -> a + x)"
    grid = f"transform(sequence(0, 80), i -> cast({total} * (0.97D + 0.0005D * i) / {shards} as bigint))"
    # Each search is landed: inlined into the next one's lambda, it would run again at every step.
    one = land(one.where("size(u) > 0").select("u", "sizes", F.expr(_least(largest, total, f"{_shards_needed('b.mid', 'b.mid + 1')} <= {shards}")).alias("capacity")))
    one = land(one.withColumn("close", F.expr(f"coalesce(array_min(filter({grid}, c -> {_shards_needed('capacity', 'c')} <= {shards})), capacity + 1)")))
    starts = one.select(
        "u",
        F.expr(
            "aggregate(slice(u, 2, size(u)), named_struct('has', u[0].bytes, 'starts', array(cast(u[0].unit as bigint))), (s, x) -> "
            "if(s.has + x.bytes <= capacity and s.has < close, named_struct('has', s.has + x.bytes, 'starts', s.starts), "
            "named_struct('has', x.bytes, 'starts', array_append(s.starts, cast(x.unit as bigint)))), s -> s.starts)"
        ).alias("starts"),
    )
    return starts.select(F.explode("u").alias("x"), "starts").select(
        F.col("x.unit").alias("unit"),
        F.col("x.bytes").alias("bytes"),
        F.expr("size(filter(starts, s -> s <= x.unit)) - 1").alias("shard"),
    )


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", unit_bits: int = 16, salt: int = 64) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 16.  Documents of equal text share a shard, so
    a group larger than the mean shard makes its shard larger.  ``slot`` numbers a shard's rows from
    0 without gaps; rows are numbered in runs of (unit, salt), so that no task orders a whole shard
    or a whole group of copies.  Null ids are allowed; repeated rows get slots of their own.  With
    fewer units than shards some shards stay empty.  grown_shard is null: the law is ``bytes``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.xxhash64(text)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(hashed, 64 - unit_bits).alias("unit"),
        F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(salt)).cast("int").alias("salt"),
    )
    rows = land(rows)
    cut = land(minimax_units(rows.groupBy("unit").agg(F.sum("size").alias("bytes")), shards))
    cut = cut.select("unit", "shard")

    runs = rows.groupBy("unit", "salt").agg(F.count("*").alias("n")).join(F.broadcast(cut), "unit")  # cut: at most 2 ** unit_bits rows
    before = Window.partitionBy("shard").orderBy("unit", "salt").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("unit", "salt", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = Window.partitionBy("unit", "salt").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("place", F.row_number().over(place) - 1)
        .join(runs, ["unit", "salt"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
