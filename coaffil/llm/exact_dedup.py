"""Exact deduplication by deterministic block naming.

A text (white-space runs folded to one space) is cut into fixed-size byte blocks.  Equal blocks get
equal integer names, different blocks different ones; then neighbouring names are paired and the
pairs named, level by level, until each document has a single name.  Names come from sorting: keys
are numbered in order within a coarse bucket, and the bucket number is the name's upper part, so a
name depends on nothing but the set of keys.  No digest decides equality: blocks that share a hash
are told apart by their bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import join_unique, land

#: White space that is to become one space; a single space already is one, and matching it costs most of the time.
SPACES = "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _named(rows: DataFrame, keys: list[str], bucket_bits: int = 24) -> DataFrame:
    """Distinct ``keys`` with ``name``: bucket number, then place in the sorted bucket."""
    bucket = F.shiftrightunsigned(F.xxhash64(F.lit(7), *keys), 64 - bucket_bits)
    order = Window.partitionBy("bucket").orderBy(*keys)
    distinct = rows.select(*keys).distinct().withColumn("bucket", bucket)
    return distinct.select(*keys, (F.shiftleft("bucket", 38) + F.row_number().over(order)).alias("name"))


def _join_names(rows: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    names = names.select(*[F.col(k).alias(f"n_{k}") for k in keys], "name")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in keys])
    return rows.join(names, on).drop(*[f"n_{k}" for k in keys])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the smallest id of equal texts stays; a null id is larger than any other, and of
    rows that repeat both id and text one stays.  A null text equals the empty text.  If all ids of
    a group are null, keep_id is null and one row is kept.  Other columns of ``docs`` are ignored.
    ``hash_bits`` below 64 makes blocks share hashes; results don't change (for tests).
    """
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    cut = text.select(
        "doc_id",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
        F.expr(
            f"transform(sequence(0, greatest(0, (octet_length(text) - 1) div {block_bytes})),"
            f" i -> substring(cast(text as binary), i * {block_bytes} + 1, {block_bytes}))"
        ).alias("blocks"),
    )
    cut = land(cut)  # read twice below; normalising costs more than the file
    blocks = cut.select("doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    blocks = blocks.withColumn("h", F.shiftrightunsigned(F.xxhash64("block"), 64 - hash_bits) if hash_bits < 64 else F.xxhash64("block"))

    # Every distinct block is compared, byte for byte, with the others of its hash.
    shared = land(
        blocks.groupBy("h").agg(F.collect_set("block").alias("s")).where(F.size("s") > 1).select("h", F.array_sort("s").alias("s"))
    )
    if shared.isEmpty():
        rows = blocks.select("doc_id", "sha", "n", "pos", "h", F.lit(0).alias("twin"))
    else:
        rows = blocks.join(shared, "h", "left").select(
            "doc_id", "sha", "n", "pos", "h", F.coalesce(F.array_position("s", F.col("block")).cast("int"), F.lit(0)).alias("twin")
        )
    rows = land(rows)
    rows = _join_names(rows, _named(rows, ["h", "twin"]), ["h", "twin"])
    # Repeated rows fall together here; ``times`` remembers how many there were.
    rows = land(rows.groupBy("doc_id", "sha", "n", "pos", "name").agg(F.count("*").alias("times")).withColumn("left", F.col("n")))

    done = [rows.where("left = 1")]
    rows = rows.where("left > 1")
    while not rows.isEmpty():
        even = F.col("pos") % 2 == 0
        pairs = rows.groupBy("doc_id", "sha", "n", "left", (F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b"), F.max("times").alias("times")
        )
        pairs = land(pairs)
        rows = land(
            _join_names(pairs, _named(pairs, ["a", "b"]), ["a", "b"])
            .select("doc_id", "sha", "n", "pos", "name", "times", F.ceil(F.col("left") / 2).cast("int").alias("left"))
        )
        done.append(rows.where("left = 1"))
        rows = rows.where("left > 1")

    # A document's identity: its number of blocks and the last name.
    one = reduce(DataFrame.unionByName, [d.select("doc_id", "sha", "n", "name", "times") for d in done])
    groups = one.groupBy("n", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size"), F.count("*").alias("ids"))
    return (
        join_unique(one, groups, ["n", "name"], "ids", one.count())
        .select("doc_id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("i"))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size,
    row_number() OVER (PARTITION BY text_sha256, doc_id) AS i
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size,
  (doc_id IS NOT DISTINCT FROM keep_id AND i = 1) AS kept, text_sha256
FROM g
"""
