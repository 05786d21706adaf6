"""Corpus pipeline: toxicity, exact dedup, near dedup, personal data, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), where docs has the
columns of ``documents``, and all but the last return those columns.  ``run`` applies them in turn,
each result written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coaffil.llm.exact_dedup import exact_dedup, normalised
from coaffil.llm.packing import pack
from coaffil.llm.pii import redacted
from coaffil.llm.simhash import NEAR_COPIES, near_dedup
from coaffil.llm.toxicity import toxicity
from coaffil.llm.util import land


def _apart(docs: DataFrame) -> str:
    """A prefix that no column name of ``docs`` starts with."""
    return "_" * (1 + max((len(c) for c in docs.columns), default=0)) + "k"


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written once with a number of its own for each row, and that column's name: ids may repeat or be null."""
    name = _apart(docs)
    return land(docs.withColumn(name, F.monotonically_increasing_id())), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; all rows of an id go if one of them is rejected.  Null ids are judged by their score too."""
    k = _apart(docs)
    judged = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = judged.where("predicted = 1").select(F.col("doc_id").alias(k)).distinct()
    return docs.join(toxic, docs["doc_id"].eqNullSafe(toxic[k]), "left_anti").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays, once; of rows that repeat both, null ids included, one."""
    k = _apart(docs)
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias(k + "id"), F.col("text_sha256").alias(k + "sha"))
    keyed = docs.withColumn(k, F.sha2(normalised(F.col("text")).cast("binary"), 256))
    same = keyed["doc_id"].eqNullSafe(kept[k + "id"]) & (keyed[k] == kept[k + "sha"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", k]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the row of the smallest id stays.

    Rows are told apart by numbers of their own, in order of id where ids differ, so a repeated id
    saves no near copy; a null id is larger than any other.
    """
    rows, k = _numbered(docs)
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col(k).alias("c"))
    found = near_dedup(rows.select(order.alias(k + "id"), "text"), id_col=k + "id", **NEAR_COPIES)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.c").alias(k))
    return rows.join(kept, k, "left_semi").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kind in brackets; n_chars follows where there is such a column."""
    clean = redacted(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact),
    ("packing", pack_sequences),
]

#: Models, fingerprints and tokenizers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
