"""Readers and writers of landed tables: CSV with a byte-order mark, JSON, Parquet, gzip by extension."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and quoted newlines; a leading byte-order mark is dropped; columns go by name.

    The header gives the order of the file's columns; those that ``schema`` doesn't name are left out,
    one that it names and the file lacks is an error, as is a second file with another header.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    options = {"header": True, "multiLine": True, "encoding": "UTF-8", "escape": '"'}
    header = spark.read.csv(path, **options).columns
    plain = [c.removeprefix("\ufeff") for c in header]
    missing = [f.name for f in schema if f.name not in plain]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    kinds = {f.name: f.dataType for f in schema}
    found = StructType([StructField(c, kinds.get(p, StringType())) for c, p in zip(header, plain)])
    rows = spark.read.csv(path, schema=found, enforceSchema=False, **options)
    return rows.select(*[F.col(f"`{header[plain.index(f.name)]}`").alias(f.name) for f in schema])


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON array, or one object a line."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header that starts with a byte-order mark, as spreadsheets expect."""
    if df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.csv(path, header=True, encoding="UTF-8", escape='"', mode="overwrite")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite")


def read_corpus(spark: SparkSession, path: str, corpus: str | None = None) -> DataFrame:
    """Parquet partitioned by ``corpus``; one corpus reads its partition alone."""
    df = spark.read.parquet(path)
    return df if corpus is None else df.where(df["corpus"] == corpus)


def publish(df: DataFrame, path: str, checks: dict[str, Column]) -> None:
    """Write a Parquet table only if it passes: staged beside ``path``, checked as written, then renamed into place.

    ``checks`` are aggregates that must be true of the staged rows; null counts as false.  If one
    fails, the staged files go, the table that was there stays as it was, and the error names the
    check.  Readers see the old table or the new one; a failed rename puts the old one back.
    """
    spark = df.sparkSession
    staged, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("staged", "old"))
    place = {k: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(v) for k, v in (("path", path), ("staged", staged), ("old", old))}
    files = place["path"].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.parquet(staged)
        held = spark.read.schema(df.schema).parquet(staged).agg(*[F.coalesce(c, F.lit(False)).alias(f"c{k}") for k, c in enumerate(checks.values())]).first() if checks else ()
        failed = [name for name, ok in zip(checks, held) if not ok]
        if failed:
            raise ValueError(f"not published to {path}: {', '.join(failed)}")
        before = files.exists(place["path"])
        if before and not files.rename(place["path"], place["old"]):
            raise OSError(f"could not move {path} aside")
        if not files.rename(place["staged"], place["path"]):
            if before:
                files.rename(place["old"], place["path"])
            raise OSError(f"could not publish to {path}")
        if before:
            files.delete(place["old"], True)
    finally:
        files.delete(place["staged"], True)
