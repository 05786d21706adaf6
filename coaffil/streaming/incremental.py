"""Resumable enrichment: each batch handles only the keys that the result table lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.text import new_keys


def enrich_stream(source: DataFrame, table: str, key: str, enrich: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Append ``enrich(new keys)`` to the Parquet folder ``table`` for every micro-batch.

    ``enrich`` returns rows with ``key``; keys for which it returns none stay absent and are tried
    again when they next occur.  A replayed batch adds nothing, as its keys are there already.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        keys = new_keys(df, spark.read.parquet(table), key) if there else df.where(f"{key} is not null").select(key).distinct()
        enrich(keys).write.mode("append").parquet(table)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
