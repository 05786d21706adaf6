"""Shared pieces: landing intermediate tables and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="coaffil-"))
        folder = jsc.getCheckpointDir().get()
    return folder.rstrip("/")


def land(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage at a file that outlives any executor, so later jobs neither recompute nor
    depend on shuffle files.  The files of a session are removed when its driver exits.
    """
    spark = df.sparkSession
    top = f"{shared_folder(spark)}/landed-{spark.sparkContext.applicationId}"
    if top not in _folders:
        _folders[top] = spark
        atexit.register(_remove, top)
    path = f"{top}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(top: str) -> None:
    spark = _folders.pop(top, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], count: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``unique``, which has one row for each of ``keys`` and how many rows match it in ``count``.

    Keys with more than one of ``share`` of all ``total`` rows, of which there are fewer than
    ``share``, are joined by broadcast where their rows lie; the others by a shuffle.  So no task
    gathers a hot key.  ``count`` is dropped; keys must not be null.
    """
    hot = F.col(count) > max(200, total // share)
    wanted = [*rows.columns, *(c for c in unique.columns if c not in keys and c != count)]
    warm = rows.join(F.broadcast(unique.where(hot).select(*keys)), keys, "left_anti").join(unique.where(~hot), keys).select(*wanted)
    return warm.unionByName(rows.join(F.broadcast(unique.where(hot)), keys).select(*wanted))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (u, v): rows (id, component).

    ``component`` is the smallest id reachable.  Only ids that have an edge to another id are
    returned.  Alternates large-star and small-star steps, each a group minimum and a join on the
    node, until the edge set stops changing; every round is landed.
    """
    def oriented(e: DataFrame) -> DataFrame:
        e = e.where("u != v")
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = land(oriented(edges.select("u", "v")))
    seen = state(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        up = join_unique(both, low, ["u"], "n", 2 * seen[0]).where("v > u")
        large = land(up.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        down = join_unique(large, low, ["u"], "n", seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = oriented(down.unionByName(low.select("u", F.col("m").alias("v"))))
        e = land(small)
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
