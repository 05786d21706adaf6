"""Exact global row numbers and quantile bins without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .network import checkpointed


def with_row_numbers(df: DataFrame, *order: str, name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with the place of each row in ``order``, from 0, and the number of rows.

    Rows are range-partitioned and sorted inside their partitions; a partition's rows then start
    after those of the partitions before it, of which only the counts reach the driver.  Equal rows
    get different numbers, which one is arbitrary unless ``order`` settles it.
    """
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    # The checkpoint keeps partitions and their order: the low bits of the id are the place inside the partition.
    placed = ranged.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    starts, total = [], 0
    for r in sorted(placed.groupBy(part.alias("p")).count().collect()):
        starts.append((r.p, total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _start long")  # one row a partition
    numbered = placed.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return numbered.withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_id", "_start"), total


def quantile_bin(number: Column, total: int, bins: int) -> Column:
    """Bin from 1 to ``bins`` of a row number: sizes differ by one at most, the larger bins first."""
    size, more = divmod(total, bins)
    edge = more * (size + 1)
    small = (number - edge) / F.lit(max(size, 1)) + more + 1
    return F.floor(F.when(number < edge, number / (size + 1) + 1).otherwise(small)).cast("int")
