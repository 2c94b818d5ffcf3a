"""Surrogate numbers in arrival order, without a global window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from postledger.shared import cut

_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in its low 33 bits


def arrival_ids(rows: DataFrame, order: list[str], start: Column | int = 0, name: str = "id") -> DataFrame:
    """Number the rows start+1, start+2, ... in the given order, without gaps.

    Rows are range-partitioned and sorted, numbered inside their partition, and
    shifted by the sizes of the partitions before. The rows are settled first, so
    a repeated task cannot hand out other numbers; only one row per partition
    is summed up.
    """
    placed = cut(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id()),
        "ids",
    )
    placed = placed.withColumn("_part", F.shiftright("_m", _ROW_BITS)).withColumn(
        "_row", F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )
    # One row per partition, so this is as long as the list of tasks.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).orderBy("_part").collect()
    before = accumulate((row["_size"] for row in sizes), initial=0)
    offsets = rows.sparkSession.createDataFrame(
        [(row["_part"], n) for row, n in zip(sizes, before)], "_part bigint, _before bigint"
    )
    start = F.lit(start) if isinstance(start, int) else start
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_row") + 1 + start).cast("bigint"))
        .drop("_m", "_part", "_row", "_before")
    )
