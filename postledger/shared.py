"""Shared folder for intermediate tables, and joins that survive heavy keys."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

# A key is heavy if it holds more than 1/HEAVY_SHARE of all rows. There can be
# at most HEAVY_SHARE - 1 such keys, whatever the data, so tables with one row
# per heavy key are safe to broadcast.
HEAVY_SHARE = 1000

# Largest small table, in rows, that is looked up as a whole on every task.
SMALL_ROWS = 20_000


def ship_with_tasks(module: str) -> None:
    """Send a module's functions along with the tasks that use them.

    Python workers then need not have this package installed.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    A folder of its own is set only in local mode and only if none is named.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="postledger-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    The result no longer depends on the lineage before it, so a lost executor
    costs a re-read and non-deterministic ids stay as they were written. Options
    go to the writer.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("errorifexists").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, limit: int = SMALL_ROWS) -> bool:
    """Whether the table has at most ``limit`` rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def heavy_keys(rows: DataFrame, on: list[str], share: int = HEAVY_SHARE) -> DataFrame:
    """Keys that hold more than 1/``share`` of the rows: fewer than ``share`` of them."""
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    return counts.where(F.col("_n") * share > total).select(*on)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    share: int = HEAVY_SHARE,
) -> DataFrame:
    """Join rows to a table with at most one row per key, whatever the key skew.

    Rows of heavy keys stay where they are and meet a broadcast of their few
    lookup rows; all other rows are joined by shuffle. ``rows`` is read more than
    once, so it should be a stored table or cheap to compute. Joins that are not
    followed by a grouping on the same key need none of this: the adaptive
    skew join splits their heavy partitions.
    """
    heavy = F.broadcast(heavy_keys(rows, on, share))
    at_heavy = rows.join(heavy, on, "left_semi").join(
        F.broadcast(lookup.join(heavy, on, "left_semi")), on, how
    )
    # NULL keys are never heavy, so they take this branch.
    at_rest = rows.join(heavy, on, "left_anti").join(lookup, on, how)
    return at_heavy.unionByName(at_rest)
