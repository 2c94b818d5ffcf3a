"""The ledger kept up to date from a stream of sightings.

A micro-batch is folded on its own and written as one delta; the ledger is the
fold of all deltas, and compaction replaces them by their fold. The cost of a
micro-batch thus follows the batch, not the ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from postledger.operators.ledger import combine_folds, fold_sightings


def write_delta(batch: DataFrame, root: str, batch_id: int) -> None:
    """Fold one micro-batch into its own folder. Running it again replaces the folder."""
    fold_sightings(batch).write.mode("overwrite").parquet(f"{root.rstrip('/')}/deltas/batch={batch_id}")


def read_deltas(spark: SparkSession, root: str, above: int = -1) -> DataFrame | None:
    try:
        deltas = spark.read.option("basePath", f"{root.rstrip('/')}/deltas").parquet(f"{root.rstrip('/')}/deltas")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None
    return deltas.where(F.col("batch") > above).drop("batch")


def _base(spark: SparkSession, root: str) -> tuple[DataFrame | None, int]:
    """Newest compacted fold and the last batch that is in it."""
    try:
        marks = spark.read.schema("upto bigint").json(f"{root.rstrip('/')}/bases/done")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None, -1
    upto = marks.agg(F.max("upto")).first()[0]
    if upto is None:
        return None, -1
    return spark.read.parquet(f"{root.rstrip('/')}/bases/upto={upto}"), upto


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Ledger rows by natural key: the compacted fold and every delta after it."""
    base, upto = _base(spark, root)
    deltas = read_deltas(spark, root, upto)
    parts = [part for part in (base, deltas) if part is not None]
    if not parts:
        raise ValueError(f"no ledger at {root}")
    folds = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return combine_folds(folds)


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """Replace the deltas up to a finished batch by their fold.

    The mark is written after the fold, so an interrupted run changes nothing.
    """
    base, done = _base(spark, root)
    deltas = spark.read.parquet(f"{root.rstrip('/')}/deltas").where(
        (F.col("batch") > done) & (F.col("batch") <= upto)
    ).drop("batch")
    folds = deltas if base is None else base.unionByName(deltas)
    combine_folds(folds).write.mode("overwrite").parquet(f"{root.rstrip('/')}/bases/upto={upto}")
    spark.range(1).select(F.lit(upto).cast("bigint").alias("upto")).coalesce(1).write.mode("append").json(
        f"{root.rstrip('/')}/bases/done"
    )


def incremental_scan(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    shape: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    available_now: bool = True,
) -> StreamingQuery:
    """Start a query that folds every micro-batch of landed sightings into a delta.

    ``shape`` turns a raw micro-batch into sightings (exclusion, scoring). With
    ``available_now`` the query ends once all landed files are taken in, which is
    the scheduled scan; otherwise it keeps running.
    """
    writer = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: write_delta(shape(batch), root, batch_id))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_running(stream: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep :func:`running_sightings` in a folder: each micro-batch writes the keys it changed.

    Running a batch again replaces its folder. No row passes the driver.
    """
    writer = (
        running_sightings(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch_id}"))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_running(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of every key written by :func:`write_running`."""
    rows = spark.read.option("basePath", root).parquet(f"{root.rstrip('/')}/batch=*")
    value = F.struct("seen_count", "first_seen_at", "last_seen_at", "title")
    return rows.groupBy("source", "source_id").agg(F.max_by(value, "batch").alias("v")).select("source", "source_id", "v.*")


def running_sightings(stream: DataFrame) -> DataFrame:
    """Streaming form of the sightings fold: count, first, last and latest title per key.

    State is one small row per key. No event-time expiry exists in the semantics,
    so there is no watermark.
    """
    latest = F.struct("seen_at", "pos")
    return stream.groupBy("source", "source_id").agg(
        F.count(F.lit(1)).alias("seen_count"),
        F.min("seen_at").alias("first_seen_at"),
        F.max("seen_at").alias("last_seen_at"),
        F.max_by("title", latest).alias("title"),
    )
