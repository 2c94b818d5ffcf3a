"""The scan log and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postledger.operators.ledger import KEY
from postledger.schemas import SCANS, conform


def scan_log(sightings: DataFrame, scan_key: list[str], scans: DataFrame) -> DataFrame:
    """Found, new and updated counts of every scan in a log of sightings.

    ``sightings`` has the posting key, ``seen_at``, ``pos`` and the scan key;
    ``scans`` has the scan key, times and error. A sighting is new if it is the
    first of its key; the rest are updates. First sightings come from a partial
    aggregate per key, so heavy keys and heavy scans are combined on the map side.
    """
    first = (
        sightings.groupBy(*KEY)
        .agg(F.min_by(F.struct(*[F.col(k).alias(f"s_{k}") for k in scan_key]), F.struct("seen_at", "pos")).alias("scan"))
        .groupBy(*[F.col(f"scan.s_{k}").alias(k) for k in scan_key])
        .agg(F.count(F.lit(1)).alias("new_count"))
    )
    found = sightings.groupBy(*scan_key).agg(F.count(F.lit(1)).alias("found_count"))
    zero = F.lit(0).cast("bigint")
    return (
        scans.join(found, scan_key, "left")
        .join(first, scan_key, "left")
        .withColumn("found_count", F.coalesce("found_count", zero))
        .withColumn("new_count", F.coalesce("new_count", zero))
        .withColumn("updated_count", F.col("found_count") - F.col("new_count"))
    )


def scan_rows(opened: DataFrame, counts: DataFrame, finished_at: Column) -> DataFrame:
    """Finished log rows: one per opened scan, zero counts where nothing was found.

    ``opened`` has ``source``, ``started_at``, ``error``; ``counts`` one row per source.
    """
    rows = opened.join(counts, "source", "left").fillna(0, ["found_count", "new_count", "updated_count"])
    return conform(rows.withColumn("finished_at", finished_at), SCANS)


def latest_start(scans: DataFrame, source: str | None = None) -> Column:
    """Start of the newest scan without an error, as a scalar; NULL if there is none.

    Unfinished scans count. Without a source the newest scan of any source decides.
    """
    usable = scans.where("error is null")
    if source:
        usable = usable.where(F.col("source") == source)
    return usable.agg(F.max("started_at")).scalar()


def is_new(scans: DataFrame, source: str | None = None) -> Column:
    """Seen once, and not before the latest scan began."""
    since = latest_start(scans, source)
    return (F.col("seen_count") == 1) & (since.isNull() | (F.col("first_seen_at") >= since))


def any_error(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False)).alias("failed"))
