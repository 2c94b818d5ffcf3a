"""A scheduled scan as a stream: every micro-batch is one scan of the ledger.

A micro-batch brings ids, companies, jobs and closed scan rows in one version of the
ledger. The same version carries the number of the batch, so a batch that is
replayed after its commit changes nothing, and one that was killed before it is
done again from the version it finds.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from postledger.operators.scans import scan_rows
from postledger.plans.scan import ScanSettings, merged_parts, scored_postings, settled_profile
from postledger.shared import cut
from postledger.sources import state

COUNTS = ("found_count", "new_count", "updated_count")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a query keeps as long as its checkpoint; batch numbers belong to it."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def scan_batch(
    batch: DataFrame,
    batch_id: int,
    root: str,
    sources: list[str],
    shape: Callable[[DataFrame], DataFrame],
    settings: ScanSettings,
    stream: str,
    finished_ts: str | None = None,
) -> bool:
    """Bring one micro-batch into the ledger; False if it is in already or is empty.

    ``batch`` has ``seen_at``; the scan starts at its earliest. The scan rows of
    ``sources`` are committed open before the batch is shaped, and closed with the
    version that brings the postings. A failure leaves them open and fails the query;
    the replay closes the same rows. Postings of other sources are kept without a scan row.
    """
    spark = batch.sparkSession
    version = state.latest_version(spark, root)
    if state.finished_batch(state.read_manifest(spark, root, version), stream) >= batch_id:
        return False
    started = batch.agg(F.min("seen_at")).first()[0]
    if started is None:
        return False
    opened = spark.createDataFrame([(s, started, None) for s in sources], "source string, started_at timestamp_ntz, error string")
    zeros = opened.select("source").withColumns({name: F.lit(0).cast("bigint") for name in COUNTS})

    def begin(manifest: list[dict]) -> list[dict] | None:
        if state.opened_by(manifest, stream, batch_id):
            return None
        waiting = scan_rows(opened, zeros, F.lit(None).cast("timestamp_ntz"))
        part = state.write_part(root, "scans", waiting.coalesce(1), state.OPEN)
        return manifest + part + [state.opened_mark(stream, batch_id, part[0]["path"])]

    state.commit_changes(spark, root, begin, buckets=settings.buckets)
    postings = scored_postings(shape(batch), settings, settled_profile(settings))
    sightings = cut(postings, f"scan-{batch_id}")

    def close(manifest: list[dict]) -> list[dict] | None:
        if state.finished_batch(manifest, stream) >= batch_id:
            return None
        paths = state.opened_by(manifest, stream, batch_id)
        kept = [p for p in manifest if p["path"] not in paths and not state.is_mark(p, stream)]
        kept, counts = merged_parts(spark, root, kept, sightings, settings.buckets)
        now = finished_ts or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
        log = scan_rows(opened, counts, F.lit(now).cast("timestamp_ntz"))
        return kept + state.write_part(root, "scans", log.coalesce(1)) + [state.finished_mark(stream, batch_id)]

    state.commit_changes(spark, root, close, buckets=settings.buckets)
    return True


def scan_stream(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    sources: list[str],
    shape: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    settings: ScanSettings | None = None,
    available_now: bool = True,
    finished_ts: str | None = None,
) -> StreamingQuery:
    """Start a query whose micro-batches are scans of the ledger in ``root``.

    ``shape`` turns a raw micro-batch into postings with ``seen_at``, for landed CSV
    files :func:`postledger.sources.files.stream_postings`. Scans by other writers may
    commit in between.
    """
    settings = settings or ScanSettings()

    def take(batch: DataFrame, batch_id: int) -> None:
        scan_batch(batch, batch_id, root, sources, shape, settings, stream_id(batch.sparkSession, checkpoint), finished_ts)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
