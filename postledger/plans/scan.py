"""A whole scan: sources to ledger, with a summary row per source."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from postledger.operators.exclusion import exclude_companies
from postledger.operators.ledger import KEY, LONG, upsert_buckets
from postledger.operators.matching import build_profiles, score_postings
from postledger.operators.scans import scan_rows
from postledger.shared import cut, shared_folder
from postledger.sources import state
from postledger.sources.registry import Source, load_source, select_sources


@dataclass
class ScanSettings:
    """What a scan drops, whether it scores, and the buckets of a ledger it begins."""

    excluded_companies: list[str] = field(default_factory=list)
    cv: DataFrame | None = None
    required_keywords: list[str] = field(default_factory=list)
    buckets: int = state.BUCKETS


def _profile(settings: ScanSettings) -> DataFrame | None:
    if settings.cv is None:
        return None
    required = F.array(*[F.lit(word) for word in settings.required_keywords]).cast("array<string>")
    return build_profiles(settings.cv.withColumn("required", required))


def settled_profile(settings: ScanSettings) -> DataFrame | None:
    profile = _profile(settings)
    return None if profile is None else cut(profile, "profile")


def scored_postings(postings: DataFrame, settings: ScanSettings, profile: DataFrame | None) -> DataFrame:
    """What a scan keeps of a source's postings, scored."""
    return score_postings(exclude_companies(postings, settings.excluded_companies), profile)


def fetch_postings(
    spark: SparkSession, sources: list[Source], settings: ScanSettings, workers: int = 2, apart: bool = False
) -> tuple:
    """Scored postings of all sources that could be read, and the errors of the rest; texts ``apart`` as of fetch_parts."""
    batch, texts, errors = fetch_parts(spark, sources, settings, workers)
    if apart:
        return batch, texts, errors
    return (None if batch is None else batch.join(texts.select("row", *LONG), "row").drop("row")), errors


def fetch_parts(
    spark: SparkSession, sources: list[Source], settings: ScanSettings, workers: int = 2
) -> tuple[DataFrame | None, DataFrame | None, dict[str, str]]:
    """Scored postings of all sources that could be read, their texts, and the errors of the rest.

    Each source is settled on its own, so a broken one cannot fail the others;
    filtering and scoring run in the tasks that read it. The long attributes are not
    written a second time: ``texts`` has them, read from where the source lies settled,
    with the key and ``row``, the number of the posting over all sources. Up to ``workers`` sources
    are read side by side, each in a scheduler pool of its own, so that under FAIR
    scheduling a slow one does not hold up the rest.
    """
    shared_folder(spark)  # settled before threads ask for it
    profile = settled_profile(settings)

    def fetch(order: int, source: Source) -> tuple[tuple[DataFrame, DataFrame] | None, str | None]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"source-{order}")
        try:
            # Arrival order over all sources: source by source, then as read.
            row = F.shiftleft(F.lit(order).cast("bigint"), 52) + F.col("pos")
            loaded = load_source(spark, source)
            scored = scored_postings(loaded, settings, profile).withColumns({"source_order": F.lit(order), "row": row})
            texts = loaded.select(*KEY, row.alias("row"), *LONG)
            return (cut(scored.drop(*LONG), f"fetch-{order}"), texts), None
        except Exception as error:  # any failure of a source is recorded and the scan goes on
            return None, str(error).split("\n")[0]

    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(sources)))) as threads:
        running = [threads.submit(inheritable_thread_target(spark)(fetch), i, s) for i, s in enumerate(sources)]
        done = [future.result() for future in running]
    fetched = [found for found, _ in done if found is not None]
    errors = {source.name: error for source, (found, error) in zip(sources, done) if found is None}
    if not fetched:
        return None, None, errors
    return *(reduce(DataFrame.unionByName, rows) for rows in zip(*fetched)), errors


def run_scan(
    spark: SparkSession,
    root: str,
    sources: list[Source],
    settings: ScanSettings,
    batch_ts: str,
    names: list[str] | None = None,
    dry_run: bool = False,
    finished_ts: str | None = None,
    workers: int = 2,
) -> DataFrame:
    """Scan the chosen sources into the ledger; returns the summaries.

    The log rows of the scan are committed open, without a finish time, before any
    source is read, and closed in the version that brings the postings: a scan that
    is killed stays visible as open rows. All rows carry ``batch_ts``. Of two
    scans that end at once, the second merges its postings into what the first
    committed. The log's finish time is the time at which the counts were known,
    unless given. A dry run reads, filters and scores, but writes nothing and counts
    no updates.
    """
    chosen = select_sources(sources, names)
    started = F.lit(batch_ts).cast("timestamp_ntz")
    order = spark.createDataFrame([(s.name, i) for i, s in enumerate(chosen)], "source string, source_order int")
    zeros = {name: F.lit(0).cast("bigint") for name in ("found_count", "new_count", "updated_count")}
    opening = None
    if not dry_run:
        opened = order.withColumn("started_at", started).withColumn("error", F.lit(None).cast("string"))
        waiting = scan_rows(opened, order.select("source").withColumns(zeros), F.lit(None).cast("timestamp_ntz"))
        opening = state.write_part(root, "scans", waiting.coalesce(1), state.OPEN)
        state.commit_changes(spark, root, lambda manifest: manifest + opening, buckets=settings.buckets)

    batch, texts, errors = fetch_postings(spark, chosen, settings, workers, True)
    failed = spark.createDataFrame([(s.name, errors.get(s.name)) for s in chosen], "source string, error string")
    opened = order.join(failed, "source").withColumn("started_at", started)
    counts = order.select("source").withColumns(zeros).limit(0)

    if dry_run and batch is not None:
        found = batch.groupBy("source").agg(F.count(F.lit(1)).alias("found_count"))
        counts = found.withColumns({name: zeros[name] for name in ("new_count", "updated_count")})

    if not dry_run:
        if batch is not None:
            sightings = batch.withColumns({"seen_at": started, "pos": F.col("row")})

        def close(manifest: list[dict]) -> list[dict]:
            nonlocal counts
            paths = {part["path"] for part in opening}
            parts = [part for part in manifest if part["path"] not in paths]
            if batch is not None:
                parts, counts = merged_parts(spark, root, parts, sightings, settings.buckets, texts)
            now = finished_ts or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
            log = scan_rows(opened, counts, F.lit(now).cast("timestamp_ntz"))
            return parts + state.write_part(root, "scans", log.coalesce(1))

        state.commit_changes(spark, root, close, buckets=settings.buckets)

    summary = opened.join(counts, "source", "left").fillna(0, list(zeros))
    return summary.orderBy("source_order").select("source", *zeros, "error")


def merged_parts(
    spark: SparkSession, root: str, parts: list[dict], sightings: DataFrame, buckets: int, texts: DataFrame | None = None
) -> tuple[list[dict], DataFrame]:
    """The parts after an upsert of the sightings, and its counts per source."""
    jobs = [part for part in parts if part["tbl"] == "jobs"]
    buckets = next((part["buckets"] for part in jobs), buckets)
    result = upsert_buckets(
        lambda touched: state.read_parts(spark, "jobs", [part for part in jobs if part["bucket"] in set(touched)]),
        state.read_parts(spark, "companies", [part for part in parts if part["tbl"] == "companies"]),
        sightings,
        max((part["top"] for part in jobs), default=0),
        state.bucket_of(buckets),
        texts,
    )
    rewritten = set(result.buckets)
    parts = [part for part in parts if part["tbl"] != "jobs" or part["bucket"] not in rewritten]
    parts += state.write_buckets(spark, root, result.jobs, buckets)
    if not result.companies.isEmpty():
        parts += state.write_part(root, "companies", result.companies)
    return parts, cut(result.counts, "counts")
