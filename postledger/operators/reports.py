"""Fixed reports over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postledger.functions.links import INDEED, LINKEDIN, site_label, site_link
from postledger.functions.text import nocase, status_view
from postledger.operators.scans import is_new

# Export columns and their headings; default row limits.
EXPORT_COLUMNS = {
    "website": "Website",
    "source_id": "JobID",
    "company": "Company",
    "title": "Job title",
    "linkedin": "LinkedIn",
    "indeed": "Indeed",
    "url": "URL",
}
RANKED_LIMIT = 25
NEW_LIMIT = 100
APPLICATIONS_LIMIT = 50
EXPORT_LIMIT = 10_000


def with_company(rows: DataFrame, companies: DataFrame) -> DataFrame:
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    return rows.join(names, "company_id")


def with_site_columns(jobs: DataFrame, sites=(LINKEDIN, INDEED)) -> DataFrame:
    """Add ``website``, ``linkedin`` and ``indeed``."""
    source, url, source_id = F.col("source"), F.col("url"), F.col("source_id")
    return (
        jobs.withColumn("website", site_label(source, url, source_id, sites))
        .withColumn("linkedin", site_link(sites[0], source, url, source_id))
        .withColumn("indeed", site_link(sites[1], source, url, source_id))
    )


def ranked_jobs(
    jobs: DataFrame,
    companies: DataFrame,
    scans: DataFrame,
    *,
    min_score: float = 0,
    scored_only: bool = False,
    status: str | None = None,
    source: str | None = None,
    limit: int = RANKED_LIMIT,
    sites=(LINKEDIN, INDEED),
) -> DataFrame:
    """Jobs in list order: new in the latest scan first, then newest, company, title, site."""
    rows = jobs
    if scored_only:
        rows = rows.where(F.col("match_score") >= min_score)
    if status:
        rows = rows.where(F.col("status") == status)
    if source:
        rows = rows.where(F.col("source") == source)
    rows = with_site_columns(rows.withColumn("is_new", is_new(scans, source)), sites)
    return (
        with_company(rows, companies)
        .orderBy(
            F.desc("is_new"),
            F.desc("first_seen_at"),
            nocase(F.col("company")),
            nocase(F.col("title")),
            nocase(F.col("website")),
            F.desc("last_seen_at"),
            "source",
            "source_id",
        )
        .limit(limit)
        .select(
            "id", "website", "source_id", "title", "company", "linkedin", "indeed", "location", "source",
            "posted_at", "first_seen_at", "last_seen_at", "seen_count", "match_score", "status", "url",
        )
    )


def new_jobs(
    jobs: DataFrame,
    companies: DataFrame,
    scans: DataFrame,
    *,
    source: str | None = None,
    limit: int = NEW_LIMIT,
    sites=(LINKEDIN, INDEED),
) -> DataFrame:
    """Jobs first seen in the latest scan, newest first.

    The order does not need the company, so only the rows shown are joined.
    """
    rows = jobs.where(F.col("source") == source) if source else jobs
    shown = (
        rows.where(is_new(scans, source))
        .orderBy(F.desc("first_seen_at"), "source", "source_id")
        .limit(limit)
    )
    return with_company(with_site_columns(shown, sites), companies).select(
        "website", "source", "source_id", "title", "company", "linkedin", "indeed", "url", "first_seen_at"
    )


def applications_report(applications: DataFrame, companies: DataFrame, limit: int = APPLICATIONS_LIMIT) -> DataFrame:
    """Applications by last change, with the company as it was when applied."""
    shown = applications.orderBy(F.desc("updated_at"), "job_id").limit(limit)
    return with_company(shown, companies).select(
        "job_id", "company", "position", "status", "applied_at", "notes", "updated_at"
    )


def view_counts(jobs: DataFrame) -> DataFrame:
    """Rows per view, and the total."""
    return (
        jobs.groupBy(status_view(F.col("status")).alias("view"))
        .agg(F.count(F.lit(1)).alias("n"))
        .rollup("view")
        .agg(F.sum("n").alias("n"))
        .select(F.coalesce("view", F.lit("total")).alias("view"), "n")
    )


def in_view(jobs: DataFrame, view: str) -> DataFrame:
    """Rows of one view, marked new while they were seen at most once."""
    return jobs.where(status_view(F.col("status")) == view).withColumn(
        "is_new", F.coalesce("seen_count", F.lit(0)) <= 1
    )


def report_rows(listed: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Data behind the page report: marks, row key and cells without NULLs.

    A row is marked new if its posting id is among the new ones, of any source.
    """
    ids = new_rows.select("source_id").distinct().withColumn("_new", F.lit(True))
    marked = listed.join(ids, "source_id", "left")
    blank = {name: F.coalesce(F.col(name), F.lit("")).alias(name) for name in EXPORT_COLUMNS}
    return marked.select(
        *blank.values(),
        F.coalesce("_new", F.lit(False)).alias("is_new"),
        (F.lower(F.coalesce("status", F.lit(""))) == "applied").alias("is_applied"),
        F.concat(F.coalesce("website", F.lit("")), F.lit(":"), F.coalesce("source_id", F.lit(""))).alias("job_key"),
        F.lower(F.coalesce("status", F.lit(""))).alias("status"),
    )


def export_rows(listed: DataFrame) -> DataFrame:
    """The exported columns under their headings, without NULLs."""
    return listed.select(
        *[F.coalesce(F.col(name), F.lit("")).alias(title) for name, title in EXPORT_COLUMNS.items()]
    )
