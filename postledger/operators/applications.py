"""Application records and job status from an ordered log of actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from postledger.functions.text import strip
from postledger.schemas import APPLICATIONS, conform
from postledger.shared import HEAVY_SHARE, lookup_join

# The statuses that a view may set.
VALID_STATUSES = ["new", "applied", "discarded"]


@dataclass
class StatusChange:
    """New jobs and applications tables, and the actions that name no job."""

    jobs: DataFrame
    applications: DataFrame
    rejects: DataFrame


def split_statuses(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions with an allowed status (normalised) and those to be rejected."""
    shaped = actions.withColumn("status", F.lower(strip(F.col("status"))))
    allowed = F.col("status").isin(VALID_STATUSES)
    return shaped.where(allowed), shaped.where(~allowed)


def action_ends(actions: DataFrame) -> DataFrame:
    """Per job: final status, and the time and position of the last reset.

    A reset is a status set to anything but ``applied``; it deletes the record.
    An action recorded ``via`` ``apply`` keeps the record whatever its status.
    """
    when = F.struct("at", "pos")
    reset = (F.col("via") == "set_status") & (F.col("status") != "applied")
    return actions.groupBy("job_id").agg(
        F.max_by("status", when).alias("final_status"),
        F.max(F.when(reset, when)).alias("last_reset"),
    )


def open_records(actions: DataFrame, ends: DataFrame, share: int = HEAVY_SHARE) -> DataFrame:
    """Per job: first and last recording action after the last reset, if any.

    Two aggregates and a lookup instead of a window per job: a job that holds a
    third of the log is combined on the map side, never sorted in one task.
    """
    when = F.struct("at", "pos")
    recording = (F.col("via") == "apply") | (F.col("status") == "applied")
    marked = lookup_join(actions.where(recording), ends.select("job_id", "last_reset"), ["job_id"], "inner", share)
    current = marked.where(F.col("last_reset").isNull() | (when > F.col("last_reset")))
    return current.groupBy("job_id").agg(
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.max_by(F.struct("status", "notes"), when).alias("last"),
        F.count(F.lit(1)).alias("n_records"),
    )


def apply_actions(
    jobs: DataFrame, applications: DataFrame, actions: DataFrame, share: int = HEAVY_SHARE
) -> StatusChange:
    """Replay ``actions`` (``job_id, via, status, notes, at, pos``) onto both tables.

    A record made or kept takes status, notes (NULL too) and change time from the
    last recording action; company, title, application and creation time stay
    those of the action that made it. A reset removes it.
    """
    ends = action_ends(actions)
    known = jobs.select(F.col("id").alias("job_id"), "company_id", F.col("title").alias("position"))
    # One row per job on both sides of every join below.
    ends_known = ends.join(known.select("job_id"), "job_id", "left_semi")
    rejects = actions.join(known.select("job_id"), "job_id", "left_anti")

    new_jobs = (
        jobs.join(ends.select(F.col("job_id").alias("id"), "final_status"), "id", "left")
        .withColumn("status", F.coalesce("final_status", "status"))
        .select(*jobs.columns)
    )

    records = open_records(actions, ends, share)
    touched = ends_known.join(records, "job_id", "left").join(known, "job_id")
    old = applications.select(*[F.col(c).alias(f"old_{c}") if c != "job_id" else F.col(c) for c in APPLICATIONS.names])
    both = old.join(touched, "job_id", "full_outer")
    dropped = F.col("last_reset").isNotNull()
    keeps_old = F.col("old_created_at").isNotNull() & ~dropped
    recorded = F.col("n_records").isNotNull()
    rows = both.where(recorded | keeps_old).select(
        "job_id",
        F.when(keeps_old, F.col("old_company_id")).otherwise(F.col("company_id")).alias("company_id"),
        F.when(keeps_old, F.col("old_position")).otherwise(F.col("position")).alias("position"),
        F.when(recorded, F.col("last.status")).otherwise(F.col("old_status")).alias("status"),
        F.when(keeps_old, F.col("old_applied_at")).otherwise(F.col("first_at")).alias("applied_at"),
        F.when(recorded, F.col("last.notes")).otherwise(F.col("old_notes")).alias("notes"),
        F.when(keeps_old, F.col("old_created_at")).otherwise(F.col("first_at")).alias("created_at"),
        F.when(recorded, F.col("last_at")).otherwise(F.col("old_updated_at")).alias("updated_at"),
    )
    return StatusChange(new_jobs, conform(rows, APPLICATIONS), rejects)
