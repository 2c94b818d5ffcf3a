"""Schemas of postings, landed files and ledger tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The columns of a landed file, in order.
LANDING_COLUMNS = [
    "source_id", "title", "company", "location", "url", "description", "posted_at", "remote",
]

LANDING = T.StructType([T.StructField(name, T.StringType()) for name in LANDING_COLUMNS])

POSTING = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("posted_at", T.StringType()),
    T.StructField("remote", T.BooleanType()),
    T.StructField("raw", T.StringType()),
    T.StructField("pos", T.LongType()),
])

CARD = T.StructType([
    T.StructField(name, T.StringType())
    for name in [*LANDING_COLUMNS, "easy_apply"]
])

PAGE_RESULT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("blocked", T.BooleanType()),
    T.StructField("error", T.BooleanType()),
    T.StructField("message", T.StringType()),
    T.StructField("rows", T.ArrayType(CARD)),
])

COMPANIES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("website", T.StringType()),
    T.StructField("first_seen_at", T.TimestampNTZType()),
])

JOBS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("company_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("remote", T.BooleanType()),
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("posted_at", T.StringType()),
    T.StructField("first_seen_at", T.TimestampNTZType()),
    T.StructField("last_seen_at", T.TimestampNTZType()),
    T.StructField("last_pos", T.LongType()),
    T.StructField("seen_count", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("match_score", T.DoubleType()),
    T.StructField("matched_keywords", T.ArrayType(T.StringType())),
    T.StructField("missing_keywords", T.ArrayType(T.StringType())),
    T.StructField("raw", T.StringType()),
])

APPLICATIONS = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("company_id", T.LongType()),
    T.StructField("position", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("applied_at", T.TimestampNTZType()),
    T.StructField("notes", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

SCANS = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("finished_at", T.TimestampNTZType()),
    T.StructField("found_count", T.LongType()),
    T.StructField("new_count", T.LongType()),
    T.StructField("updated_count", T.LongType()),
    T.StructField("error", T.StringType()),
])

# Values that columns added later take in older snapshots.
JOB_DEFAULTS: dict[str, Column | object] = {
    "seen_count": 1,
    "status": "new",
    "match_score": 0.0,
    "raw": "{}",
    "last_pos": -1,
}


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Project to a schema: cast, add missing columns with their default or NULL."""
    defaults = defaults or {}
    columns = []
    for field in schema.fields:
        if field.name in df.columns:
            value = F.col(field.name)
        else:
            value = F.lit(defaults.get(field.name))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)
