"""Constraint checks as queries that return the violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count. NULL keys never clash."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return table.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_parents(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose reference names no parent; NULL references are allowed."""
    keys = parent.select(F.col(parent_column).alias(column))
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def missing_values(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with NULL in a column that must have a value."""
    return table.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def ledger_violations(jobs: DataFrame, companies: DataFrame, applications: DataFrame) -> DataFrame:
    """Number of violations per rule of the ledger tables."""
    found = {
        "companies_name_unique": duplicate_keys(companies, ["name"]),
        "jobs_key_unique": duplicate_keys(jobs, ["source", "source_id"]),
        "applications_job_unique": duplicate_keys(applications, ["job_id"]),
        "jobs_company_exists": missing_parents(jobs, "company_id", companies, "id"),
        "applications_job_exists": missing_parents(applications, "job_id", jobs, "id"),
        "applications_company_exists": missing_parents(applications, "company_id", companies, "id"),
        "jobs_not_null": missing_values(
            jobs, ["source", "source_id", "company_id", "title", "first_seen_at", "last_seen_at", "seen_count", "status"]
        ),
    }
    counts = [
        rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, rows in found.items()
    ]
    return reduce(DataFrame.unionByName, counts)
