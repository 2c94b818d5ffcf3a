"""CSV exports and landing rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postledger.operators.reports import export_rows
from postledger.schemas import LANDING_COLUMNS


def _csv_writer(rows: DataFrame):
    return (
        rows.write.mode("errorifexists")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("encoding", "UTF-8")
    )


def export_jobs(listed: DataFrame, path: str) -> None:
    """Write a ranked list under its export headings, in list order.

    The list is a top-k report of a few thousand rows, so it is one file.
    """
    _csv_writer(export_rows(listed).coalesce(1)).csv(path)


def write_landing(merged: DataFrame, path: str) -> None:
    """Write merged landing rows to a new path: kept rows first, then new ones in order.

    The path that was read is never overwritten.
    """
    ordered = merged.repartitionByRange("part", "pos").sortWithinPartitions("part", "pos")
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in LANDING_COLUMNS]
    _csv_writer(ordered.select(*blank)).csv(path)
