"""JSON API payloads and tab results, from landed text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postledger.functions.text import blank_to_null, or_default, strip
from postledger.schemas import PAGE_RESULT, POSTING, conform
from postledger.sources.files import with_row_numbers

def read_documents(spark: SparkSession, paths: list[str], per_line: bool = False) -> DataFrame:
    """Landed documents as text: ``doc_key`` (the file) and ``body``.

    A document is a whole file, or a line of an archive with ``per_line``.
    """
    return (
        spark.read.text(paths, wholetext=not per_line)
        .select(
            F.col("_metadata.file_path").alias("doc_key"),
            F.col("value").alias("body"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )


def _numbered(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Add ``all_no``, from 1 over the items of all documents, by document and place."""
    block = F.col("block") if "block" in documents.columns else F.spark_partition_id().cast("bigint")
    return with_row_numbers(
        items.withColumns({"_file": F.col("doc_key"), "_block": block, "_m": F.monotonically_increasing_id()})
    )


def _kept(documents: DataFrame) -> list[str]:
    return [c for c in ("doc_key", "block") if c in documents.columns]


def json_postings(documents: DataFrame, name: str) -> DataFrame:
    """Postings of API payloads ``{"jobs": [...]}`` in column ``body``.

    Items stay JSON text until their fields are read, so ``raw`` keeps every
    field, with sorted keys. Documents that do not parse give no rows; see
    :func:`broken_documents`.
    """
    items = _numbered(
        documents,
        documents.select(*_kept(documents), F.explode(F.from_json("body", "jobs array<string>").getField("jobs")).alias("item")),
    )
    # The number 0, unlike the text "0", is no id.
    parsed = F.try_parse_json("item")
    zero = (F.schema_of_variant(F.try_variant_get(parsed, "$.id", "variant")) != "STRING") & F.col("f.id").isin("0", "0.0", "false")
    fields = F.from_json(
        "item",
        "id string, url string, title string, company_name string, "
        "candidate_required_location string, description string, publication_date string",
    )
    return conform(
        items.withColumn("f", fields).select(
            F.lit(name).alias("source"),
            F.coalesce(F.when(~F.coalesce(zero, F.lit(False)), blank_to_null(F.col("f.id"))), F.col("f.url"), F.lit("None")).alias("source_id"),
            or_default(F.col("f.title"), "Untitled").alias("title"),
            or_default(F.col("f.company_name"), "Unknown").alias("company"),
            or_default(F.col("f.candidate_required_location"), "Remote").alias("location"),
            F.col("f.url").alias("url"),
            or_default(F.col("f.description"), "").alias("description"),
            F.col("f.publication_date").alias("posted_at"),
            F.lit(True).alias("remote"),
            F.to_json(parsed).alias("raw"),
            (F.col("all_no") - 1).alias("pos"),
        ),
        POSTING,
    )


def broken_documents(documents: DataFrame) -> DataFrame:
    """Documents that are not JSON at all, with an error text."""
    return documents.where(F.try_parse_json("body").isNull()).select(
        "doc_key", F.lit("payload is not valid JSON").alias("error")
    )


def parse_tabs(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Tab results from JSON text; text that does not parse becomes an error row."""
    text = strip(F.col(column))
    parsed = F.from_json(text, PAGE_RESULT)
    failed = F.try_parse_json(text).isNull()
    return payloads.where(text != "").select(
        *[c for c in payloads.columns if c != column],
        F.when(failed, F.lit("")).otherwise(parsed["url"]).alias("url"),
        parsed["title"].alias("title"),
        F.coalesce(parsed["blocked"], F.lit(False)).alias("blocked"),
        (failed | F.coalesce(parsed["error"], F.lit(False))).alias("failed"),
        F.when(failed, text).otherwise(parsed["message"]).alias("message"),
        F.coalesce(parsed["rows"], F.array()).alias("rows"),
    )


def split_tabs(streams: DataFrame, column: str, delimiter: str) -> DataFrame:
    """One row per tab payload from text that holds many, in order."""
    keep = [c for c in streams.columns if c != column]
    return streams.select(
        *keep, F.posexplode(F.split(F.col(column), f"\\Q{delimiter}\\E")).alias("tab", "payload")
    )


def tab_rows(tabs: DataFrame) -> DataFrame:
    """Card rows of the tabs that did not fail."""
    keep = [c for c in tabs.columns if c not in ("rows", "title", "url", "blocked", "failed", "message")]
    return tabs.where("not failed").select(*keep, F.posexplode("rows").alias("at", "card")).select(*keep, "at", "card.*")


def tab_summary(tabs: DataFrame) -> DataFrame:
    """Numbers of tabs, failures, blocked pages and rows over all tabs."""
    fine = ~F.col("failed")
    return tabs.agg(
        F.count(F.lit(1)).alias("tabs"),
        F.count_if("failed").alias("failed"),
        F.count_if(fine & F.col("blocked")).alias("blocked"),
        F.coalesce(F.sum(F.when(fine, F.size("rows")).cast("bigint")), F.lit(0)).alias("rows"),
    )
