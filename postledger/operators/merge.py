"""Merging collected rows into a landing table, with a decision per row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from postledger.functions.flags import easy_apply
from postledger.functions.links import content_id, url_key
from postledger.functions.text import blank_to_null, strip
from postledger.operators.dedup import greedy_matching
from postledger.operators.exclusion import company_excluded, title_excluded_by_word
from postledger.schemas import LANDING_COLUMNS
from postledger.shared import cut


@dataclass
class MergeRules:
    """What a merge drops, and how it compares urls."""

    exclude_companies: list[str] = field(default_factory=list)
    exclude_titles: list[str] = field(default_factory=list)
    easy_apply_only: bool = False
    require_id: bool = True
    exact_url: bool = False


def union_rules(*lists: list[str] | None) -> list[str]:
    """One exclusion list from the global one and those of sources, in order, each entry once."""
    return list(dict.fromkeys(entry for entries in lists for entry in entries or []))


@dataclass
class Merge:
    """Result of a merge.

    decisions: every new row with ``decision``; kept: surviving existing rows;
    merged: kept rows and imported rows; counts: one row per decision.
    """

    decisions: DataFrame
    kept: DataFrame
    merged: DataFrame
    counts: DataFrame


def normalise_rows(rows: DataFrame, fill_id: bool = False) -> DataFrame:
    """The eight landing columns, stripped; other columns stay as they are."""
    for name in LANDING_COLUMNS:
        rows = rows.withColumn(name, strip(F.col(name)) if name in rows.columns else F.lit(""))
    if fill_id:
        rows = rows.withColumn(
            "source_id",
            content_id(F.col("source_id"), F.col("url"), F.col("title"), F.col("company"), F.col("location")),
        )
    return rows


def decide(rows: DataFrame, rules: MergeRules) -> DataFrame:
    """Add ``decision``: the first rule that applies, or NULL for a candidate."""
    required = ["source_id", "title", "company"] if rules.require_id else ["title", "company"]
    incomplete = F.lit(False)
    for name in required:
        incomplete = incomplete | (F.col(name) == "")
    decision = F.when(incomplete, "skipped")
    if rules.exclude_companies:
        decision = decision.when(company_excluded(F.col("company"), rules.exclude_companies), "excluded")
    if rules.exclude_titles:
        decision = decision.when(title_excluded_by_word(F.col("title"), rules.exclude_titles), "excluded")
    if rules.easy_apply_only:
        flag = F.col("easy_apply") if "easy_apply" in rows.columns else F.lit("")
        decision = decision.when(~easy_apply(flag, F.col("description")), "excluded")
    return rows.withColumn("decision", decision)


def known_keys(tables: list[DataFrame], exact_url: bool) -> tuple[DataFrame, DataFrame]:
    """Ids and url keys in use, from tables with ``source_id`` and ``url``."""
    ids, urls = None, None
    for table in tables:
        some_ids = table.select(F.col("source_id").alias("id")).where("id <> ''")
        key = F.col("url") if exact_url else url_key(F.col("url"))
        some_urls = table.select(key.alias("url_key")).where(F.col("url_key").isNotNull())
        if exact_url:
            some_urls = some_urls.where("url_key <> ''")
        ids = some_ids if ids is None else ids.unionByName(some_ids)
        urls = some_urls if urls is None else urls.unionByName(some_urls)
    return ids.distinct(), urls.distinct()


def merge_rows(
    new_rows: DataFrame,
    existing: DataFrame | None = None,
    ledger: DataFrame | None = None,
    rules: MergeRules | None = None,
) -> Merge:
    """Merge ``new_rows`` (with arrival order ``pos``) into the existing landing rows.

    Each row gets ``skipped``, ``excluded`` or ``imported``. A row is a duplicate
    if its id or url is used by a surviving existing row, by the ledger, or by an
    earlier imported row; rows that are not imported reserve nothing.
    """
    rules = rules or MergeRules()
    rows = decide(normalise_rows(new_rows, fill_id=not rules.require_id), rules)
    # The candidates are used by several joins below: settle them once, narrow.
    candidates = cut(
        rows.where(F.col("decision").isNull()).select(
            "pos", F.col("source_id").alias("id"), blank_to_null(F.col("url")).alias("url")
        ),
        "candidates",
    )

    removed = None
    kept = existing
    if existing is not None and rules.exclude_companies:
        out = company_excluded(F.col("company"), rules.exclude_companies)
        kept = existing.where(~out)
        removed = existing.where(out)

    fresh = candidates
    known = [table for table in (kept, ledger) if table is not None]
    if known:
        ids, urls = known_keys(known, rules.exact_url)
        key = F.col("url") if rules.exact_url else url_key(F.col("url"))
        open_ids = candidates.withColumn("url_key", key).join(ids, "id", "left_anti")
        # Rows without a url cannot meet a known one: they stay out of the join.
        fresh = (
            open_ids.where("url_key is not null")
            .join(urls, "url_key", "left_anti")
            .select("pos", "id", "url")
            .unionByName(open_ids.where("url_key is null").select("pos", "id", "url"))
        )
    imported = greedy_matching(fresh, exact_url=rules.exact_url)

    # pos is unique, so this join has no heavy keys.
    decisions = rows.join(imported.select("pos", F.lit(True).alias("_in")), "pos", "left").withColumn(
        "decision",
        F.coalesce(
            F.col("decision"), F.when(F.col("_in"), F.lit("imported")).otherwise(F.lit("skipped"))
        ),
    ).drop("_in")
    counts = decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    if removed is not None:
        gone = removed.agg(F.count(F.lit(1)).alias("n")).select(F.lit("excluded").alias("decision"), "n")
        counts = counts.unionByName(gone).groupBy("decision").agg(F.sum("n").alias("n")).where("n > 0")

    accepted = decisions.where("decision = 'imported'").select(*LANDING_COLUMNS, "pos")
    merged = accepted.withColumn("part", F.lit(1))
    if kept is not None:
        old = kept
        for name in LANDING_COLUMNS:
            if name not in old.columns:
                old = old.withColumn(name, F.lit(None).cast("string"))
        if "pos" not in old.columns:
            old = old.withColumn("pos", F.lit(None).cast("bigint"))
        merged = old.select(*LANDING_COLUMNS, F.col("pos").cast("bigint")).withColumn("part", F.lit(0)).unionByName(merged)
    return Merge(decisions, kept, merged, counts)
