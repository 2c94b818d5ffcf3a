"""Choosing sources and turning each into postings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from postledger.sources.files import csv_postings
from postledger.sources.feeds import broken_feeds, feed_items, item_postings, read_feeds
from postledger.sources.payloads import broken_documents, json_postings, read_documents


@dataclass
class Source:
    """A named source: its type, whether a default scan reads it, its options."""

    name: str
    type: str
    enabled: bool = True
    options: dict = field(default_factory=dict)


def _csv(spark: SparkSession, source: Source) -> DataFrame:
    options = source.options
    return csv_postings(
        spark,
        source.name,
        options["path"],
        options.get("exclude_title_keywords"),
        options.get("exclude_companies"),
        options.get("multi_line", True),
    )


def _refuse(broken: DataFrame) -> None:
    """A document that cannot be read fails its source, as a failed fetch would."""
    first = broken.orderBy("doc_key").first()
    if first:
        raise ValueError(f"{first['doc_key']}: {first['error']}")


def _json(spark: SparkSession, source: Source) -> DataFrame:
    options = source.options
    documents = read_documents(spark, [options["path"]], options.get("per_line", False))
    _refuse(broken_documents(documents))
    return json_postings(documents, source.name)


def _feed(spark: SparkSession, source: Source) -> DataFrame:
    options = source.options
    items = feed_items(read_feeds(spark, [options["path"]], options.get("per_line", False)))
    _refuse(broken_feeds(items))
    return item_postings(
        items, source.name, options.get("url", options["path"]), options.get("default_company", "Unknown")
    )


# The source types by name. Further types are added here as
# functions of session and source that return postings made of settled rows: they are
# read again for the long attributes.
LOADERS: dict[str, Callable[[SparkSession, Source], DataFrame]] = {
    "csv": _csv,
    "remotive": _json,
    "rss": _feed,
}


def load_source(spark: SparkSession, source: Source) -> DataFrame:
    if source.type not in LOADERS:
        raise ValueError(f"Unsupported source type: {source.type}")
    return LOADERS[source.type](spark, source)


def select_sources(sources: list[Source], names: list[str] | None = None) -> list[Source]:
    """Enabled sources, or the named ones whether enabled or not."""
    if names is None:
        chosen = [source for source in sources if source.enabled]
    else:
        chosen = [source for source in sources if source.name in set(names)]
    if not chosen:
        raise ValueError("No enabled sources matched the requested scan.")
    return chosen


def load_sources(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """Postings of several sources in one table."""
    return reduce(DataFrame.unionByName, [load_source(spark, source) for source in sources])
