"""Items of RSS and Atom documents, by one event pass over each document.

No schema of a feed is assumed: an item may stand at any depth and under any
element. A document is parsed once, with a stack instead of a tree, so that a task
holds the fields of a document's items and not its elements.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree.ElementTree import ParseError, XMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postledger.functions.text import blank_to_null, or_default, strip
from postledger.schemas import POSTING, conform
from postledger.shared import cut, ship_with_tasks
from postledger.sources.files import with_row_numbers
from postledger.sources.payloads import read_documents

ship_with_tasks(__name__)

# Child elements by meaning, in the order they are tried.
FEED_FIELDS = {
    "title": ["title"],
    "link": ["link"],
    "source_id": ["guid", "id"],
    "description": ["description", "summary", "content"],
    "posted_at": ["pubDate", "published", "updated"],
    "company": ["company", "author"],
}

NAMES = frozenset(name for names in FEED_FIELDS.values() for name in names)

ITEM = "_file string, _block bigint, _m bigint, " + ", ".join(f"`{f}` string" for f in FEED_FIELDS) + ", href string, error string"
ARROW_ITEM = pa.schema(
    [("_file", pa.string()), ("_block", pa.int64()), ("_m", pa.int64())]
    + [(f, pa.string()) for f in (*FEED_FIELDS, "href", "error")]
)

# Characters of fields after which a task hands on what it has found.
FLUSH = 4_000_000


class _Item:
    """What is kept of an item: the text of its first children by name, and a link's target."""

    __slots__ = ("depth", "bare", "prefixed", "href")

    def __init__(self, depth: int):
        self.depth, self.bare, self.prefixed, self.href = depth, {}, {}, None

    def field(self, names: list[str]) -> str | None:
        """Text of the first name whose child has any; a bare child comes before a prefixed one."""
        for name in names:
            text = "".join(self.bare.get(name, self.prefixed.get(name, ())))
            if text:
                return text
        return None


class _Events:
    """Parser target that collects the items of a document in the order they begin."""

    def __init__(self):
        self.depth, self.open, self.text = 0, [], None
        self.items, self.entries = [], []

    def start(self, tag: str, attributes: dict) -> None:
        self.depth += 1
        self.text = None  # only what stands before the first element below counts
        name = tag.rpartition("}")[2]
        parent = self.open[-1] if self.open and self.open[-1].depth == self.depth - 1 else None
        if parent is not None and name in NAMES:
            known = parent.bare if name == tag else parent.prefixed
            if name not in known:
                known[name] = self.text = []
            if name == "link" and not parent.href:
                parent.href = attributes.get("href")
        if self.depth > 1 and (tag == "item" or name == "entry"):
            item = _Item(self.depth)
            self.open.append(item)
            (self.items if tag == "item" else self.entries).append(item)

    def data(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)

    def end(self, tag: str) -> None:
        if self.open and self.open[-1].depth == self.depth:
            self.open.pop()
        self.depth -= 1
        self.text = None

    def close(self) -> list[_Item]:
        return self.items or self.entries


def _found(body: str | bytes | None) -> list[_Item]:
    parser = XMLParser(target=_Events())
    parser.feed(body or "")
    return parser.close()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of the documents of a task, numbered through; a broken document gives one row with its error."""
    number, rows, held = 0, [], 0
    for batch in batches:
        for at in range(batch.num_rows):
            key, block, body = (batch.column(name)[at].as_py() for name in ("doc_key", "block", "body"))
            try:
                items = _found(body)
            except (ParseError, ValueError):
                rows.append((key, block, None, *[None] * len(FEED_FIELDS), None, "feed is not well-formed XML"))
                continue
            for item in items:
                row = [item.field(names) for names in FEED_FIELDS.values()]
                rows.append((key, block, number, *row, item.href or None, None))
                number += 1
                held += sum(len(cell) for cell in row if cell)
                if held > FLUSH:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)
            rows, held = [], 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(cells, type=f.type) for cells, f in zip(zip(*rows), ARROW_ITEM)], schema=ARROW_ITEM
    )


def read_feeds(spark: SparkSession, paths: list[str], per_line: bool = False) -> DataFrame:
    """Landed feeds: whole files as bytes, so that a declared encoding counts, or lines of an archive."""
    if per_line:
        return read_documents(spark, paths, per_line=True)
    return spark.read.format("binaryFile").load(paths).select(
        F.col("path").alias("doc_key"), F.col("content").alias("body"), F.lit(0).cast("bigint").alias("block")
    )


def feed_items(documents: DataFrame) -> DataFrame:
    """The items of every document in column ``body``, and a row with ``error`` for each broken one.

    Items are the ``item`` elements without a prefix at any depth below the root, or,
    if a document has none, its ``entry`` elements under any prefix. Items inside
    items count too. A NULL or empty body is broken. Written once, read by the
    check for errors and by the postings.
    """
    block = F.col("block") if "block" in documents.columns else F.spark_partition_id().cast("bigint")
    shaped = documents.select("doc_key", block.alias("block"), "body")
    return cut(shaped.mapInArrow(_scan, ITEM), "feed")


def broken_feeds(items: DataFrame) -> DataFrame:
    """Documents that are not well-formed XML, with an error text."""
    return items.where("error is not null").select(F.col("_file").alias("doc_key"), "error")


def _text(name: str) -> Column:
    """White space alone counts as text and gives ''."""
    return F.when(F.col(name) != "", strip(F.col(name)))


def item_postings(items: DataFrame, name: str, feed_url: str, default_company: str = "Unknown") -> DataFrame:
    """Postings of :func:`feed_items`.

    An item without id and link is named by its number over all documents of the feed.
    """
    rows = with_row_numbers(items.where("error is null"), settled=True)
    text = {field: _text(field) for field in FEED_FIELDS}
    return conform(
        rows.withColumn("_url", F.coalesce(text["link"], F.col("href"))).select(
            F.lit(name).alias("source"),
            F.coalesce(
                blank_to_null(text["source_id"]),
                blank_to_null(F.col("_url")),
                F.concat(F.lit(f"{feed_url}#"), F.col("all_no").cast("string")),
            ).alias("source_id"),
            or_default(text["title"], "Untitled").alias("title"),
            or_default(text["company"], default_company).alias("company"),
            F.col("_url").alias("url"),
            or_default(text["description"], "").alias("description"),
            text["posted_at"].alias("posted_at"),
            F.to_json(F.struct(F.lit(feed_url).alias("feed_url"))).alias("raw"),
            (F.col("all_no") - 1).alias("pos"),
        ),
        POSTING,
    )


def feed_postings(documents: DataFrame, name: str, feed_url: str, default_company: str = "Unknown") -> DataFrame:
    """Postings of RSS and Atom documents in column ``body``; broken documents give none."""
    return item_postings(feed_items(documents), name, feed_url, default_company)
