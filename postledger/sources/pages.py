"""Posting cards from saved result pages.

Only the walk over the page's tags runs in Python, one page at a time in Arrow
batches; ids, links, flags and deduplication are Spark expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from postledger.functions.flags import (
    HUMAN_CHECK_PHRASES,
    LOGIN_PHRASES,
    REMOTE_WORDS,
    blocked,
    decode_references,
    easy_apply,
    remote_text,
    visible_text,
)
from postledger.functions.links import keyed_url, origin_of, query_param, text_hash, view_id, view_url
from postledger.functions.text import clean
from postledger.shared import ship_with_tasks

ship_with_tasks(__name__)


@dataclass(frozen=True)
class PageLayout:
    """Where a site's result page keeps its cards and their parts."""

    prefix: str
    cards: list[str]
    id_attribute: str
    link: list[str]
    title: list[str]
    company: list[str]
    location: list[str]
    blocked_phrases: list[str]
    numbered: bool


# Selectors of the two sites, each list in order of preference.
LAYOUTS = {
    "linkedin": PageLayout(
        prefix="linkedin-",
        cards=[".job-card-container", "li.jobs-search-results__list-item", "[data-job-id]"],
        id_attribute="data-job-id",
        link=['a[href*="/jobs/view/"]'],
        title=[
            ".job-card-list__title--link",
            ".job-card-list__title",
            ".job-card-container__link",
            'a[href*="/jobs/view/"]',
        ],
        company=[".artdeco-entity-lockup__subtitle", ".job-card-container__primary-description"],
        location=[".artdeco-entity-lockup__caption", ".job-card-container__metadata-item"],
        blocked_phrases=LOGIN_PHRASES,
        numbered=True,
    ),
    "indeed": PageLayout(
        prefix="indeed-",
        cards=["[data-jk]", ".job_seen_beacon", "td.resultContent", "div.cardOutline"],
        id_attribute="data-jk",
        link=['a[href*="/viewjob"]', 'a[href*="jk="]', "h2.jobTitle a", "a[data-jk]"],
        title=[
            '[data-testid="job-title"]',
            "h2.jobTitle a",
            "h2.jobTitle",
            "a[data-jk]",
            'a[href*="/viewjob"]',
        ],
        company=['[data-testid="company-name"]', ".companyName", '[data-testid="companyName"]'],
        location=['[data-testid="text-location"]', '[data-testid="job-location"]', ".companyLocation"],
        blocked_phrases=HUMAN_CHECK_PHRASES,
        numbered=False,
    ),
}

# Fixed value: the age mark every collected posting carries.
POSTED_MARK = "last-24h"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(("script", "style", "template", "noscript"))
_BLOCK = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
_STEP = re.compile(r'^([a-z0-9]*)((?:\.[\w-]+)*)(?:\[([\w-]+)(?:(\*?=)"([^"]*)")?\])?$')


class _Page(HTMLParser):
    """Elements in document order as (tag, attributes, ancestors, text pieces)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, dict, tuple[int, ...], list[str]]] = []
        self.open: list[int] = []

    def _emit(self, text: str) -> None:
        for index in self.open:
            self.elements[index][3].append(text)

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._emit("\n")
        attributes = {}
        for name, value in attrs:
            attributes.setdefault(name, value or "")
        self.elements.append((tag, attributes, tuple(self.open), []))
        if tag not in _VOID:
            self.open.append(len(self.elements) - 1)

    def handle_endtag(self, tag):
        depth = len(self.open) - 1
        while depth >= 0 and self.elements[self.open[depth]][0] != tag:
            depth -= 1
        if depth >= 0:
            del self.open[depth:]
            if tag in _BLOCK:
                self._emit("\n")

    def handle_data(self, data):
        if not any(self.elements[i][0] in _SILENT for i in self.open):
            # A line break in the source is only white space on the page.
            self._emit(re.sub(r"[\r\n]+", " ", data))


def _fits(step: str, tag: str, attributes: dict) -> bool:
    want_tag, classes, name, how, value = _STEP.match(step).groups()
    if want_tag and want_tag != tag:
        return False
    have = attributes.get("class", "").split()
    if any(c not in have for c in classes.split(".") if c):
        return False
    if name is None:
        return True
    if name not in attributes:
        return False
    return how is None or (attributes[name] == value if how == "=" else value in attributes[name])


def _selected(page: _Page, index: int, selector: str) -> bool:
    *outer, last = selector.split(" ")
    tag, attributes, ancestors, _ = page.elements[index]
    if not _fits(last, tag, attributes):
        return False
    return all(any(_fits(o, *page.elements[a][:2]) for a in ancestors) for o in outer)


def _first(page: _Page, inside: list[int], selectors: list[str]) -> int | None:
    """First element in document order that fits any of the selectors."""
    return next((i for i in inside if any(_selected(page, i, s) for s in selectors)), None)


def _spaced(text: str) -> str:
    return " ".join(text.split())


def _labelled(page: _Page, inside: list[int], selectors: list[str]) -> str:
    for selector in selectors:
        index = _first(page, inside, [selector])
        text = _spaced("".join(page.elements[index][3])) if index is not None else ""
        if text:
            return text
    return ""


def page_cards(html: str, layout: PageLayout) -> list[dict]:
    """Raw parts of every card of one page, in document order."""
    page = _Page()
    page.feed(html or "")
    page.close()
    inner: dict[int, list[int]] = {}
    cards = [i for i in range(len(page.elements)) if any(_selected(page, i, s) for s in layout.cards)]
    wanted = set(cards)
    for i, element in enumerate(page.elements):
        for ancestor in element[2]:
            if ancestor in wanted:
                inner.setdefault(ancestor, []).append(i)
    found = []
    for card in cards:
        inside = inner.get(card, [])
        text = "".join(page.elements[card][3])
        lines = [line for line in map(_spaced, text.split("\n")) if line] + ["", "", ""]
        link = _first(page, inside, layout.link)
        nested = _first(page, inside, [f"[{layout.id_attribute}]"])
        own = page.elements[card][1].get(layout.id_attribute, "")
        found.append({
            "at": len(found),
            "card_id": own or (page.elements[nested][1][layout.id_attribute] if nested is not None else ""),
            "href": page.elements[link][1].get("href", "") if link is not None else "",
            "title": _labelled(page, inside, layout.title) or lines[0],
            "company": _labelled(page, inside, layout.company) or lines[1],
            "location": _labelled(page, inside, layout.location) or lines[2],
            "description": _spaced(text),
        })
    return found


_CARD_COLUMNS = ["at", "card_id", "href", "title", "company", "location", "description"]


def raw_cards(pages: DataFrame, site: str, key: str = "page_id") -> DataFrame:
    """One row per card: page key and url, position and raw parts."""
    layout = LAYOUTS[site]
    slim = pages.select(F.col(key).cast("string").alias("page_key"), F.col("url").alias("page_url"), "html")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page.page_key, page.page_url, *card.values())
                for page in batch.itertuples(index=False)
                for card in page_cards(page.html, layout)
            ]
            yield pd.DataFrame(rows, columns=["page_key", "page_url", *_CARD_COLUMNS])

    return slim.mapInPandas(
        walk,
        "page_key string, page_url string, at int, card_id string, href string, "
        "title string, company string, location string, description string",
    )


def page_records(pages: DataFrame, site: str, key: str = "page_id") -> DataFrame:
    """Posting records of result pages, one per posting id and page.

    A posting shown twice on a page keeps the place of the first card and the
    values of the last. Cards without title, company or usable url are dropped.
    """
    layout = LAYOUTS[site]
    cards = raw_cards(pages, site, key)
    href, origin = F.col("href"), origin_of(F.col("page_url"))
    linked = view_id(href) if layout.numbered else query_param(href, "jk")
    cards = cards.withColumn("job_id", F.when(F.col("card_id") != "", F.col("card_id")).otherwise(linked))
    url = view_url(href, F.col("job_id"), origin) if layout.numbered else keyed_url(href, F.col("job_id"), origin)
    for name in ("title", "company", "location", "description"):
        cards = cards.withColumn(name, clean(F.col(name)))
    named = cards.withColumn("url", url).where("title <> '' and company <> '' and url <> ''")
    hashed = text_hash(F.concat_ws("|", "title", "company", "url"))
    records = named.select(
        "page_key",
        "at",
        F.concat(F.lit(layout.prefix), F.when(F.col("job_id") != "", F.col("job_id")).otherwise(hashed)).alias("source_id"),
        "title",
        "company",
        "location",
        "url",
        "description",
        F.lit(POSTED_MARK).alias("posted_at"),
        remote_text(REMOTE_WORDS[site], F.col("title"), F.col("location"), F.col("description")).alias("remote"),
        F.when(easy_apply(F.lit(""), F.col("description")), "true").otherwise("").alias("easy_apply"),
    )
    values = F.struct(*[c for c in records.columns if c not in ("page_key", "source_id", "at")])
    return (
        records.groupBy("page_key", "source_id")
        .agg(F.min("at").alias("at"), F.max_by(values, "at").alias("v"))
        .select("page_key", "at", "source_id", "v.*")
    )


def page_flags(pages: DataFrame, site: str, key: str = "page_id") -> DataFrame:
    """Per page: url, title and whether it asks for a login or a human check."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)
    return pages.select(
        F.col(key).cast("string").alias("page_key"),
        "url",
        clean(decode_references(title)).alias("title"),
        blocked(visible_text(F.col("html")), LAYOUTS[site].blocked_phrases).alias("blocked"),
    )


def page_summary(records: DataFrame, flags: DataFrame) -> DataFrame:
    """Per page: number of records, and the blocked flag."""
    counts = records.groupBy("page_key").agg(F.count(F.lit(1)).alias("n_records"))
    return flags.join(counts, "page_key", "left").select(
        "page_key", "url", F.coalesce("n_records", F.lit(0)).alias("n_records"), "blocked"
    )
