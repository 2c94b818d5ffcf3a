"""Exclusion of postings by company and by title."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from postledger.functions.links import let
from postledger.functions.text import match_key, strip

# Fixed value: the keyword that matches as a word, with its two longer forms.
WORD_KEYWORD = "intern"
WORD_PATTERN = r"(?U)\bintern(?:s|ship)?\b"


# Letters of the pieces by which a table of fragments meets companies.
GRAM = 3


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions, F.lit(False))


def _contains_any(text: Column, fragments: list[Column]) -> Column:
    """True where the text contains one of the non-empty constant fragments.

    The text is evaluated once, and the list is one constant of the plan however
    long it is.
    """
    wanted = F.filter(F.array(*fragments), lambda fragment: fragment != "")
    return let(text, lambda value: F.exists(wanted, lambda fragment: F.contains(value, fragment)))


def company_excluded(company: Column, fragments: list[str]) -> Column:
    """True where the company key contains one of the non-empty fragment keys."""
    if not fragments:
        return F.lit(False)
    return _contains_any(match_key(company), [match_key(F.lit(fragment)) for fragment in fragments])


def exclude_companies(postings: DataFrame, fragments: list[str], column: str = "company") -> DataFrame:
    """Drop postings whose company contains a fragment from a given list."""
    if not fragments:
        return postings
    return postings.where(~company_excluded(F.col(column), fragments))


def exclude_companies_by_table(
    postings: DataFrame,
    fragments: DataFrame,
    column: str = "company",
) -> DataFrame:
    """The same for a table of fragments (column ``fragment``).

    The table is compared with the distinct companies only. A fragment of GRAM
    letters or more meets the companies that hold the one of its grams which the
    fewest companies hold, and is then looked for in them; a shorter one meets the
    pieces of its own length. The work thus follows the lengths of the texts, however
    many lengths of fragments there are. NULL companies and empty fragments match
    nothing; no table is broadcast for its assumed size.
    """
    keys = fragments.select(match_key(F.col("fragment")).alias("fragment")).where("fragment <> ''").distinct()
    companies = postings.select(F.col(column).alias("_name")).distinct().withColumn("_key", match_key(F.col("_name")))
    whole = keys.where(F.length("fragment") >= GRAM)
    grams = companies.select("_name", "_key", F.explode(_pieces(F.col("_key"), GRAM)).alias("_gram"))
    held = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_held"))
    # A gram that no company holds comes first: such a fragment meets nothing.
    rarest = (
        whole.select("fragment", F.explode(_pieces(F.col("fragment"), GRAM)).alias("_gram"))
        .join(held, "_gram", "left")
        .groupBy("fragment")
        .agg(F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("n"), "_gram")).alias("_rare"))
        .select("fragment", F.col("_rare._gram").alias("_gram"))
    )
    found = grams.join(rarest, "_gram").where(F.contains("_key", "fragment")).select("_name")
    sizes = F.array(*[F.lit(n) for n in range(1, GRAM)])
    pieces = companies.select(
        "_name", F.explode(F.flatten(F.transform(sizes, lambda n: _pieces(F.col("_key"), n)))).alias("fragment")
    )
    short = pieces.join(keys.where(F.length("fragment") < GRAM), "fragment", "left_semi").select("_name")
    excluded = found.unionByName(short).distinct()
    return postings.join(excluded, postings[column] == excluded["_name"], "left_anti")


def _pieces(text: Column, size: int | Column) -> Column:
    """The different pieces of so many letters; none of a shorter text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    pieces = F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))
    return F.when(F.length(text) >= size, pieces).otherwise(F.array().cast("array<string>"))


def title_excluded(title: Column, keywords: list[str]) -> Column:
    """Plain form: the lower-case title contains a keyword, spaces included."""
    text = F.lower(title)
    return _any([text.contains(F.lower(F.lit(keyword))) for keyword in keywords if keyword])


def title_excluded_by_word(title: Column, keywords: list[str]) -> Column:
    """Word-aware form: keywords are stripped, and ``intern`` spares ``internal``."""
    text = F.lower(title)
    hits = []
    for keyword in keywords:
        key = F.lower(strip(F.lit(keyword)))
        hits.append(
            F.when(key == "", False)
            .when(key == WORD_KEYWORD, text.rlike(WORD_PATTERN))
            .otherwise(text.contains(key))
        )
    return _any(hits)
