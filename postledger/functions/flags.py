"""Flags read from page and posting text."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from postledger.functions.text import clean, strip

# Phrases that show a page asks for a login or a human check.
LOGIN_PHRASES = [
    "security verification",
    "unusual activity",
    "verify your identity",
    "two-step verification",
    "checkpoint",
    "sign in",
]
HUMAN_CHECK_PHRASES = [
    "additional verification required",
    "verify you are human",
    "captcha",
    "cloudflare",
]

# Character references: names from the standard library's HTML table. Those that
# stand without a semicolon there may be followed by anything.
_NAMES = json.dumps(html5)
_OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))

# What the numbers 128 to 159 stand for in HTML; the others stay as they are.
_LATIN = {n: chr(n) for n in range(128, 160)} | {
    n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
}

# The words that mark a posting as remote, per site.
REMOTE_WORDS = {"linkedin": ["remote"], "indeed": ["remote", "home office"]}


def word_match(text: Column, words: list[str]) -> Column:
    """Any of the words, with ASCII word boundaries, case ignored."""
    edge_left, edge_right = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    return text.rlike(f"(?i){edge_left}(?:{'|'.join(words)}){edge_right}")


def remote_text(words: list[str], *parts: Column) -> Column:
    """``"true"`` if the joined parts name a remote word, else ''."""
    joined = F.concat_ws(" ", *[F.coalesce(part, F.lit("")) for part in parts])
    return F.when(word_match(joined, words), F.lit("true")).otherwise(F.lit(""))


def easy_apply(flag: Column, description: Column) -> Column:
    """An explicit flag word, or the phrase in the description."""
    stated = F.lower(strip(flag)).isin("1", "true", "yes")
    return stated | F.coalesce(description, F.lit("")).rlike(r"(?iU)\beasy\s+apply\b")


def _numbered_character(piece: Column) -> Column:
    """The character of ``#...`` or ``#x...``; '' for numbers that are no characters."""
    hexes = F.regexp_extract(piece, "^#[xX]0*([0-9a-fA-F]*)", 1)
    tens = F.regexp_extract(piece, "^#0*([0-9]*)", 1)
    is_hex = piece.rlike("^#[xX]")
    digits = F.when(is_hex, hexes).otherwise(tens)
    number = F.conv(F.when(digits == "", "0").otherwise(digits), 10, 10).cast("bigint")
    number = F.when(is_hex, F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10).cast("bigint")).otherwise(number)
    bad = (F.length(digits) > 7) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF) | (number == 0)
    nothing = (
        number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127) | number.between(0xFDD0, 0xFDEF)
        | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    latin = F.element_at(F.from_json(F.lit(json.dumps(_LATIN)), "map<string,string>"), number.cast("string"))
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(bad, "\ufffd").when(nothing, "").when(number.between(128, 159), latin).otherwise(plain)


def decode_references(text: Column) -> Column:
    """Character references of text taken from HTML, once from left to right, named or numeric.

    A name is taken whole, else by the longest beginning that may stand without a
    semicolon; what is no reference stays as it is.
    """
    names = F.from_json(F.lit(_NAMES), "map<string,string>")

    def decoded(piece: Column) -> Column:
        number = F.regexp_extract(piece, "^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0)
        whole = F.regexp_extract(piece, "^[A-Za-z][A-Za-z0-9]{1,31};?", 0)
        begun = F.regexp_extract(piece, f"^(?:{_OPEN_NAMES})", 0)
        rest = lambda found: F.substring(piece, F.length(found) + 1, F.length(piece))
        return (
            F.when(number != "", F.concat(_numbered_character(piece), rest(number)))
            .when((whole != "") & F.element_at(names, whole).isNotNull(), F.concat(F.element_at(names, whole), rest(whole)))
            .when(begun != "", F.concat(F.element_at(names, begun), rest(begun)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(text, "&")
    tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decoded)
    return F.when(text.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))).otherwise(text)


def visible_text(html: Column) -> Column:
    """Page body text: what is never shown, comments and tags removed, references decoded, cleaned."""
    body = F.regexp_replace(
        html,
        r"(?is)^.*?<body[^>]*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
        r"|<template\b.*?</template\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->",
        " ",
    )
    return clean(decode_references(F.regexp_replace(body, r"(?s)<[^>]*>", " ")))


def blocked(page_text: Column, phrases: list[str]) -> Column:
    """True where the lower-case page text contains any of the phrases."""
    text = F.lower(page_text)
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return F.coalesce(found, F.lit(False))
