"""Text cleaning, defaults, flags and collation keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space for str.split/str.strip
# (PY_SPACE) and for the browser's \s (JS_SPACE). The patterns are valid in Java
# regular expressions and in RE2, so the SQL checks use them unchanged.
PY_SPACE = (
    r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
JS_SPACE = (
    r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)

# The same sets as plain characters, for trimming and translation.
_PY_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_JS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))

# Words read as true and as false.
TRUE_WORDS = ["1", "true", "yes", "y", "remote"]
FALSE_WORDS = ["0", "false", "no", "n", "onsite"]

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

# Letters whose case folding is not "upper-case both sides": each letter on the
# left is replaced by the one below it before upper-casing. Dotless i must stay
# apart from i, hence the private-use character.
_FOLD_FROM = "\u0131\u212a\u212b\u2126\u03f4"
_FOLD_TO = "\ue000K\u00c5\u03a9\u0398"


def or_default(col: Column, default) -> Column:
    """``default`` where the text is NULL or empty."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def strip(col: Column) -> Column:
    """Text without leading and trailing Unicode white space; NULL becomes ''."""
    return F.btrim(F.coalesce(col, F.lit("")), F.lit(_PY_CHARS))


def _single_spaced(col: Column, spaces: str) -> Column:
    """All of ``spaces`` become a space, runs become one. Only runs cost a regex match."""
    plain = F.translate(F.coalesce(col, F.lit("")), spaces, " " * len(spaces))
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def squeeze(col: Column) -> Column:
    """Runs of Unicode white space become one space, ends trimmed."""
    return _single_spaced(col, _PY_CHARS)


def clean(col: Column) -> Column:
    """The browser form of :func:`squeeze`, used on page text."""
    return _single_spaced(col, _JS_CHARS)


def display_company(col: Column) -> Column:
    """Company name as stored: white space collapsed, case kept, never empty."""
    return or_default(squeeze(col), "Unknown")


def match_key(col: Column) -> Column:
    """Case-folded, white-space-collapsed key for company comparison.

    Spark has no case folding; upper-casing both sides gives the same equality
    once the letters in ``_FOLD_FROM`` are replaced and capital sharp s and
    dotted capital i are expanded.
    """
    upper = F.upper(F.translate(squeeze(col), _FOLD_FROM, _FOLD_TO))
    return F.replace(
        F.replace(upper, F.lit("\u1e9e"), F.lit("SS")), F.lit("\u0130"), F.lit("I\u0307")
    )


def parse_flag(col: Column) -> Column:
    """Three-state boolean from free text."""
    word = F.lower(strip(col))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def nocase(col: Column) -> Column:
    """Sort key that ignores the case of ASCII letters only."""
    return F.translate(col, _ASCII_UPPER, _ASCII_LOWER)


def truncate(col: Column, limit: int = 70) -> Column:
    return F.when(F.length(col) <= limit, col).otherwise(
        F.concat(F.substring(col, 1, limit - 3), F.lit("..."))
    )


def iso_millis(col: Column) -> Column:
    """UTC timestamp as ISO-8601 text with milliseconds."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def lower_all(col: Column) -> Column:
    return F.transform(col, F.lower)


def normal_status(col: Column) -> Column:
    """Status as compared by the views: defaulted, stripped, lower case."""
    return F.lower(strip(or_default(col, "new")))


def status_view(col: Column) -> Column:
    """``applied`` and ``discarded`` have their own view, all else is ``open``."""
    status = normal_status(col)
    return F.when(status.isin("applied", "discarded"), status).otherwise(F.lit("open"))


def sorted_json(fields: Column) -> Column:
    """JSON object text with sorted keys from a map of strings; NULL values are kept."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(fields)))
    return F.to_json(ordered, {"ignoreNullFields": "false"})
