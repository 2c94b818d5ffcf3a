"""Site labels, link columns, URL keys, posting ids and hashes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from postledger.functions.text import strip


@dataclass(frozen=True)
class Site:
    """One posting site: how its links and ids are recognised."""

    label: str
    source: str | None
    url_like: str
    id_like: str


# The two sites with link columns of their own, and the sources
# that carry a label directly.
LINKEDIN = Site("LinkedIn", None, "%linkedin.com%", "linkedin-%")
INDEED = Site("Indeed", "indeed", "%indeed.%", "indeed-%")
SOURCE_LABELS = {"indeed": "Indeed", "job-ch": "job.ch"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in an expression any number of times.

    Naming a column twice doubles its expression in the plan; binding it keeps
    long chains of url expressions, and the code generated for them, small.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def on_site(site: Site, url: Column, source_id: Column) -> Column:
    """True where url or id carry the site's mark; the patterns ignore case."""
    return F.coalesce(url.ilike(site.url_like), F.lit(False)) | F.coalesce(
        source_id.ilike(site.id_like), F.lit(False)
    )


def site_label(
    source: Column,
    url: Column,
    source_id: Column,
    sites: tuple[Site, ...] = (LINKEDIN, INDEED),
    source_labels: dict[str, str] = SOURCE_LABELS,
) -> Column:
    """Readable name of the site. Source names match exactly and come first."""
    label = F.when(F.lit(False), F.lit(""))
    for name, text in source_labels.items():
        label = label.when(source == name, F.lit(text))
    for site in sites:
        label = label.when(on_site(site, url, source_id), F.lit(site.label))
    return label.otherwise(source)


def site_link(site: Site, source: Column, url: Column, source_id: Column) -> Column:
    """The url if it belongs to ``site``, else ''. NULL if only the id does and url is NULL."""
    belongs = on_site(site, url, source_id)
    if site.source:
        belongs = F.coalesce(source == site.source, F.lit(False)) | belongs
    return F.when(belongs, url).otherwise(F.lit(""))


def url_key(url: Column) -> Column:
    """Stripped url without trailing slashes; NULL where there is no url."""
    return F.rtrim(F.nullif(strip(url), F.lit("")), F.lit("/"))


def url_variants(url: Column) -> Column:
    """The spellings of one url that count as equal: as is, without and with a slash."""
    def spellings(text: Column) -> Column:
        closed = F.when(text.endswith("/"), text).otherwise(F.concat(text, F.lit("/")))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(
            F.array_distinct(F.array(text, F.rtrim(text, F.lit("/")), closed))
        )

    return let(strip(url), spellings)


def content_id(source_id: Column, url: Column, title: Column, company: Column, location: Column) -> Column:
    """The id, or ``manual-`` and 16 hex digits of a digest where it is empty."""
    basis = F.when(url != "", url).otherwise(F.concat_ws("|", title, company, location))
    digest = F.concat(F.lit("manual-"), F.substring(F.sha2(basis, 256), 1, 16))
    return F.when(source_id != "", source_id).otherwise(digest)


def text_hash(text: Column) -> Column:
    """32-bit multiply-and-xor hash over UTF-16 units, as lower-case hex."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    value = F.aggregate(
        units,
        F.lit(5381).cast("bigint"),
        lambda h, unit: (h * 33)
        .bitwiseXOR(F.conv(unit, 16, 10).cast("bigint"))
        .bitwiseAND(F.lit(4294967295)),
    )
    return F.lower(F.hex(value))


def view_id(url: Column) -> Column:
    """Digits after ``/jobs/view/``; '' if there are none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"/jobs/view/(\d+)", 1)


def query_param(url: Column, name: str) -> Column:
    """Value of a query parameter, decoded; '' if absent. Works on relative urls too."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), rf"^[^#?]*\?(?:[^#]*&)?{name}=([^&#]*)", 1)
    return let(raw, lambda value: F.coalesce(F.try_url_decode(value), value))


def encode_component(text: Column) -> Column:
    """Percent-encoding as the browser does it for one component."""
    encoded = F.url_encode(text)
    for wrong, right in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(wrong), F.lit(right))
    return encoded


def resolve_url(href: Column, origin: Column) -> Column:
    """Absolute form of a link found on a page of ``origin``; '' for an unusable one.

    Covers absolute, scheme-relative, root-relative, query-only, fragment-only and
    plain relative links; scheme and host become lower case, an empty path becomes /.
    """
    scheme = F.regexp_extract(origin, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    web = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)(.*)$"

    def absolute(text: Column) -> Column:
        return (
            F.when(text == "", F.lit(""))
            .when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), text)
            .when(text.startswith("//"), F.concat(scheme, text))
            .when(text.startswith("/"), F.concat(origin, text))
            .otherwise(F.concat(origin, F.lit("/"), F.regexp_replace(text, r"^(?:\.{1,2}/)+", "")))
        )

    def shaped(full: Column) -> Column:
        head = F.lower(F.regexp_extract(full, web, 1))
        path = F.regexp_replace(F.regexp_extract(full, web, 2), "^(?!/)", "/")
        return (
            F.when(full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s<>\\^|/?#]+"), F.concat(head, path))
            .when(full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(?!//)."), full)
            .otherwise(F.lit(""))
        )

    return let(let(strip(href), absolute), shaped)


def view_url(href: Column, job_id: Column, origin: Column) -> Column:
    """Canonical posting url for sites that number postings in the path."""
    canonical = F.concat(F.lit("https://www.linkedin.com/jobs/view/"), job_id, F.lit("/"))
    return F.when(job_id != "", canonical).otherwise(resolve_url(href, origin))


def keyed_url(href: Column, job_key: Column, origin: Column) -> Column:
    """Canonical posting url for sites that name postings by the ``jk`` parameter."""
    key = F.when(job_key != "", job_key).otherwise(query_param(href, "jk"))

    def chosen(value: Column) -> Column:
        canonical = F.concat(origin, F.lit("/viewjob?jk="), encode_component(value))
        return F.when(value != "", canonical).otherwise(resolve_url(href, origin))

    return let(key, chosen)


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))
