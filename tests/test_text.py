"""Scalar functions against plain Python over tricky values."""

import pandas as pd
from pyspark.sql import functions as F

from postledger.functions import flags, links, text

CODES = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]


def values(spark, items, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_match_key_agrees_with_case_folding(spark):
    changed = [(chr(c), chr(c).casefold()) for c in CODES if chr(c) != chr(c).casefold()]
    rows = spark.createDataFrame(pd.DataFrame(changed, columns=["s", "f"]))
    key = lambda c: text.match_key(F.concat(F.lit("x"), c, F.lit("y")))
    assert rows.where(key(F.col("s")) != key(F.col("f"))).count() == 0


def test_match_key_keeps_dotless_i_apart(spark):
    a, b, c, d = values(spark, ["ı", "i", "Straße", "STRASSE "], text.match_key)
    assert a != b and c == d == "STRASSE"


def test_squeeze_covers_all_white_space(spark):
    rows = spark.createDataFrame(pd.DataFrame({"s": [f"a{chr(c)}b" for c in CODES]}))
    found = {r.s[1] for r in rows.where(text.squeeze(F.col("s")) == "a b").collect()}
    assert found == {chr(c) for c in CODES if chr(c).isspace()}


def test_strip_and_defaults(spark):
    samples = ["", None, "  a \x1f", "\n"]
    assert values(spark, samples, text.strip) == [(s or "").strip() for s in samples]
    assert values(spark, ["", None, " "], lambda c: text.or_default(c, "d")) == ["d", "d", " "]
    assert values(spark, ["  ", None, " A  b "], text.display_company) == ["Unknown", "Unknown", "A b"]


def test_parse_flag(spark):
    samples = [" YES ", "remote", "1", "No", "onsite", "0", "maybe", "", None, "t"]
    assert values(spark, samples, text.parse_flag) == [True] * 3 + [False] * 3 + [None] * 4


def test_nocase_folds_ascii_only(spark):
    assert values(spark, ["ÄbC"], text.nocase) == ["Äbc"]


def test_truncate(spark):
    samples = ["x" * 70, "y" * 71]
    assert values(spark, samples, text.truncate) == ["x" * 70, "y" * 67 + "..."]


def test_status_view(spark):
    samples = [" Applied", "DISCARDED ", "", None, "interview"]
    assert values(spark, samples, text.status_view) == ["applied", "discarded", "open", "open", "open"]


def test_sorted_json_keeps_nulls(spark):
    row = spark.range(1).select(
        text.sorted_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit(None).cast("string"))).alias("j")
    ).first()
    assert row.j == '{"a":null,"b":"1"}'


def test_text_hash_matches_utf16_arithmetic(spark):
    def expected(s):
        data, h = s.encode("utf-16-be"), 5381
        for i in range(0, len(data), 2):
            h = ((h * 33) ^ int.from_bytes(data[i:i + 2], "big")) & 0xFFFFFFFF
        return f"{h:x}"

    samples = ["", "a", "Größe|x|https://a", "emoji 😀 end", "x" * 500]
    assert values(spark, samples, links.text_hash) == [expected(s) for s in samples]


def test_url_forms(spark):
    assert values(spark, [" http://a/ ", "http://a//", "", None, "/"], links.url_key) == ["http://a", "http://a", None, None, ""]
    variants = values(spark, ["u", "u/", "u//", " "], links.url_variants)
    assert [set(v) for v in variants] == [{"u", "u/"}, {"u/", "u"}, {"u//", "u"}, set()]


def test_resolve_url(spark):
    cases = {
        "https://A.com": "https://a.com/",
        "HTTP://A.com/X?q=1": "http://a.com/X?q=1",
        "//b.org/x": "https://b.org/x",
        "/p?q": "https://o.net/p?q",
        "?q=1": "https://o.net/?q=1",
        "#f": "https://o.net/#f",
        "../a/b": "https://o.net/a/b",
        "mailto:x@y": "mailto:x@y",
        "http://": "",
        "": "",
    }
    got = values(spark, list(cases), lambda c: links.resolve_url(c, F.lit("https://o.net")))
    assert got == list(cases.values())


def test_posting_urls(spark):
    origin = F.lit("https://ch.example.com")
    assert values(spark, ["/x?a=1&jk=a%20b#z", "/x?ajk=1", ""], lambda c: links.keyed_url(c, F.lit(""), origin)) == [
        "https://ch.example.com/viewjob?jk=a%20b", "https://ch.example.com/x?ajk=1", "",
    ]
    assert values(spark, ["/jobs/view/77?x"], lambda c: links.view_url(c, links.view_id(c), origin)) == [
        "https://www.linkedin.com/jobs/view/77/"
    ]


def test_site_columns(spark):
    rows = spark.createDataFrame(
        [
            ("indeed", "http://x.LINKEDIN.com/1", "a"),
            ("job-ch", None, "indeed-1"),
            ("INDEED", None, "b"),
            ("web", None, "LinkedIn-5"),
            ("web", "http://de.indeed.com", "z"),
        ],
        "source string, url string, source_id string",
    )
    s, u, i = F.col("source"), F.col("url"), F.col("source_id")
    got = rows.select(
        links.site_label(s, u, i), links.site_link(links.LINKEDIN, s, u, i), links.site_link(links.INDEED, s, u, i)
    ).collect()
    assert [tuple(r) for r in got] == [
        ("Indeed", "http://x.LINKEDIN.com/1", "http://x.LINKEDIN.com/1"),
        ("job.ch", "", None),
        ("INDEED", "", ""),
        ("LinkedIn", None, ""),
        ("Indeed", "", "http://de.indeed.com"),
    ]


def test_flags(spark):
    words = flags.REMOTE_WORDS["indeed"]
    assert values(spark, ["Fully REMOTE!", "remotely", "my Home Office", None], lambda c: flags.remote_text(words, c)) == ["true", "", "true", ""]
    assert values(spark, ["Easy \n Apply", "uneasy apply", None], lambda c: flags.easy_apply(F.lit(None).cast("string"), c)) == [True, False, False]
    page = "<html><head><title>captcha</title></head><body><script>captcha</script><p>Verify you\n<b>are human</b></p></body>"
    assert values(spark, [page], lambda c: flags.blocked(flags.visible_text(c), flags.HUMAN_CHECK_PHRASES)) == [True]
    assert values(spark, [page], lambda c: flags.blocked(flags.visible_text(c), ["captcha"])) == [False]
