import json
import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from postledger.sinks.files import write_landing
from postledger.sources import feeds, files, pages, payloads
from postledger.sources.registry import Source, load_source, load_sources, select_sources


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_cells_defaults_and_ids(spark, tmp_path):
    path = write(tmp_path / "jobs.csv", (
        "﻿source_id,title,company,location,url,description,remote,extra\r\n"
        '1,"Linux ""Pro""",Plain Co,"Bern, CH",http://a,"two\nlines",yes,x\r\n'
        ",,,,http://b,,onsite,\r\n"
        "\r\n"
        ",Third,,,,,perhaps,\r\n"
        "4,short\r\n"
    ))
    rows = {r.source_id: r for r in files.csv_postings(spark, "m", path).collect()}
    assert set(rows) == {"1", "http://b", f"{path}:3", "4"}
    one, two, four = rows["1"], rows["http://b"], rows["4"]
    assert (one.title, one.location, one.description, one.remote) == ('Linux "Pro"', "Bern, CH", "two\nlines", True)
    assert (two.title, two.company, two.location, two.description, two.remote) == ("Untitled", "Unknown", None, "", False)
    assert (four.title, four.url, four.posted_at, four.remote) == ("short", None, None, None)
    assert json.loads(one.raw)["extra"] == "x"
    assert [rows[k].pos for k in ("1", "http://b", f"{path}:3", "4")] == [1, 2, 3, 4]


def test_csv_exclusions_and_missing_file(spark, tmp_path):
    path = write(tmp_path / "j.csv", "source_id,title,company\n1,Linux Engineer,A\n2,Dev,Northern Staffing\n3,Dev,B\n,Dev,C\n")
    got = files.csv_postings(spark, "m", path, ["LINUX"], ["northern staffing"])
    # Row numbers count the rows that were dropped.
    assert {r.source_id for r in got.collect()} == {"3", f"{path}:4"}
    assert files.csv_postings(spark, "m", str(tmp_path / "none.csv")).count() == 0


def test_row_numbers_across_file_splits(spark, tmp_path):
    path = write(tmp_path / "big.csv", "title\n" + "".join(f"row {i}\n" for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = files.read_landing(spark, [path], multi_line=False)
        assert rows.select(F.sum((F.col("title") != F.concat(F.lit("row "), F.col("row_no"))).cast("int")), F.count("*")).first()[:] == (0, 3000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_several_files_keep_argument_order(spark, tmp_path):
    b = write(tmp_path / "b.csv", "title,source_id\nb1,1\nb2,2\n")
    a = write(tmp_path / "a.csv", "source_id,title,easy_apply\n3,a1,yes\n")
    rows = files.read_landing(spark, [b, str(tmp_path / "none"), a]).orderBy("pos").collect()
    assert [(r.source_id, r.title, r.easy_apply) for r in rows] == [("1", "b1", None), ("2", "b2", None), ("3", "a1", "yes")]


def test_landing_rewrite_keeps_order(spark, tmp_path):
    merged = spark.createDataFrame(
        [(1, i, f"n{i}", f't,"{i}"', None) for i in (5, 2)] + [(0, 9, "old", "x\ny", "")],
        "part int, pos bigint, source_id string, title string, url string",
    )
    for name in ("company", "location", "description", "posted_at", "remote"):
        merged = merged.withColumn(name, F.lit(""))
    path = str(tmp_path / "out")
    write_landing(merged, path)
    rows = files.read_landing(spark, [path]).collect()
    assert {(r.source_id, r.title) for r in rows} == {("old", "x\ny"), ("n2", 't,"2"'), ("n5", 't,"5"')}


def documents(spark, *bodies):
    return spark.createDataFrame([(f"d{i}", b) for i, b in enumerate(bodies)], "doc_key string, body string")


def test_json_payloads(spark):
    body = json.dumps({"jobs": [
        {"id": 7, "title": "T", "company_name": "C", "url": "u", "tags": ["b"], "description": "d"},
        {"url": "only-url", "title": "", "candidate_required_location": ""},
        {"id": None},
    ]})
    docs = documents(spark, body, "{broken", '{"other": 1}')
    rows = payloads.json_postings(docs, "api").orderBy("pos").collect()
    assert [r.source_id for r in rows] == ["7", "only-url", "None"]
    assert [r.location for r in rows] == ["Remote"] * 3 and rows[1].title == "Untitled" and all(r.remote for r in rows)
    assert json.loads(rows[0].raw) == {"id": 7, "title": "T", "company_name": "C", "url": "u", "tags": ["b"], "description": "d"}
    assert list(json.loads(rows[0].raw)) == sorted(json.loads(rows[0].raw))
    assert [r.doc_key for r in payloads.broken_documents(docs).collect()] == ["d1"]


def test_feeds(spark):
    rss = """<?xml version="1.0"?><rss xmlns:m="urn:m"><channel><title>feed</title>
    <item><m:title>other</m:title><title> One &amp; two </title><guid isPermaLink="false">g1</guid><link>http://a</link>
      <description><![CDATA[<p>x</item></p>]]></description><pubDate>Mon</pubDate></item>
    <item><title>   </title><link> http://b </link><author>Ann</author></item>
    <item><m:title>prefixed</m:title></item>
    </channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>
    <entry><title>E</title><link rel="x"/><link href=""/><link href="http://c"/><id>i1</id><summary>s</summary>
      <author><name>Bob</name></author><updated>2024</updated></entry></feed>"""
    rows = feeds.feed_postings(documents(spark, rss, atom), "f", "urn:feed", "Dflt").collect()
    got = {r.source_id: (r.title, r.company, r.url, r.description, r.posted_at) for r in rows}
    assert got == {
        "g1": ("One & two", "Dflt", "http://a", "<p>x</item></p>", "Mon"),
        "http://b": ("Untitled", "Ann", "http://b", "", None),
        "urn:feed#3": ("prefixed", "Dflt", None, "", None),
        "i1": ("E", "Dflt", "http://c", "s", "2024"),
    }
    assert json.loads(rows[0].raw) == {"feed_url": "urn:feed"}


def test_feed_items_at_any_depth(spark):
    deep = "<a><b><c><d><item><title>deep</title><x><title>not a child</title></x><guid>g</guid></item></d></c></b><entry><id>e</id></entry></a>"
    nested = "<r><item><guid>outer</guid><item><guid>inner</guid></item><title>after</title></item><m:item xmlns:m='u'><guid>no</guid></m:item></r>"
    mixed = "<item xmlns:p='u'><p:entry><p:id>p</p:id><id></id><link/><title>a<!-- c -->b<i>c</i>d</title></p:entry></item>"
    broken = ["<r><item></r>", "", None, "<r>&nbsp;<item/></r>", "plain"]
    items = feeds.feed_items(documents(spark, deep, nested, mixed, *broken))
    rows = feeds.item_postings(items, "f", "urn:feed").orderBy("pos").collect()
    # An empty bare child hides the prefixed one; text ends at the first element below.
    assert [(r.source_id, r.title) for r in rows] == [("g", "deep"), ("outer", "after"), ("inner", "Untitled"), ("urn:feed#4", "ab")]
    assert sorted(r.doc_key for r in feeds.broken_feeds(items).collect()) == ["d3", "d4", "d5", "d6", "d7"]


def test_feeds_against_a_tree(spark):
    """The same items and fields as by a search of the whole tree, on random documents."""
    rng = random.Random(5)
    tags = ["item", "entry", "n:entry", "n:item", "title", "n:title", "guid", "id", "link", "n:link", "summary", "author", "x"]

    def element(depth):
        tag = rng.choice(tags)
        href = f' href="{rng.choice(["", "h1", "h2"])}"' if tag.endswith("link") and rng.random() < 0.7 else ""
        inside = "".join(element(depth + 1) if rng.random() < 0.6 else rng.choice(["", " ", "t", "&lt;", "<![CDATA[ q ]]>"]) for _ in range(rng.randrange(6) if depth < 6 else 0))
        return f"<{tag}{href}>{inside}</{tag}>"

    bodies = [f'<root xmlns:n="urn:n">{"".join(element(1) for _ in range(4))}</root>' for _ in range(300)]

    def child(item, name):
        plain = item.find(name)
        return plain if plain is not None else item.find("{*}" + name)

    def text(item, names):
        found = [child(item, n) for n in names]
        return next((c.text for c in found if c is not None and c.text), None)

    want = []
    for i, body in enumerate(bodies):
        root = ElementTree.fromstring(body)
        for item in root.findall(".//item") or root.findall(".//{*}entry"):
            href = next((c.get("href") for c in item.findall("{*}link") if c.get("href")), None)
            want.append((f"d{i}", *[text(item, names) for names in feeds.FEED_FIELDS.values()], href))
    got = feeds.feed_items(documents(spark, *bodies)).orderBy("_block", "_m").select("_file", *feeds.FEED_FIELDS, "href").collect()
    assert [tuple(r) for r in got] == want and len(want) > 500


def test_feed_encoding_and_landed_files(spark, tmp_path):
    write(tmp_path / "a.xml", '<?xml version="1.0" encoding="iso-8859-1"?><r><item><title>caf\xe9</title></item></r>', "iso-8859-1")
    write(tmp_path / "b.xml", "\ufeff<r><item><title>\u00fc</title></item></r>")
    rows = load_source(spark, Source("f", "rss", options={"path": str(tmp_path), "url": "u"})).orderBy("pos").collect()
    assert [(r.source_id, r.title) for r in rows] == [("u#1", "caf\xe9"), ("u#2", "\u00fc")]
    write(tmp_path / "c.xml", "<r>")
    with pytest.raises(ValueError, match="c.xml"):
        load_source(spark, Source("f", "rss", options={"path": str(tmp_path)}))


def test_tabs(spark):
    good = json.dumps({"url": "u", "title": "t", "blocked": True, "rows": [{"source_id": "1", "title": "a"}, {"source_id": "2"}]})
    stream = f"{good}<<T>>  <<T>>not json<<T>>" + json.dumps({"error": True, "message": "m", "url": "v"}) + "<<T>>" + json.dumps({"url": "w"})
    tabs = payloads.parse_tabs(payloads.split_tabs(spark.createDataFrame([(1, stream)], "w int, o string"), "o", "<<T>>"))
    assert payloads.tab_summary(tabs).first()[:] == (4, 2, 1, 2)
    assert {(r.tab, r.message) for r in tabs.where("failed").collect()} == {(2, "not json"), (3, "m")}
    assert [(r.tab, r.at, r.source_id) for r in payloads.tab_rows(tabs).orderBy("at").collect()] == [(0, 0, "1"), (0, 1, "2")]


PAGE = """<html><head><title> Jobs </title></head><body>
<ul><li class="jobs-search-results__list-item"><div class="x job-card-container" data-job-id="11">
  <a class="job-card-list__title--link" href="/jobs/view/11/?q"><b>Data</b>&nbsp;Eng</a>
  <div class="artdeco-entity-lockup__subtitle">Acme</div>
  <div class="artdeco-entity-lockup__caption">Bern (Remote)</div><p>Easy Apply</p></div></li></ul>
<div class="job-card-container"><a href="https://x.com/jobs/other">Plain title</a><br><p>Line Co</p><p>Basel</p></div>
<div class="job-card-container"><p>no link</p><p>Co</p></div>
</body></html>"""


def test_page_cards(spark):
    saved = spark.createDataFrame([(1, "https://www.site.com/search?x", PAGE), (2, "https://www.site.com", None)], "page_id int, url string, html string")
    rows = {r.source_id: r for r in pages.page_records(saved, "linkedin").collect()}
    one = rows["linkedin-11"]
    # The list item and the container inside it are one posting.
    assert (one.at, one.title, one.company, one.location) == (0, "Data Eng", "Acme", "Bern (Remote)")
    assert (one.url, one.remote, one.easy_apply, one.posted_at) == ("https://www.linkedin.com/jobs/view/11/", "true", "true", "last-24h")
    # A link without /jobs/view/ is not taken, so the card has no url and is dropped.
    assert set(rows) == {"linkedin-11"}
    page = PAGE.replace("https://x.com/jobs/other", "/jobs/view/x?y").replace("data-job-id", "data-other")
    saved = spark.createDataFrame([(1, "https://www.site.com/search", page)], "page_id int, url string, html string")
    rows = {r.title: r for r in pages.page_records(saved, "linkedin").collect()}
    assert rows["Plain title"].company == "Line Co" and rows["Plain title"].url == "https://www.site.com/jobs/view/x?y"
    assert rows["Data Eng"].source_id == "linkedin-11"


def test_registry(spark, tmp_path):
    path = write(tmp_path / "a.csv", "source_id,title\n1,a\n")
    body = write(tmp_path / "b.json", '{"jobs": [{"id": 5}]}')
    feed = write(tmp_path / "c.xml", "<rss><channel><item><title>x</title></item></channel></rss>")
    sources = [
        Source("a", "csv", options={"path": path}),
        Source("b", "remotive", enabled=False, options={"path": body}),
        Source("c", "rss", options={"path": feed, "url": "urn:c"}),
    ]
    assert [s.name for s in select_sources(sources)] == ["a", "c"]
    assert [s.name for s in select_sources(sources, ["b"])] == ["b"]
    with pytest.raises(ValueError):
        select_sources(sources, ["zzz"])
    with pytest.raises(ValueError):
        load_source(spark, Source("x", "soap"))
    assert {(r.source, r.source_id) for r in load_sources(spark, sources).collect()} == {("a", "1"), ("b", "5"), ("c", "urn:c#1")}


def test_profile_files_are_whole(spark, tmp_path):
    path = write(tmp_path / "cv.txt", "line one\nline two\n")
    assert files.read_profile_texts(spark, [path]).first().cv_text == "line one\nline two\n"
