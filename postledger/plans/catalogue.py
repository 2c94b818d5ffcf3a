"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from postledger.functions import flags, links, text
from postledger.functions.tokens import tokens
from postledger.operators import applications as apps
from postledger.operators import checks, dedup, exclusion, ledger, matching, merge, reports, scans
from postledger.plans import fixtures as fx
from postledger.plans.scan import ScanSettings, run_scan
from postledger.shared import cut, new_path
from postledger.sinks.files import export_jobs, write_landing
from postledger.sources import feeds, files, pages, payloads, state
from postledger.sources.registry import Source
from postledger.streaming import incremental, scans as streamed

Query = Callable[[SparkSession, str], DataFrame]

# Exclusion lists used by the catalogue.
COMPANY_FRAGMENTS = ["supplier#00000001", "  SUPPLIER#000000003 ", "", "ß"]
MATCH_SCORE = 25.0
MATCH_SCORE_REQUIRED = 40.0
TITLE_WORDS = ["rod", "Red ", " intern ", ""]
MERGE_TITLES = ["Intern", "tion en", "ß"]
MERGE_COMPANIES = ["#000000002", "supplier#00000005"]
DEMO_SITES = (
    links.Site("Blog", None, "%//BLOG.%", "blog-%"),
    links.Site("Mobile", "mobile", "%//m.%", "M-%"),
)


def _iso(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, text.iso_millis(F.col(name)))
    return df


def _joined(name: str):
    return F.array_join(name, ",").alias(name)


# --- matching -----------------------------------------------------------------


def score_postings(spark, sf):
    profile = matching.build_profiles(fx.first_cv(spark, sf))
    scored = matching.score_postings(fx.postings(spark, sf), profile)
    return scored.select("source_id", "match_score", _joined("matched_keywords"), _joined("missing_keywords"))


def score_postings_required(spark, sf):
    required = F.array(*[F.lit(word) for word in fx.REQUIRED])
    profile = matching.build_profiles(fx.first_cv(spark, sf).withColumn("required", required))
    scored = matching.score_postings(fx.postings(spark, sf), profile)
    return scored.select("source_id", "match_score", _joined("matched_keywords"), _joined("missing_keywords"))


def top_matches(spark, sf):
    """The flagship: exclude, profile, score, keep the best matches."""
    kept = exclusion.exclude_companies(fx.postings(spark, sf), COMPANY_FRAGMENTS)
    profile = matching.build_profiles(fx.first_cv(spark, sf))
    scored = matching.score_postings(kept, profile)
    best = scored.orderBy(F.desc("match_score"), "source_id").limit(reports.RANKED_LIMIT)
    return best.select("source_id", "source", "company", "match_score", _joined("matched_keywords"))


def profile_keywords(spark, sf):
    profiles = matching.build_profiles(fx.cv_texts(spark, sf))
    return profiles.select("profile_id", _joined("keywords"), _joined("required_keywords"))


def score_many_profiles(spark, sf):
    profiles = matching.build_profiles(fx.dialogue_texts(spark, sf), part="turn")
    return matching.score_many_profiles(fx.postings(spark, sf), profiles)


def score_many_profiles_by_shuffle(spark, sf):
    profiles = matching.build_profiles(fx.cv_texts(spark, sf))
    return matching.score_many_profiles(fx.postings(spark, sf), profiles, small_rows=0)


def match_profiles(spark, sf):
    profiles = matching.build_profiles(fx.dialogue_texts(spark, sf), part="turn")
    return matching.match_profiles(fx.postings(spark, sf), profiles, MATCH_SCORE)


def match_profiles_required(spark, sf):
    profiles = matching.build_profiles(fx.cv_texts(spark, sf))
    return matching.match_profiles(fx.postings(spark, sf), profiles, MATCH_SCORE_REQUIRED, small_rows=0)


def best_matches(spark, sf):
    profiles = matching.build_profiles(fx.dialogue_texts(spark, sf), part="turn")
    return matching.best_matches(fx.postings(spark, sf), profiles, (F.col("profile_id") % 4).cast("int"))


def token_frequency(spark, sf):
    exploded = fx.table(spark, sf, "documents").select("lang", F.explode(tokens(F.col("text"))).alias("token"))
    return exploded.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))


# --- exclusion and merging ------------------------------------------------------


def exclude_companies(spark, sf):
    kept = exclusion.exclude_companies(fx.postings(spark, sf), COMPANY_FRAGMENTS)
    return kept.select("source_id", "company")


def _fragments(spark, sf):
    name = F.col("s_name")
    return fx.table(spark, sf, "supplier").where("s_acctbal < 2000").select(
        F.upper(F.substring(name, 9, 30)).alias("fragment")
    )


def exclude_companies_table(spark, sf):
    kept = exclusion.exclude_companies_by_table(fx.postings(spark, sf), _fragments(spark, sf))
    return kept.select("source_id", "company")


def exclude_companies_long_table(spark, sf):
    kept = exclusion.exclude_companies_by_table(fx.postings(spark, sf), _fragments(spark, sf))
    return kept.select("source_id", "company")


def exclude_titles(spark, sf):
    title = F.col("p_name")
    return fx.table(spark, sf, "part").select(
        "p_partkey",
        exclusion.title_excluded(title, TITLE_WORDS).alias("plain"),
        exclusion.title_excluded_by_word(title, TITLE_WORDS).alias("by_word"),
    )


def _merge(spark, sf, easy=False, **kwargs):
    rules = merge.MergeRules(MERGE_COMPANIES, MERGE_TITLES, easy_apply_only=easy, **kwargs)
    return merge.merge_rows(fx.landed(spark, sf), fx.stored_landing(spark, sf), fx.stored_keys(spark, sf), rules)


def merge_decisions(spark, sf):
    return _merge(spark, sf).decisions.select("pos", "source_id", "url", "decision")


def merge_decisions_easy_apply(spark, sf):
    return _merge(spark, sf, easy=True).decisions.select("pos", "source_id", "url", "decision")


def merge_counts(spark, sf):
    return _merge(spark, sf).counts


def landing_rewrite(spark, sf):
    path = new_path(spark, "landing")
    write_landing(_merge(spark, sf).merged, path)
    return files.read_landing(spark, [path]).select("source_id", "title", "company", "url")


def dedup_two_keys(spark, sf):
    rows = fx.landed(spark, sf).where("source_id <> ''")
    return dedup.dedup_two_keys(rows).select("pos", "source_id", "url")


def import_exact_url(spark, sf):
    rules = merge.MergeRules(MERGE_COMPANIES, require_id=False, exact_url=True)
    merged = merge.merge_rows(fx.landed(spark, sf), fx.stored_landing(spark, sf), None, rules)
    return merged.decisions.select("pos", "source_id", "url", "decision")


def first_by_id(spark, sf):
    rows = fx.landed(spark, sf).where("source_id <> ''")
    return dedup.first_by_key(rows, ["source_id"]).select("source_id", "pos", "url")


def last_by_id(spark, sf):
    rows = fx.landed(spark, sf).where("source_id <> ''")
    return dedup.last_by_key(rows, ["source_id"]).select("source_id", "pos", "first_pos", "url")


# --- scalar functions -----------------------------------------------------------


def site_labels(spark, sf):
    page = F.col("page_id")
    source = F.when(page % 10 == 0, "indeed").when(page % 10 == 1, "job-ch").when(page % 10 == 2, "mobile").otherwise("web")
    ident = F.concat(F.when(page % 7 == 0, "BLOG-").when(page % 7 == 1, "m-").otherwise("x-"), page.cast("string"))
    url = F.when(page % 11 != 0, F.col("url"))
    return fx.table(spark, sf, "pages").select(
        "page_id",
        links.site_label(source, url, ident, DEMO_SITES).alias("website"),
        links.site_link(DEMO_SITES[0], source, url, ident).alias("blog"),
        links.site_link(DEMO_SITES[1], source, url, ident).alias("mobile"),
    )


def normalize_defaults(spark, sf):
    c = F.col
    return fx.postings(spark, sf).select(
        "source_id",
        text.or_default(c("title"), "Untitled").alias("title"),
        text.display_company(F.concat(F.lit("  "), c("company"), F.lit(" \t x"))).alias("company"),
        text.match_key(c("title")).alias("title_key"),
        text.parse_flag(c("remote")).alias("remote"),
        F.md5(text.clean(c("description"))).alias("clean_digest"),
        F.md5(text.strip(c("description"))).alias("strip_digest"),
        text.truncate(c("description"), 70).alias("short"),
        text.normal_status(F.concat(c("remote"), F.lit(" "))).alias("status"),
        text.nocase(c("title")).alias("title_order"),
    )


def text_flags(spark, sf):
    body = F.col("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        flags.remote_text(["la", "the and"], body).alias("remote"),
        flags.easy_apply(F.col("lang"), F.concat(F.lit("easy  apply"), body)).alias("easy_start"),
        flags.easy_apply(F.lit(" YES "), body).alias("easy_flag"),
    )


def url_keys(spark, sf):
    url = F.col("url")
    origin = links.origin_of(url)
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+(/.*)$", 1)
    number = F.concat(origin, F.lit("/jobs/view/"), F.col("page_id").cast("string"), F.lit("/?x=1"))
    keyed = F.concat(path, F.when(path.contains("?"), "&").otherwise("?"), F.lit("jk=a%20b"), F.col("page_id").cast("string"))
    return fx.table(spark, sf, "pages").select(
        "page_id",
        links.url_key(url).alias("url_key"),
        F.array_join(F.array_sort(links.url_variants(url)), " ").alias("variants"),
        links.query_param(url, "page").alias("page_param"),
        links.view_id(number).alias("view_id"),
        links.view_url(path, links.view_id(number), origin).alias("view_url"),
        links.view_url(path, F.lit(""), origin).alias("resolved"),
        links.keyed_url(F.when(~path.contains("#"), keyed).otherwise(path), F.lit(""), origin).alias("keyed_url"),
    )


def hash_ids(spark, sf):
    c = F.col
    rows = fx.postings(spark, sf)
    title = F.coalesce(c("title"), F.lit(""))
    company = F.coalesce(c("company"), F.lit(""))
    url = F.when(c("pos") % 5 == 0, "").otherwise(c("url"))
    given = F.when(c("pos") % 4 == 0, c("source_id")).otherwise("")
    return rows.select(
        "source_id",
        links.content_id(given, url, title, company, c("location")).alias("content_id"),
        links.text_hash(F.concat_ws("|", title, company, url)).alias("text_hash"),
    )


# --- ledger -----------------------------------------------------------------------


def upsert_ledger(spark, sf):
    folded = ledger.fold_sightings(fx.sightings(spark, sf))
    return _iso(folded, "first_seen_at", "last_seen_at").drop("company", "url")


def upsert_two_batches(spark, sf):
    seen = fx.sightings(spark, sf)
    late = F.dayofmonth("seen_at") > 15
    # The later half comes first: the result does not depend on the order.
    old = ledger.fold_sightings(seen.where(late)).withColumn("status", F.lit("applied"))
    state_now = ledger.upsert_folds(old, ledger.fold_sightings(seen.where(~late)))
    return _iso(state_now, "first_seen_at", "last_seen_at").drop("company", "url")


def ledger_tables(spark, sf):
    seen = fx.full_sightings(spark, sf)
    late = F.dayofmonth("seen_at") > 15
    one = ledger.upsert_postings(
        state.empty_table(spark, "jobs"), state.empty_table(spark, "companies"), seen.where(~late)
    )
    two = ledger.upsert_postings(cut(one.jobs, "jobs"), cut(one.companies, "companies"), seen.where(late))
    jobs = reports.with_company(two.jobs, two.companies)
    return _iso(jobs, "first_seen_at", "last_seen_at").select(
        "id", "source", "source_id", "company_id", "company", "title", "first_seen_at", "last_seen_at", "seen_count", "status", "match_score"
    )


def company_dimension(spark, sf):
    batch = fx.postings(spark, sf).withColumn("seen_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    known = state.empty_table(spark, "companies")
    grown = ledger.grow_companies(known, batch.where("location = 'en'"))
    grown = ledger.grow_companies(cut(grown, "companies"), batch)
    return grown.select("id", "name")


def sighting_counts(spark, sf):
    seen = fx.sightings(spark, sf)
    late = F.dayofmonth("seen_at") > 15
    return ledger.sighting_counts(seen.where(late), ledger.fold_sightings(seen.where(~late)))


def scan_log(spark, sf):
    seen = fx.sightings(spark, sf).withColumn("scan_day", F.to_date("seen_at"))
    log = scans.scan_log(seen, ["source", "scan_day"], fx.scan_days(spark, sf))
    return _iso(log, "started_at", "finished_at").withColumn("scan_day", F.col("scan_day").cast("string"))


def scan_failures(spark, sf):
    rows = fx.scan_days(spark, sf)
    return rows.groupBy("source").agg(F.bool_or(F.col("error").isNotNull()).alias("failed")).unionByName(
        scans.any_error(rows).select(F.lit("any").alias("source"), "failed")
    )


def _ledger(spark, sf):
    """Jobs and companies as one fold, numbered by event and by user group."""
    return fx.folded_jobs(spark, sf), fx.folded_companies(spark, sf)


def new_in_latest_scan(spark, sf):
    jobs, companies = _ledger(spark, sf)
    rows = reports.new_jobs(jobs, companies, fx.scan_days(spark, sf), limit=reports.EXPORT_LIMIT)
    return _iso(rows, "first_seen_at")


def new_in_latest_scan_of_source(spark, sf):
    jobs, companies = _ledger(spark, sf)
    rows = reports.new_jobs(jobs, companies, fx.scan_days(spark, sf), source="purchase")
    return _iso(rows, "first_seen_at")


def ranked_jobs(spark, sf):
    jobs, companies = _ledger(spark, sf)
    return _iso(reports.ranked_jobs(jobs, companies, fx.scan_days(spark, sf)), "first_seen_at", "last_seen_at")


def ranked_jobs_filtered(spark, sf):
    jobs, companies = _ledger(spark, sf)
    rows = reports.ranked_jobs(
        jobs, companies, fx.scan_days(spark, sf),
        min_score=20, scored_only=True, status="new", source="click", limit=reports.EXPORT_LIMIT,
    )
    return _iso(rows, "first_seen_at", "last_seen_at")


def report_flags(spark, sf):
    jobs, companies = _ledger(spark, sf)
    jobs = jobs.withColumn("status", F.when(F.col("match_score") > 40, "Applied").otherwise("new"))
    log = fx.scan_days(spark, sf)
    listed = reports.ranked_jobs(jobs, companies, log, limit=reports.EXPORT_LIMIT)
    fresh = reports.new_jobs(jobs, companies, log, limit=reports.EXPORT_LIMIT)
    return reports.report_rows(listed, fresh)


def export_csv(spark, sf):
    jobs, companies = _ledger(spark, sf)
    listed = reports.ranked_jobs(jobs, companies, fx.scan_days(spark, sf), limit=reports.EXPORT_LIMIT)
    path = new_path(spark, "export")
    export_jobs(listed, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(*[F.coalesce(F.col(f"`{title}`"), F.lit("")).alias(name) for name, title in reports.EXPORT_COLUMNS.items()])


# --- applications -------------------------------------------------------------------


def _replayed(spark, sf):
    return apps.apply_actions(
        fx.tracked_jobs(spark, sf), fx.open_applications(spark, sf), fx.actions(spark, sf)
    )


def application_state(spark, sf):
    return _iso(_replayed(spark, sf).applications, "applied_at", "created_at", "updated_at")


def job_status(spark, sf):
    return _replayed(spark, sf).jobs.select("id", "status")


def unknown_jobs(spark, sf):
    return _replayed(spark, sf).rejects.select("job_id", "pos")


def applications_report(spark, sf):
    done = _replayed(spark, sf)
    return _iso(reports.applications_report(done.applications, fx.nations(spark, sf)), "applied_at", "updated_at")


def status_view_counts(spark, sf):
    return reports.view_counts(_replayed(spark, sf).jobs)


def discarded_view(spark, sf):
    return reports.in_view(_replayed(spark, sf).jobs, "discarded").select("id", "title", "is_new")


def status_validation(spark, sf):
    good, bad = apps.split_statuses(
        fx.actions(spark, sf).withColumn("status", F.concat(F.lit(" "), F.upper("status")))
    )
    return good.select("pos", "status", F.lit(True).alias("valid")).unionByName(
        bad.select("pos", "status", F.lit(False).alias("valid"))
    )


def constraint_violations(spark, sf):
    jobs = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("source"),
        F.col("user_id").cast("string").alias("source_id"),
        F.col("user_id").alias("company_id"),
        F.when(F.col("value") > 1, F.col("props")).alias("title"),
        F.col("ts").alias("first_seen_at"),
        F.col("ts").alias("last_seen_at"),
        F.lit(1).alias("seen_count"),
        F.lit("new").alias("status"),
    )
    companies = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    applications = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("job_id"), F.col("o_custkey").alias("company_id")
    )
    return checks.ledger_violations(jobs, companies, applications)


# --- sources -------------------------------------------------------------------------


def _posting_columns(df: DataFrame, *more) -> DataFrame:
    digest = F.md5("description").alias("description_digest")
    return df.select(
        "source", "source_id", "title", "company", "location", "url", digest, "posted_at", "remote", *more
    )


def csv_source(spark, sf):
    rows = fx.postings(spark, sf)
    path = new_path(spark, "csv")
    landed = rows.select(
        F.when(F.col("pos") % 3 != 0, F.col("source_id")).alias("source_id"),
        "title", "company", "location",
        F.concat("url", F.lit("#"), F.col("pos").cast("string")).alias("url"),
        "description", F.lit("2024-01-01").alias("posted_at"), "remote",
    )
    landed.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)
    read = files.csv_postings(spark, "manual", path, TITLE_WORDS, COMPANY_FRAGMENTS)
    return _posting_columns(read)


def json_source(spark, sf):
    rows = fx.postings(spark, sf)
    item = F.to_json(F.struct(
        F.when(F.col("pos") % 3 != 0, F.col("pos")).alias("id"),
        F.concat("url", F.lit("#"), F.col("pos").cast("string")).alias("url"),
        "title",
        F.col("company").alias("company_name"),
        F.when(F.col("location") != "fr", F.col("location")).alias("candidate_required_location"),
        "description",
        F.lit("2024-01-01").alias("publication_date"),
        F.array(F.lit("b"), F.lit("a")).alias("tags"),
    ))
    path = new_path(spark, "json")
    rows.select(F.concat(F.lit('{"count": 1, "jobs": ['), item, F.lit("]}")).alias("value")).write.text(path)
    documents = payloads.read_documents(spark, [path], per_line=True)
    read = payloads.json_postings(documents, "api")
    tag = F.get_json_object("raw", "$.tags[0]")
    return _posting_columns(read, tag.alias("raw_tag"))


def feed_source(spark, sf):
    cell = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name.split(' ')[0]}>"))
    safe = lambda c: F.regexp_replace(fx._escaped(F.coalesce(c, F.lit(""))), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "")
    title = cell("title", safe(F.col("title")))
    guid = F.when(F.col("pos") % 3 == 0, cell('guid isPermaLink="false"', F.col("source_id"))).otherwise("")
    link = F.col("url")
    rss = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:dc="urn:dc"><channel><title>t</title><item>'),
        title, guid, cell("link", safe(link)), cell("description", F.concat(F.lit("<![CDATA["), F.col("location"), F.lit("]]>"))),
        cell("dc:author", F.lit("ignored?")), cell("company", safe(F.col("company"))), F.lit("</item></channel></rss>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry>'),
        title, F.lit('<link rel="x"/><link href="'), safe(link), F.lit('"/>'),
        cell("id", F.col("source_id")), F.lit("<summary> s </summary><author><name>n</name></author>"),
        cell("updated", F.lit("2024-01-01")), F.lit("</entry></feed>"),
    )
    rows = fx.postings(spark, sf).select(F.when(F.col("location") == "en", atom).otherwise(rss).alias("value"))
    path = new_path(spark, "feed")
    rows.write.text(path)
    documents = payloads.read_documents(spark, [path], per_line=True)
    return _posting_columns(feeds.feed_postings(documents, "feed", "urn:feed", "Nobody")).drop("location", "remote")


def deep_feeds(spark, sf):
    """Archives in which items stand at several depths, beside entries and inside items of other spaces."""
    safe = lambda c: F.regexp_replace(fx._escaped(F.coalesce(c, F.lit(""))), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "")
    item = F.concat(
        F.lit("<item><m:box><title>inner</title></m:box><m:title>"), safe(F.col("title")), F.lit("</m:title><id>"),
        F.col("source_id"), F.lit('</id><link/><m:link href="'), safe(F.col("url")), F.lit('"/></item>'),
    )
    deep = F.concat(F.lit("<x><y><m:z>"), item, F.lit("</m:z></y></x><entry><id>e</id></entry>"))
    outer = F.concat(F.lit("<m:item>"), item, F.lit("<item><guid> second </guid></item></m:item>"))
    entry = F.concat(F.lit("<a><m:entry><guid>"), F.col("source_id"), F.lit("</guid></m:entry></a>"))
    body = F.when(F.col("pos") % 3 == 0, deep).when(F.col("pos") % 3 == 1, outer).otherwise(entry)
    rows = fx.postings(spark, sf).select(F.concat(F.lit('<root xmlns:m="urn:m">'), body, F.lit("</root>")).alias("value"))
    path = new_path(spark, "deep")
    rows.write.text(path)
    documents = payloads.read_documents(spark, [path], per_line=True)
    return feeds.feed_postings(documents, "deep", "urn:deep").select("source_id", "title", "company", "url")


def _tabs(spark, sf):
    card = F.struct(
        "source_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("company", F.lit("")).alias("company"), "url",
    )
    payload = F.to_json(F.struct(
        "url", F.lit("Jobs").alias("title"), (F.col("location") == "fr").alias("blocked"), F.array(card, card).alias("rows"),
    ))
    broken = F.concat(F.lit("oops "), F.col("source_id"))
    failed = F.concat(F.lit('{"error": true, "message": "'), F.col("source_id"), F.lit('"}'))
    stream = F.concat_ws("\n---TAB---\n", payload, F.lit(" "), F.when(F.col("location") == "es", broken).otherwise(failed))
    streams = fx.postings(spark, sf).select(F.col("pos").alias("window"), stream.alias("output"))
    return payloads.parse_tabs(payloads.split_tabs(streams, "output", "---TAB---"))


def tab_results(spark, sf):
    return payloads.tab_rows(_tabs(spark, sf)).select("window", "tab", "at", "source_id", "title", "url")


def tab_errors(spark, sf):
    return _tabs(spark, sf).where("failed").select("window", "tab", "message")


def tab_summary(spark, sf):
    return payloads.tab_summary(_tabs(spark, sf))


def _records(site):
    def query(spark, sf):
        return pages.page_records(fx.result_pages(spark, sf, site), site)

    return query


def _page_summary(site):
    def query(spark, sf):
        saved = fx.result_pages(spark, sf, site)
        return pages.page_summary(pages.page_records(saved, site), pages.page_flags(saved, site))

    return query


def page_flags(spark, sf):
    found = pages.page_flags(fx.table(spark, sf, "pages"), "indeed")
    digest = fx.table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("page_key"), F.md5(flags.visible_text(F.col("html"))).alias("text_digest")
    )
    return found.join(digest, "page_key")


def cv_files(spark, sf):
    path = new_path(spark, "cv")
    fx.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("item"), "text").repartition("item").write.partitionBy("item").text(path)
    read = files.read_profile_texts(spark, [f"{path}/*/*.txt"])
    item = F.regexp_extract("profile_id", r"item=(\d+)", 1).cast("bigint")
    # The text sink ends every file with a line break.
    return read.select(item.alias("item_id"), F.md5(F.regexp_replace("cv_text", r"\n\z", "")).alias("digest"))


def older_snapshot(spark, sf):
    root = new_path(spark, "state")
    jobs, _ = _ledger(spark, sf)
    jobs.drop("seen_count", "last_pos").write.parquet(state.table_path(root, 1, "jobs"))
    return state.read_table(spark, root, 1, "jobs").select("source", "source_id", "seen_count", "last_pos")


# --- whole scans and streams ------------------------------------------------------------


def _scan_sources(spark, sf):
    rows = fx.postings(spark, sf)
    csv_path, json_path = new_path(spark, "scan-csv"), new_path(spark, "scan-json")
    csv_rows = rows.select("source_id", "title", "company", "location", "url", "description", "remote")
    csv_rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("compression", "gzip").csv(csv_path)
    item = F.to_json(F.struct(F.col("source_id").alias("id"), "title", F.col("company").alias("company_name"), "url"))
    rows.select(F.concat(F.lit('{"jobs":['), item, F.lit(","), item, F.lit("]}")).alias("value")).write.text(json_path)
    return [
        Source("manual", "csv", options={"path": csv_path, "exclude_title_keywords": MERGE_TITLES}),
        Source("api", "remotive", options={"path": json_path, "per_line": True}),
        Source("off", "csv", enabled=False, options={"path": csv_path}),
        Source("bad", "unheard-of"),
    ]


def scan_twice(spark, sf):
    """Two scans of three sources, one of them broken; summaries of the second."""
    root, sources = new_path(spark, "ledger"), _scan_sources(spark, sf)
    settings = ScanSettings(COMPANY_FRAGMENTS, fx.first_cv(spark, sf), fx.REQUIRED)
    run_scan(spark, root, [sources[0]], settings, "2024-01-01 08:00:00")
    summary = run_scan(spark, root, sources, settings, "2024-01-02 08:00:00")
    return summary.withColumn("error", F.col("error").isNotNull())


def scan_ledger(spark, sf):
    """The jobs and their companies after the same two scans."""
    root, sources = new_path(spark, "ledger"), _scan_sources(spark, sf)
    settings = ScanSettings(COMPANY_FRAGMENTS, fx.first_cv(spark, sf), fx.REQUIRED)
    run_scan(spark, root, [sources[0]], settings, "2024-01-01 08:00:00")
    run_scan(spark, root, sources, settings, "2024-01-02 08:00:00")
    run_scan(spark, root, sources, settings, "2024-01-03 08:00:00", dry_run=True)
    version = state.latest_version(spark, root)
    jobs = state.read_table(spark, root, version, "jobs")
    companies = state.read_table(spark, root, version, "companies")
    return _iso(reports.with_company(jobs, companies), "first_seen_at", "last_seen_at").select(
        "source", "source_id", "company", "title", "seen_count", "status", "match_score", "first_seen_at", "last_seen_at"
    )


def _landed_stream(spark, sf, seen=None):
    path = new_path(spark, "landed-stream")
    seen = fx.sightings(spark, sf) if seen is None else seen
    seen.repartition(6, "pos").write.parquet(path)
    return spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 2).parquet(path)


def incremental_scan(spark, sf):
    root = new_path(spark, "incremental")
    query = incremental.incremental_scan(_landed_stream(spark, sf), root, f"{root}/checkpoint")
    query.awaitTermination()
    incremental.compact(spark, root, upto=1)
    return _iso(incremental.read_ledger(spark, root), "first_seen_at", "last_seen_at").drop("company", "url")


def _streamed_ledger(spark, sf):
    """Three micro-batches as scans; a scan row for each source and batch."""
    root = new_path(spark, "streamed")
    seen = fx.full_sightings(spark, sf).drop("match_score", "matched_keywords", "missing_keywords")
    names = [r["source"] for r in seen.select("source").distinct().collect()]  # a handful of event types
    streamed.scan_stream(
        _landed_stream(spark, sf, seen), root, new_path(spark, "streamed-state"), names, settings=ScanSettings(["company 36"])
    ).awaitTermination()
    version = state.latest_version(spark, root)
    return tuple(state.read_table(spark, root, version, name) for name in ("jobs", "companies", "scans"))


def stream_ledger(spark, sf):
    jobs, companies, _ = _streamed_ledger(spark, sf)
    return _iso(reports.with_company(jobs, companies), "first_seen_at", "last_seen_at").select(
        "source", "source_id", "company", "title", "first_seen_at", "last_seen_at", "seen_count", "status", "match_score"
    )


def stream_scans(spark, sf):
    jobs, companies, scans = _streamed_ledger(spark, sf)
    totals = scans.groupBy("source").agg(
        F.count(F.lit(1)).alias("scans"), F.count("finished_at").alias("closed"),
        *[F.sum(c).alias(c) for c in ("found_count", "new_count", "updated_count")],
    )
    ids = jobs.agg(F.max("id").alias("top_id"), F.count_distinct("id").alias("ids"))
    named = companies.agg(F.max("id").alias("top_company"), F.count_distinct("name").alias("names"))
    # One row each.
    return totals.withColumns({c: t.select(c).scalar() for t in (ids, named) for c in t.columns})


def running_sightings(spark, sf):
    root = new_path(spark, "running")
    incremental.write_running(_landed_stream(spark, sf), root, new_path(spark, "running-state")).awaitTermination()
    return _iso(incremental.read_running(spark, root), "first_seen_at", "last_seen_at")


QUERIES: dict[str, Query] = {
    "top_matches": top_matches,
    "score_postings": score_postings,
    "score_postings_required": score_postings_required,
    "profile_keywords": profile_keywords,
    "score_many_profiles": score_many_profiles,
    "score_many_profiles_by_shuffle": score_many_profiles_by_shuffle,
    "match_profiles": match_profiles,
    "match_profiles_required": match_profiles_required,
    "best_matches": best_matches,
    "token_frequency": token_frequency,
    "exclude_companies": exclude_companies,
    "exclude_companies_table": exclude_companies_table,
    "exclude_companies_long_table": exclude_companies_long_table,
    "exclude_titles": exclude_titles,
    "merge_decisions": merge_decisions,
    "merge_decisions_easy_apply": merge_decisions_easy_apply,
    "merge_counts": merge_counts,
    "landing_rewrite": landing_rewrite,
    "dedup_two_keys": dedup_two_keys,
    "import_exact_url": import_exact_url,
    "first_by_id": first_by_id,
    "last_by_id": last_by_id,
    "site_labels": site_labels,
    "normalize_defaults": normalize_defaults,
    "text_flags": text_flags,
    "url_keys": url_keys,
    "hash_ids": hash_ids,
    "upsert_ledger": upsert_ledger,
    "upsert_two_batches": upsert_two_batches,
    "ledger_tables": ledger_tables,
    "company_dimension": company_dimension,
    "sighting_counts": sighting_counts,
    "scan_log": scan_log,
    "scan_failures": scan_failures,
    "new_in_latest_scan": new_in_latest_scan,
    "new_in_latest_scan_of_source": new_in_latest_scan_of_source,
    "ranked_jobs": ranked_jobs,
    "ranked_jobs_filtered": ranked_jobs_filtered,
    "report_flags": report_flags,
    "export_csv": export_csv,
    "application_state": application_state,
    "job_status": job_status,
    "unknown_jobs": unknown_jobs,
    "applications_report": applications_report,
    "status_view_counts": status_view_counts,
    "discarded_view": discarded_view,
    "status_validation": status_validation,
    "constraint_violations": constraint_violations,
    "csv_source": csv_source,
    "json_source": json_source,
    "feed_source": feed_source,
    "deep_feeds": deep_feeds,
    "tab_results": tab_results,
    "tab_errors": tab_errors,
    "tab_summary": tab_summary,
    "page_records_numbered": _records("linkedin"),
    "page_records_keyed": _records("indeed"),
    "page_summary_numbered": _page_summary("linkedin"),
    "page_summary_keyed": _page_summary("indeed"),
    "page_flags": page_flags,
    "cv_files": cv_files,
    "older_snapshot": older_snapshot,
    "scan_twice": scan_twice,
    "scan_ledger": scan_ledger,
    "incremental_scan": incremental_scan,
    "stream_ledger": stream_ledger,
    "stream_scans": stream_scans,
    "running_sightings": running_sightings,
}
