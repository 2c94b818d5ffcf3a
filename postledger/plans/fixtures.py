"""Postings, sightings, scans, actions and landed rows derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postledger.functions.text import blank_to_null
from postledger.operators.ledger import fold_sightings
from postledger.schemas import JOBS, conform
from postledger.sources.pages import LAYOUTS

# Fixed values of the fixtures.
REQUIRED = ["That", "onesen", "python", "that"]
CARDS_PER_PAGE = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def headline(text: Column) -> Column:
    """First 80 characters of the first line; NULL if blank."""
    return blank_to_null(F.trim(F.substring(F.split_part(text, F.lit("\n"), F.lit(1)), 1, 80)))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per document; urls repeat, every 50th company is missing."""
    documents = table(spark, sf_dir, "documents")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    doc = F.col("doc_id")
    return (
        # The title is made before the joins, so that the text moves only where it is read.
        documents.withColumn("title", headline(F.col("text")))
        .withColumn("s_suppkey", doc % row_count(supplier))
        .withColumn("page_id", doc % row_count(pages))
        .join(supplier, "s_suppkey", "left")
        .join(pages, "page_id", "left")
        .select(
            "source",
            F.concat(F.lit("doc-"), doc.cast("string")).alias("source_id"),
            "title",
            F.when(doc % 50 != 0, F.col("s_name")).alias("company"),
            F.col("lang").alias("location"),
            "url",
            F.col("text").alias("description"),
            F.element_at(
                F.array(F.lit("Yes"), F.lit("onsite"), F.lit(""), F.lit("maybe")), (doc % 4 + 1).cast("int")
            ).alias("remote"),
            doc.alias("pos"),
        )
    )


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected rows with repeated ids and urls, empty cells and slash variants."""
    documents = table(spark, sf_dir, "documents")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"))
    doc, url = F.col("doc_id"), F.col("page_url")
    ids = F.concat(F.lit("c-"), (F.col("n_chars") % F.floor(F.col("n_docs") * 2 / 5)).cast("string"))
    return (
        documents.withColumn("n_docs", row_count(documents))
        .withColumn("s_suppkey", doc % row_count(supplier))
        .withColumn("page_id", (doc * 31) % row_count(pages))
        .join(supplier, "s_suppkey", "left")
        .join(pages, "page_id", "left")
        .select(
            F.when(doc % 13 != 0, ids).otherwise(F.lit("")).alias("source_id"),
            F.coalesce(headline(F.col("text")), F.lit("")).alias("title"),
            F.when(doc % 50 != 0, F.concat(F.lit(" "), F.col("s_name"))).otherwise(F.lit("")).alias("company"),
            F.col("lang").alias("location"),
            F.when(doc % 11 == 0, "")
            .when(doc % 17 == 0, F.concat(url, F.lit("//")))
            .when(doc % 3 == 0, F.concat(url, F.lit("/")))
            .otherwise(url)
            .alias("url"),
            F.concat(F.when(doc % 5 == 0, "Easy  Apply ").otherwise(""), F.col("text")).alias("description"),
            F.lit("last-24h").alias("posted_at"),
            F.lit("").alias("remote"),
            doc.alias("pos"),
        )
    )


def stored_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows already in the landing table: pages with a plain address."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    pages = table(spark, sf_dir, "pages").where("url like '%.html' or url like '%/'")
    return (
        pages.withColumn("s_suppkey", F.col("page_id") % row_count(supplier))
        .join(supplier, "s_suppkey", "left")
        .select(
            F.concat(F.lit("e-"), F.col("page_id").cast("string")).alias("source_id"),
            F.lit("Stored").alias("title"),
            F.col("s_name").alias("company"),
            "url",
            F.col("page_id").alias("pos"),
        )
    )


def stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and urls in the ledger: suppliers in debt, some with a page address."""
    supplier = table(spark, sf_dir, "supplier").where("s_acctbal < 0")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("s_suppkey"), "url")
    return supplier.join(pages, "s_suppkey", "left").select(
        F.concat(F.lit("c-"), F.col("s_suppkey").cast("string")).alias("source_id"), "url"
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated observations of postings, one per event."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"),
        F.concat(user.cast("string"), F.lit("-"), F.hour("ts").cast("string")).alias("source_id"),
        F.col("ts").alias("seen_at"),
        F.col("event_id").alias("pos"),
        F.col("props").alias("title"),
        F.concat(F.lit(" Company  "), (user % 37).cast("string")).alias("company"),
        F.concat(
            F.when(user % 3 == 0, "https://www.LinkedIn.com/").when(user % 3 == 1, "https://x.indeed.ch/").otherwise("https://else.org/"),
            user.cast("string"),
        ).alias("url"),
        F.col("value").alias("match_score"),
    )


def full_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings with every column that the jobs table keeps."""
    text = F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    return (
        sightings(spark, sf_dir)
        .withColumn("location", text)
        .withColumn("remote", F.lit(None).cast("boolean"))
        .withColumn("description", F.lit(""))
        .withColumn("posted_at", text)
        .withColumn("matched_keywords", none)
        .withColumn("missing_keywords", none)
        .withColumn("raw", F.lit("{}"))
    )


def folded_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sightings as a jobs table; a job has the number of its last event."""
    rows = fold_sightings(full_sightings(spark, sf_dir))
    return conform(
        rows.withColumn("id", F.col("last_pos"))
        .withColumn("company_id", F.regexp_extract("company", r"(\d+)", 1))
        .withColumn("status", F.lit("new")),
        JOBS,
    )


def folded_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.col("user_id") % 37
    return table(spark, sf_dir, "events").select(
        group.alias("id"), F.concat(F.lit("Company "), group.cast("string")).alias("name")
    ).distinct()


def scan_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per source and day; days divisible by 7 failed."""
    day = F.to_date("ts")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("source"), day.alias("scan_day"))
        .agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"))
        .withColumn("error", F.when(F.dayofmonth("scan_day") % 7 == 0, F.lit("timeout")))
    )


def tracked_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_nationkey").cast("bigint").alias("company_id"),
        F.col("s_name").alias("title"),
        F.lit("new").alias("status"),
        F.lit(1).cast("bigint").alias("seen_count"),
    )


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")
    )


def open_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications from before the log: one per supplier with a high balance."""
    then = F.lit("2023-06-01 08:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(
        F.col("s_suppkey").alias("job_id"),
        F.lit(0).cast("bigint").alias("company_id"),
        F.lit("old position").alias("position"),
        F.lit("applied").alias("status"),
        then.alias("applied_at"),
        F.lit("old").alias("notes"),
        then.alias("created_at"),
        then.alias("updated_at"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered status changes; clicks record an interview without a reset."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").where("event_type <> 'view'").select(
        F.col("user_id").alias("job_id"),
        F.when(kind == "click", "apply").otherwise("set_status").alias("via"),
        F.when(kind == "purchase", "applied").when(kind == "error", "discarded").when(kind == "click", "interview").otherwise("new").alias("status"),
        F.when(kind != "purchase", F.col("props")).alias("notes"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("pos"),
    )


def cv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per benchmark item, with the fixed required words."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("profile_id"),
        F.col("text").alias("cv_text"),
        F.array(*[F.lit(word) for word in REQUIRED]).alias("required"),
    )


def first_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the first benchmark item."""
    return table(spark, sf_dir, "benchmark").agg(
        F.min("item_id").alias("profile_id"), F.min_by("text", "item_id").alias("cv_text")
    )


def dialogue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per conversation, in rows by turn."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("profile_id"), "turn", F.col("text").alias("cv_text")
    )


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def result_pages(spark: SparkSession, sf_dir: str, site: str) -> DataFrame:
    """Result pages of a site, ten cards each, made from the documents.

    Cards 0 to 5 carry an id attribute, 6 and 7 only a link with an id, 8 an
    anonymous link, and 9 repeats the id of card 0. Every third page asks for a
    login or a human check.
    """
    layout = LAYOUTS[site]
    doc, slot = F.col("doc_id"), F.col("doc_id") % CARDS_PER_PAGE
    page = F.expr(f"doc_id div {CARDS_PER_PAGE}")
    job = F.when(slot == 9, page * CARDS_PER_PAGE).otherwise(doc).cast("string")
    title = _escaped(F.coalesce(headline(F.col("text")), F.lit("")))
    numbered = layout.numbered
    link = F.concat(F.lit("/jobs/view/" if numbered else "/viewjob?from=x&amp;jk="), job)
    href = F.when(slot == 8, F.concat(F.lit("/jobs/view/x" if numbered else "/viewjob?pos="), doc.cast("string"))).otherwise(link)
    attribute = F.when(slot.isin(6, 7, 8), "").otherwise(F.concat(F.lit(f' {layout.id_attribute}="'), job, F.lit('"')))
    card_class = layout.cards[0 if numbered else 1].lstrip(".")
    heading = (
        ('<a class="job-card-list__title--link" href="', '"><span>', "</span></a>")
        if numbered
        else ('<h2 class="jobTitle"><a href="', '">', "</a></h2>")
    )
    company_mark = 'class="artdeco-entity-lockup__subtitle"' if numbered else 'data-testid="company-name"'
    place_mark = 'class="job-card-container__metadata-item"' if numbered else 'class="companyLocation"'
    note = F.when(doc % 3 == 0, "REMOTE work").when(doc % 3 == 1, "Home  Office, easy\n apply").otherwise("remotely")
    card = F.concat(
        F.lit(f'<div class="card {card_class}"'), attribute, F.lit(">"),
        F.lit(heading[0]), href, F.lit(heading[1]), title, F.lit(heading[2]),
        F.lit(f"<div {company_mark}>\n  "), F.col("source"), F.lit(" &amp; Co </div>"),
        F.lit(f"<span {place_mark}>"), F.col("lang"), F.lit("</span><p>"), note,
        F.lit("</p><script>var x = '<p>';</script></div>"),
    )
    gate = F.lit("Please Sign  In" if numbered else "Verify you\n are human")
    cards = F.sort_array(F.collect_list(F.struct("doc_id", "card")))
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", page.alias("page_id"), card.alias("card"))
        .groupBy("page_id")
        .agg(cards.alias("cards"))
        .select(
            "page_id",
            F.lit("https://jobs.example.com/search?q=1").alias("url"),
            F.concat(
                F.lit("<html><head><title> Page "), F.col("page_id").cast("string"),
                F.lit("</title></head><body><!-- captcha, sign in --><main>"),
                F.array_join(F.col("cards.card"), "\n"),
                F.lit("</main><footer>"), F.when(F.col("page_id") % 3 == 0, gate).otherwise(""),
                F.lit("</footer></body></html>"),
            ).alias("html"),
        )
    )
