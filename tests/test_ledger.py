import datetime as dt
import random

from pyspark.sql import functions as F

from postledger.operators import ids, ledger, reports, scans
from postledger.shared import cut, heavy_keys, lookup_join
from postledger.sources import state

BATCH = (
    "source string, source_id string, company string, title string, location string, remote boolean, url string, "
    "description string, posted_at string, match_score double, matched_keywords array<string>, "
    "missing_keywords array<string>, raw string, seen_at timestamp_ntz, pos bigint"
)
T0 = dt.datetime(2024, 1, 1)


def sighting(source, ident, day, pos, company="Plain Co", title="T", url=None, location=None):
    return (source, ident, company, title, location, None, url, "", None, 1.0, ["k"], [], "{}", T0 + dt.timedelta(days=day), pos)


def upsert(spark, jobs, companies, rows):
    done = ledger.upsert_postings(jobs, companies, spark.createDataFrame(rows, BATCH))
    return cut(done.jobs, "t"), cut(done.companies, "t"), {r.source: (r.found_count, r.new_count, r.updated_count) for r in done.counts.collect()}


def empty(spark):
    return state.empty_table(spark, "jobs"), state.empty_table(spark, "companies")


def test_upsert_counts_and_keeps_status(spark):
    jobs, companies, counts = upsert(spark, *empty(spark), [sighting("s", "1", 0, 1, location="Bern")])
    assert counts == {"s": (1, 1, 0)}
    jobs = jobs.withColumn("status", F.lit("applied"))
    jobs, companies, counts = upsert(spark, jobs, companies, [sighting("s", "1", 1, 1, " Other  Co ", "U"), sighting("s", "2", 1, 2), sighting("s", "2", 1, 3)])
    assert counts == {"s": (3, 1, 2)}
    rows = {r.source_id: r for r in reports.with_company(jobs, companies).collect()}
    one, two = rows["1"], rows["2"]
    assert (one.seen_count, one.status, one.title, one.company, one.location) == (2, "applied", "U", "Other Co", None)
    assert (one.first_seen_at, one.last_seen_at) == (T0, T0 + dt.timedelta(days=1))
    assert (two.seen_count, two.status, two.id) == (2, "new", 2)
    assert sorted(r.name for r in companies.collect()) == ["Other Co", "Plain Co"]


def test_batches_in_any_order_give_one_result(spark):
    rng = random.Random(3)
    rows = [
        sighting("ab"[rng.randrange(2)], "hot" if rng.random() < 0.4 else str(rng.randrange(12)), rng.randrange(9), i, title=f"t{i}", url=rng.choice([None, "u"]))
        for i in range(120)
    ]
    whole = ledger.fold_sightings(spark.createDataFrame(rows, BATCH))
    key = lambda df: sorted(tuple(r) for r in df.select("source", "source_id", "seen_count", "first_seen_at", "last_seen_at", "title", F.coalesce("url", F.lit("-"))).collect())
    rng.shuffle(rows)
    parts = [spark.createDataFrame(rows[i::3], BATCH) for i in range(3)]
    now = ledger.fold_sightings(parts[0]).withColumn("status", F.lit("new"))
    for part in parts[1:]:
        now = ledger.upsert_folds(now, ledger.fold_sightings(part))
    assert key(now) == key(whole)
    folds = ledger.fold_sightings(parts[0]).unionByName(ledger.fold_sightings(parts[1])).unionByName(ledger.fold_sightings(parts[2]))
    assert key(ledger.combine_folds(folds)) == key(whole)


def scan_log(spark, rows):
    return spark.createDataFrame(rows, "source string, started_at timestamp_ntz, error string")


def test_new_in_latest_scan(spark):
    jobs, companies, _ = upsert(spark, *empty(spark), [
        sighting("m", "linkedin-1", 5, 1, url="https://www.linkedin.com/jobs/view/1"),
        sighting("m", "linkedin-1", 5, 2, url="https://www.linkedin.com/jobs/view/1"),
        sighting("m", "linkedin-2", 5, 3, "Second Co", url="https://www.linkedin.com/jobs/view/2"),
        sighting("m", "old", 1, 0),
        sighting("n", "late", 8, 4),
    ])
    log = scan_log(spark, [("m", T0 + dt.timedelta(days=5), None), ("m", T0 + dt.timedelta(days=7), "broken"), ("n", T0 + dt.timedelta(days=8), None)])
    rows = reports.new_jobs(jobs, companies, log, source="m").collect()
    assert [(r.source_id, r.website, r.company) for r in rows] == [("linkedin-2", "LinkedIn", "Second Co")]
    # Without a source the newest scan of any source decides.
    assert [r.source_id for r in reports.new_jobs(jobs, companies, log).collect()] == ["late"]
    # Without any scan every job seen once is new.
    assert reports.new_jobs(jobs, companies, log.limit(0)).count() == 3
    ranked = reports.ranked_jobs(jobs, companies, log, source="m").collect()
    assert [r.source_id for r in ranked] == ["linkedin-2", "linkedin-1", "old"]
    assert ranked[0].linkedin.endswith("/2") and ranked[0].indeed == ""


def test_rank_order_ignores_ascii_case_only(spark):
    jobs, companies, _ = upsert(spark, *empty(spark), [
        sighting("b", "1", 0, 1, "beta", "x"), sighting("a", "2", 0, 2, "Acme", "data"),
        sighting("a", "3", 0, 3, "acme", "AI"), sighting("a", "4", 0, 4, "äcme", "AI"),
    ])
    late = scan_log(spark, [("a", T0 + dt.timedelta(days=1), None)])
    rows = reports.ranked_jobs(jobs, companies, late, limit=10).collect()
    assert [r.source_id for r in rows] == ["3", "2", "1", "4"]
    assert reports.ranked_jobs(jobs, companies, late, min_score=2).count() == 4
    assert reports.ranked_jobs(jobs, companies, late, min_score=2, scored_only=True).count() == 0


def test_scan_log_counts_first_sightings(spark):
    seen = spark.createDataFrame([sighting("s", i, d, p) for p, (i, d) in enumerate([("a", 0), ("a", 0), ("b", 1), ("a", 1)])], BATCH).withColumn("day", F.dayofmonth("seen_at"))
    opened = spark.createDataFrame([("s", 1, None), ("s", 2, None), ("s", 3, "x")], "source string, day int, error string")
    rows = {r.day: (r.found_count, r.new_count, r.updated_count) for r in scans.scan_log(seen, ["source", "day"], opened).collect()}
    assert rows == {1: (2, 1, 1), 2: (2, 1, 1), 3: (0, 0, 0)}


def test_arrival_ids_have_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    got = ids.arrival_ids(rows, ["k"], start=5).collect()
    assert sorted((r.k, r.id) for r in got) == [(k, k + 6) for k in range(1000)]


def test_lookup_join_with_heavy_and_null_keys(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(90)] + [(None, 900)], "k int, v int")
    table = spark.createDataFrame([(k, f"n{k}") for k in range(0, 90, 2)] + [(1, "one")], "k int, name string")
    assert [r.k for r in heavy_keys(rows, ["k"], 10).collect()] == [1]
    for how in ("left", "inner"):
        got = lookup_join(rows, table, ["k"], how, share=10)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, ["k"], how).collect()))


def test_older_snapshot_gets_defaults(spark, tmp_path):
    jobs, _, _ = upsert(spark, *empty(spark), [sighting("s", "1", 0, 1)])
    root = str(tmp_path)
    jobs.drop("seen_count").write.parquet(state.table_path(root, 1, "jobs"))
    assert state.read_table(spark, root, 1, "jobs").first().seen_count == 1
    assert state.read_table(spark, root, 1, "scans").count() == 0
    assert state.latest_version(spark, root) == 0


def test_report_rows_mark_by_id_of_any_source(spark):
    columns = "website string, source_id string, title string, company string, linkedin string, indeed string, url string, status string"
    listed = spark.createDataFrame([("A", "1", "t", None, "", "", None, "Applied"), ("B", "2", None, "c", "", "", "u", None)], columns)
    got = {r.job_key: r for r in reports.report_rows(listed, listed.where("source_id = '1'")).collect()}
    assert got["A:1"].is_new and got["A:1"].is_applied and got["A:1"].company == "" and got["A:1"].url == ""
    assert not got["B:2"].is_new and not got["B:2"].is_applied and got["B:2"].status == ""
