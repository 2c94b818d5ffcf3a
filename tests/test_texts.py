"""Long attributes of a scan move once, and large folds give the rows of small ones."""

import base64
import datetime as dt
import os
import random

from pyspark.sql import functions as F

from postledger.operators import ledger
from postledger.plans.scan import ScanSettings, run_scan
from postledger.shared import cut, shared_folder
from postledger.sources import state
from postledger.sources.registry import Source

T0 = dt.datetime(2024, 1, 1)


def folder_size(path):
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(path) for name in names)


def test_a_scan_writes_texts_once_before_the_ledger(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "SMALL_ROWS", 5)
    chance = random.Random(5)
    texts = [base64.b64encode(chance.randbytes(6000)).decode() for _ in range(100)]
    path = tmp_path / "a.csv"
    path.write_text("source_id,title,description\n" + "".join(f"{i},Dev,{t}\n" for i, t in enumerate(texts)))
    between, root = shared_folder(spark), str(tmp_path / "ledger")
    before = folder_size(between)
    source = Source("a", "csv", options={"path": str(path)})
    for day in (1, 2):
        run_scan(spark, root, [source], ScanSettings(buckets=4), f"2024-01-0{day} 00:00:00").collect()
    assert folder_size(between) - before < 2 * 1.5 * sum(map(len, texts))
    jobs = state.read_table(spark, root, state.latest_version(spark, root), "jobs").collect()
    assert {int(r.source_id): r.description for r in jobs} == dict(enumerate(texts))
    assert all(r.seen_count == 2 and r.description in r.raw for r in jobs)


def test_large_folds_with_texts_apart(spark, monkeypatch):
    chance = random.Random(7)
    schema = (
        "source string, source_id string, company string, title string, match_score double, "
        "description string, raw string, seen_at timestamp_ntz, pos bigint, row bigint"
    )

    def batch(days, first):
        rows = []
        for i in range(first, first + 400):
            # One key has a third of the rows.
            key = "hot" if chance.random() < 0.33 else str(chance.randrange(120))
            day = dt.timedelta(days=chance.choice(days))
            rows.append((chance.choice("ab"), key, f"Co {i % 5}", f"T{i}", float(i), f"text {i}", f"raw {i}", T0 + day, i, i))
        return cut(spark.createDataFrame(rows, schema), "batch")

    empty = state.empty_table(spark, "jobs"), state.empty_table(spark, "companies")
    first, second = batch([5, 6], 0), batch([1, 9], 1000)
    start = ledger.upsert_postings(*empty, first.drop("row"))
    jobs, companies = cut(start.jobs.withColumn("location", F.lit("stays")), "jobs"), cut(start.companies, "companies")
    want = ledger.upsert_postings(jobs, companies, second.drop("row"))
    top = jobs.agg(F.max("id")).first()[0]
    rows = lambda df: sorted(map(str, df.drop("bucket").select(sorted(c for c in df.columns if c != "bucket")).collect()))
    for apart in (True, False):
        for small in (5, 20_000):
            monkeypatch.setattr(ledger, "SMALL_ROWS", small)
            given = second.drop("description", "raw") if apart else second.drop("row")
            texts = second.select("source", "source_id", "row", "description", "raw") if apart else None
            got = ledger.upsert_buckets(lambda _: jobs, companies, given, top, state.bucket_of(8), texts)
            assert rows(got.jobs) == rows(want.jobs)
            assert rows(got.counts) == rows(want.counts)
            assert got.jobs.where(F.col("bucket") != state.bucket_of(8)).isEmpty()
