"""Whole scans and streams."""

from postledger.operators.ledger import fold_sightings
from postledger.operators.matching import score_postings
from postledger.plans import fixtures as fx
from postledger.plans.scan import ScanSettings, run_scan
from postledger.sources import files, state
from postledger.sources.registry import Source
from postledger.streaming import incremental


def test_scan_writes_versions_and_isolates_failures(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("source_id,title,company\n1,Python dev,Good\n2,Dev,Bad Co\n3,Dev,Good\n")
    root = str(tmp_path / "ledger")
    cv = spark.createDataFrame([("cv", "python sql")], "profile_id string, cv_text string")
    settings = ScanSettings(["bad"], cv, ["Python"])
    sources = [Source("broken", "nope"), Source("a", "csv", options={"path": str(path)})]

    dry = run_scan(spark, root, sources, settings, "2024-01-01 00:00:00", dry_run=True).collect()
    assert [(r.source, r.found_count, r.new_count) for r in dry] == [("broken", 0, 0), ("a", 2, 0)]
    assert state.latest_version(spark, root) == 0

    first = run_scan(spark, root, sources, settings, "2024-01-01 00:00:00").collect()
    assert [(r.source, r.found_count, r.new_count, r.updated_count, bool(r.error)) for r in first] == [
        ("broken", 0, 0, 0, True), ("a", 2, 2, 0, False),
    ]
    path.write_text("source_id,title,company\n1,Python dev,Good\n4,SQL,New Co\n")
    second = run_scan(spark, root, sources, settings, "2024-01-02 00:00:00", names=["a"]).collect()
    assert [(r.found_count, r.new_count, r.updated_count) for r in second] == [(2, 1, 1)]

    version = state.latest_version(spark, root)
    jobs = {r.source_id: r for r in state.read_table(spark, root, version, "jobs").collect()}
    assert {k: (r.seen_count, r.id) for k, r in jobs.items()} == {"1": (2, 1), "3": (1, 2), "4": (1, 3)}
    assert jobs["1"].match_score == 85.0 and jobs["1"].matched_keywords == ["python"]
    assert state.read_table(spark, root, version, "scans").count() == 3
    assert [r.name for r in state.read_table(spark, root, version, "companies").orderBy("id").collect()] == ["Good", "New Co"]


def test_stream_equals_batch_and_replays_are_idempotent(spark, sf_dir, tmp_path):
    seen = fx.sightings(spark, sf_dir)
    landing, root = str(tmp_path / "landing"), str(tmp_path / "ledger")
    seen.repartition(4, "pos").write.parquet(landing)
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    incremental.incremental_scan(stream, root, f"{root}/checkpoint").awaitTermination()
    key = lambda df: sorted(map(str, df.select("source", "source_id", "seen_count", "first_seen_at", "last_seen_at", "last_pos", "title").collect()))
    whole = key(fold_sightings(seen))
    assert key(incremental.read_ledger(spark, root)) == whole
    # The same batch again replaces its delta.
    delta = spark.read.parquet(landing).where("pos < 0")
    incremental.write_delta(delta, root, 99)
    incremental.write_delta(delta, root, 99)
    incremental.compact(spark, root, 1)
    assert key(incremental.read_ledger(spark, root)) == whole
    incremental.compact(spark, root, 99)
    assert key(incremental.read_ledger(spark, root)) == whole


def test_landing_folder_stream(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "ledger")
    landing.mkdir()
    header = "source_id,title,company,location,url,description,posted_at,remote\n"
    (landing / "a.csv").write_text(header + '1,"Dev, ""x""",Co,,,"two\nlines",,yes\n,Linux,Co,,,,,\n,Ops,Bad Co,,,,,\n,Ops,Co,,,,,\n')

    def run():
        incremental.incremental_scan(
            files.landing_stream(spark, str(landing)),
            root,
            f"{root}/checkpoint",
            lambda batch: score_postings(files.stream_postings(batch, "m", ["linux"], ["bad"]), None),
        ).awaitTermination()
        return {r.source_id.rsplit("/", 1)[-1]: r for r in incremental.read_ledger(spark, root).collect()}

    first = run()
    assert {k: r.seen_count for k, r in first.items()} == {"1": 1, "a.csv:4": 1}
    assert first["1"].title == 'Dev, "x"' and first["1"].description == "two\nlines" and first["1"].remote is True
    (landing / "b.csv").write_text(header + "1,Dev 2,Co,,,,,\n")
    assert {k: (r.seen_count, r.title) for k, r in run().items()} == {"1": (2, "Dev 2"), "a.csv:4": (1, "Ops")}
